"""Page lines are written once: one shuffle by document, no checkpoint; marks within a document equal the operators' rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from folioscope.operators import pagetext as P
from folioscope.registry import page_queries

SCHEMA = "doc_id long, page_no int, line_no int, line string"
LINES = [
    "1 foo", "1abc ... 7", "2 x ..... 3", "word", "12", "goes on ..... 4", "3 a ... 5", " ", "4. 1 glued", "T o end", "$ ls pod-", "space",
    "5 bar ......... 9", "Header of all pages one", "Header of all pages two", "This sentence is long enough to be wrapped at the end of the line", None,
]


def nodes(plan):
    yield plan
    for k in range(plan.children().length()):
        yield from nodes(plan.children().apply(k))


def plan_of(df):
    return list(nodes(df._jdf.queryExecution().sparkPlan())) + list(nodes(df._jdf.queryExecution().executedPlan().inputPlan()))


def shuffles_of(df, column):
    found = [n for n in nodes(df._jdf.queryExecution().executedPlan().inputPlan()) if n.nodeName() == "Exchange"]
    return [n for n in found if column in [n.output().apply(k).name() for k in range(n.output().length())]]


def drawn(spark, pages=7):
    draw = random.Random(3)
    rows = []
    for doc in [*range(60), None]:
        own = draw.sample(LINES, 9)
        for page in [*range(draw.randint(1, pages)), None]:
            n, some = draw.randint(0, 14), draw.choice([own, own, [*LINES[:7], LINES[12]]])
            rows += [(doc, page, None if i == 11 else i, draw.choice(some)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_lines_are_shuffled_once(spark):
    df = drawn(spark)
    titles = df.select("doc_id", F.lit("t").alias("title")).distinct()
    for made in (P.clean_lines(df), P.markdown_blocks(df), P.assemble_markdown(df, titles)):
        assert len(shuffles_of(made, "line")) == 1 and not shuffles_of(made, "_strip") and not shuffles_of(made, "_text")


def test_queries_keep_no_lines_on_disk(spark, sf_dir):
    for query in (page_queries.markdown_blocks, page_queries.assemble_markdown):
        names = {n.nodeName() for n in plan_of(query(spark, sf_dir))}
        assert not [n for n in names if "ExistingRDD" in n] and [n for n in names if "parquet" in n]


def test_entries_within_a_document_are_those_of_the_contents(spark):
    df = drawn(spark)
    marked = P.mark_contents(P.by_document(df))
    pages = {tuple(r) for r in marked.where("_toc").select("doc_id", "page_no").distinct().collect()}
    assert pages == {tuple(r) for r in P.toc_pages(df).where("doc_id is not null and page_no is not null").collect()} and len(pages) > 10
    entry = marked.where("_entry is not null").select(
        "doc_id", "page_no", "line_no", F.regexp_extract("_entry", P.TOC_ENTRY, 1).alias("number"), P.fix_text(F.regexp_extract("_entry", P.TOC_ENTRY, 2)).alias("title")
    )
    got = entry.groupBy("doc_id", "number").agg(F.max_by("title", F.struct("page_no", "line_no")).alias("title"))
    wanted = {tuple(r) for r in P.parse_toc(df).collect()}
    assert {tuple(r) for r in got.collect()} == wanted and len(wanted) > 20


def test_kept_lines_are_those_that_are_no_furniture(spark):
    """Clean lines by the rows of furniture and running_header, documents and pages of NULL included."""
    df = drawn(spark)
    furniture = {(r.doc_id, r.line) for r in P.furniture(df).collect()}
    headers = {r.doc_id: r.header for r in P.running_header(df).collect()}
    kept = []
    for r in df.collect():
        text = (r.line or "").strip()
        if text and not (text.isdigit() and len(text) <= 3) and (r.doc_id, text) not in furniture and not (headers.get(r.doc_id) and text.startswith(headers[r.doc_id])):
            kept.append((str(r.doc_id), str(r.page_no), str(r.line_no)))
    got = [(str(r.doc_id), str(r.page_no), str(r.line_no)) for r in P.clean_lines(df).collect()]
    assert sorted(got) == sorted(kept) and furniture and headers and any(doc == "None" for doc, _, _ in got)


def test_running_header_reads_lines_once(spark):
    """Pages without a first line count, documents of NULL have no header."""
    rows = [(d, p, 0, "Guide of the house, page") for d in (1, None) for p in range(2)] + [(1, 2, 0, " "), (1, 3, 0, None)]
    rows += [(2, p, 0, "Guide of the house, page") for p in range(2)] + [(2, p, 0, " ") for p in (2, 3, 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    made = P.running_header(df)
    assert [tuple(r) for r in made.collect()] == [(1, "Guide of the house, page")]
    assert sum(n.nodeName().startswith("Scan ExistingRDD") for n in nodes(made._jdf.queryExecution().sparkPlan())) == 1


def test_mended_text_keeps_blanks_and_mends_pairs(spark):
    rows = ["T able  of\tT erms T o go ", " a b ", "a \t b", "T o", "T  he x", "no pairs here", "\tT he x", ""]
    wanted = ["Table of T erms To go", "a b", "a b", "T o", "T he x", "no pairs here", "The x", ""]
    lines = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    assert [r[0] for r in lines.orderBy("i").select(P.fix_text("t")).collect()] == wanted


def test_documents_are_put_together_where_their_lines_are(spark):
    """Blocks are joined to repeated titles without another shuffle of the text, and documents without lines keep their title."""
    df = drawn(spark)
    titles = spark.createDataFrame([(1, "one"), (1, "one again"), (None, "null"), (1000, "no lines")], "doc_id long, title string")
    made = P.assemble_markdown(df, titles)
    carried = {column: len(shuffles_of(made, column)) for column in ("line", "block", "_body", "_piece")}
    assert carried == {"line": 1, "block": 0, "_body": 0, "_piece": 0}
    got = {r.markdown.split("\n")[0]: (r.doc_id, r.markdown.split("\n", 1)[1]) for r in made.collect()}
    assert got["# no lines"] == (1000, "") and got["# null"] == (None, "")
    assert got["# one"] == got["# one again"] and len(got["# one"][1]) > 5 and len(got) == 4
