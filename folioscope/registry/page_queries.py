"""Registered page-text queries with their SQL twins.

Every document becomes a small manual: a contents page, then pages of six lines with a running
header, a repeated footer line, a page number, numbered headings, commands and bullets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import pagetext as P
from folioscope.registry.chunk_queries import WS, WS_CLASS
from folioscope.registry.derive import load, spread
from folioscope.session import materialise

BOTTOM = 1_000_000_000
LEADERS = " ........ "


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(load(spark, d, "documents").select("doc_id", "source", "lang", "text"))
    lines = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    i, t = F.col("i"), F.col("t")
    page = (1 + F.floor(i / 6)).cast("int")

    def line(sub: int, text: Column, page_no: Column = page) -> Column:
        return F.struct(page_no.alias("page_no"), (i * 10 + sub).cast("int").alias("line_no"), text.alias("line"))

    contents = F.lit(0)
    number = (i + 1).cast("string")
    whole = F.concat(number, F.lit(" "), F.left(t, F.lit(30)), F.lit(LEADERS), page)
    titled = i % 3 == 0
    wrapped = i % 6 == 3
    rows = F.array_compact(
        F.array(
            F.when(titled & ~wrapped, line(0, whole, contents)),
            F.when(wrapped, line(0, F.concat(number, F.lit(" "), F.left(t, F.lit(10))), contents)),
            F.when(wrapped, line(1, F.concat(F.substr(t, F.lit(11), F.lit(20)), F.lit(LEADERS), page), contents)),
            F.when(titled, line(2, F.concat(number, F.lit(" "), F.left(t, F.lit(30))))),
            line(3, t),
            F.when(i % 5 == 0, line(4, F.concat(F.lit("$ kubectl get pod-"), i))),
            F.when(i % 7 == 0, line(5, F.concat(F.lit(" • "), F.left(t, F.lit(40))))),
        )
    )
    body = lines.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")
    count = (1 + F.floor((F.size(F.split("text", "\n")) - 1) / 6)).cast("int")  # without a text there is no line
    sizes = docs.where(F.col("text").isNotNull()).select("doc_id", "source", "lang", count.alias("n"))
    pages = sizes.groupBy("doc_id", "source", "lang").agg(F.max("n").alias("n")).select(
        "doc_id", "source", "lang", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page_no")
    )
    header = F.concat(F.lit("Manual of collection "), "source", F.lit(" "), "lang", F.lit(" "), "page_no")
    frame = pages.select(
        "doc_id",
        F.explode(
            F.array(
                F.struct(F.col("page_no"), F.lit(-1).alias("line_no"), header.alias("line")),
                F.struct(F.col("page_no"), F.lit(BOTTOM).alias("line_no"), F.lit("For internal use only ").alias("line")),
                F.struct(F.col("page_no"), F.lit(BOTTOM + 1).alias("line_no"), F.col("page_no").cast("string").alias("line")),
            )
        ).alias("r"),
    ).select("doc_id", "r.*")
    filler = docs.select(
        "doc_id", F.lit(0).alias("page_no"), F.posexplode(F.array(*[F.lit(f"0.{n} Preface T o part {n} ...... 1") for n in range(1, 6)])).alias("p", "line")
    ).select("doc_id", "page_no", (F.col("p") - 10).alias("line_no"), "line")
    return body.unionByName(frame).unionByName(filler)


_FILLER = "[" + ", ".join(f"'0.{n} Preface T o part {n} ...... 1'" for n in range(1, 6)) + "]"
LINES_SQL = f"""src AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
pl AS (
  SELECT doc_id, 0 AS page_no, i * 10 AS line_no, (i + 1) || ' ' || left(t, 30) || '{LEADERS}' || (1 + i // 6) AS line FROM src WHERE i % 6 = 0
  UNION ALL SELECT doc_id, 0, i * 10, (i + 1) || ' ' || left(t, 10) FROM src WHERE i % 6 = 3
  UNION ALL SELECT doc_id, 0, i * 10 + 1, substr(t, 11, 20) || '{LEADERS}' || (1 + i // 6) FROM src WHERE i % 6 = 3
  UNION ALL SELECT doc_id, 1 + i // 6, i * 10 + 2, (i + 1) || ' ' || left(t, 30) FROM src WHERE i % 3 = 0
  UNION ALL SELECT doc_id, 1 + i // 6, i * 10 + 3, t FROM src
  UNION ALL SELECT doc_id, 1 + i // 6, i * 10 + 4, '$ kubectl get pod-' || i FROM src WHERE i % 5 = 0
  UNION ALL SELECT doc_id, 1 + i // 6, i * 10 + 5, ' • ' || left(t, 40) FROM src WHERE i % 7 = 0
  UNION ALL SELECT DISTINCT doc_id, 1 + i // 6, -1, 'Manual of collection ' || source || ' ' || lang || ' ' || (1 + i // 6) FROM src
  UNION ALL SELECT DISTINCT doc_id, 1 + i // 6, {BOTTOM}, 'For internal use only ' FROM src
  UNION ALL SELECT DISTINCT doc_id, 1 + i // 6, {BOTTOM} + 1, CAST(1 + i // 6 AS VARCHAR) FROM src
  UNION ALL SELECT doc_id, 0, unnest(range(0, 5)) - 10, unnest({_FILLER}) FROM documents),
st AS (SELECT *, trim(line, {WS}) AS s FROM pl),
pc AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM pl GROUP BY doc_id),
fu AS (SELECT doc_id, s AS line, count(DISTINCT page_no) AS pages_seen, any_value(pages) AS pages FROM st JOIN pc USING (doc_id) WHERE s <> '' GROUP BY doc_id, s
  HAVING count(DISTINCT page_no) >= greatest(2, floor(any_value(pages) * 0.5))),
fl AS (SELECT doc_id, page_no, arg_min(s, line_no) AS f FROM st WHERE s <> '' GROUP BY doc_id, page_no),
fw AS (SELECT doc_id, regexp_extract_all(f, '[^{WS_CLASS[1:]}+') AS w FROM fl),
fp AS (SELECT doc_id, n, array_to_string(w[1:n], ' ') AS header, count(*) AS seen FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS n FROM fw) GROUP BY doc_id, n, header),
hd AS (SELECT doc_id, arg_max(header, (n, seen, header)) AS header FROM fp JOIN pc USING (doc_id) WHERE seen >= pages * 0.5 GROUP BY doc_id),
hdr AS (SELECT * FROM hd WHERE length(header) >= 12)"""


def _fix_sql(text: str) -> str:
    for wrong, right in P.BROKEN_PAIRS.items():
        text = f"replace({text}, '{wrong}', '{right}')"
    return f"trim(regexp_replace({text}, '[ \\t]+', ' ', 'g'), {WS})"


def _code_sql(text: str) -> str:
    words = " OR ".join(f"starts_with({text}, '{w}')" for w in P.COMMAND_WORDS)
    return f"""({text} <> '' AND (regexp_matches({text}, '{P.PROMPT}') OR regexp_matches({text}, '{P.BARE_PROMPT}')
      OR {words} OR regexp_matches({text}, '{P.OUTPUT_LIKE}')))"""


def _class_sql(text: str) -> str:
    prose = f"""(length({text}) >= 12 AND NOT regexp_matches({text}, '{P.PROMPT}') AND NOT regexp_matches({text}, '{P.OUTPUT_LIKE}')
      AND len(regexp_extract_all({text}, '[^{WS_CLASS[1:]}+')) >= 3
      AND (length({text}) - length(regexp_replace({text}, '[\\p{{L}} ]', '', 'g'))) / length({text}) > 0.75 AND regexp_matches({text}, '^\\p{{Lu}}'))"""
    label = f"""(regexp_full_match({text}, '[A-Za-z][A-Za-z ,:''()\\-]*') AND NOT (regexp_matches({text}, '[A-Z]') AND NOT regexp_matches({text}, '[a-z]'))
      AND len(string_split_regex({text}, ' +')) <= 5)"""
    return f"CASE WHEN {_code_sql(text)} THEN 'code' WHEN {prose} THEN 'prose' WHEN {label} THEN 'label' ELSE 'other' END"


TOC_SQL = (
    LINES_SQL
    + f""",
tp AS (SELECT doc_id, page_no FROM pl GROUP BY ALL HAVING count(*) FILTER (regexp_matches(line, '\\.{{4,}}')) >= 5),
tl AS (SELECT st.* FROM st SEMI JOIN tp ON tp.doc_id = st.doc_id AND tp.page_no = st.page_no WHERE s <> ''),
to_ AS (SELECT *, lag(CASE WHEN regexp_matches(s, '{P.NUMBERED}') AND NOT regexp_matches(s, '\\.{{4,}}') AND NOT regexp_matches(s, '{P.TOC_ENTRY}') THEN s END)
   OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS o FROM tl),
te AS (SELECT doc_id, page_no, line_no, CASE WHEN o IS NULL THEN s ELSE o || ' ' || s END AS x FROM to_)"""
)

CLEAN_SQL = (
    LINES_SQL
    + f""",
cl AS (SELECT st.doc_id, st.page_no, st.line_no, CASE WHEN {_code_sql('st.s')} THEN rtrim(st.line, {WS})
    ELSE CASE WHEN regexp_matches({_fix_sql('st.line')}, '^(\\d+)\\.\\s+\\d') THEN regexp_replace({_fix_sql('st.line')}, '^(\\d+)\\.\\s+', '\\1.') ELSE {_fix_sql('st.line')} END END AS line
  FROM st LEFT JOIN hdr USING (doc_id) WHERE s <> '' AND NOT regexp_full_match(s, '\\d{{1,3}}')
    AND NOT EXISTS (SELECT 1 FROM fu WHERE fu.doc_id = st.doc_id AND fu.line = st.s) AND (header IS NULL OR NOT starts_with(s, header)))"""
)


def furniture(spark: SparkSession, d: str) -> DataFrame:
    return P.furniture(page_lines(spark, d))


def shared_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines repeated over the documents of a collection, each document being a page."""
    rows = load(spark, d, "documents").select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return P.furniture(rows, 0.02).select("doc_id", "pages_seen", F.md5(F.col("line").cast("binary")).alias("digest"))


def running_header(spark: SparkSession, d: str) -> DataFrame:
    return P.running_header(page_lines(spark, d))


def parse_toc(spark: SparkSession, d: str) -> DataFrame:
    return P.parse_toc(page_lines(spark, d))


def fix_text(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("doc_id", P.fix_text("text").alias("fixed"))
    return rows.select("doc_id", F.length("fixed").cast("long").alias("chars"), F.md5(F.col("fixed").cast("binary")).alias("digest"))


def classify_line(spark: SparkSession, d: str) -> DataFrame:
    return page_lines(spark, d).groupBy("doc_id", P.classify_line("line").alias("kind")).agg(F.count("*").alias("lines"))


def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = P.clean_lines(materialise(page_lines(spark, d)))  # read several times
    return rows.select(
        "doc_id", F.col("page_no").cast("long").alias("page_no"), F.col("line_no").cast("long").alias("line_no"), F.md5(F.col("line").cast("binary")).alias("digest")
    )


def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    return P.markdown_blocks(page_lines(spark, d))  # lines kept on disk would take several times the documents' room


def assemble_markdown(spark: SparkSession, d: str) -> DataFrame:
    titles = load(spark, d, "documents").select("doc_id", F.concat(F.lit("Manual "), "doc_id").alias("title"))
    return P.assemble_markdown(page_lines(spark, d), titles)


QUERIES = {
    f.__name__: f
    for f in (furniture, shared_lines, running_header, parse_toc, fix_text, classify_line, clean_lines, markdown_blocks, assemble_markdown)
}

ORACLES = {
    "furniture": f"WITH {LINES_SQL} SELECT doc_id, line, pages_seen FROM fu",
    "shared_lines": f"""WITH l AS (SELECT source AS doc_id, doc_id AS page_no, trim(unnest(string_split(text, chr(10))), {WS}) AS s FROM documents),
      p AS (SELECT source AS doc_id, count(*) AS pages FROM documents GROUP BY source)
      SELECT doc_id, count(DISTINCT page_no) AS pages_seen, md5(s) AS digest FROM l JOIN p USING (doc_id) WHERE s <> '' GROUP BY doc_id, s
      HAVING count(DISTINCT page_no) >= greatest(2, floor(any_value(pages) * CAST(0.02 AS DOUBLE)))""",
    "running_header": f"WITH {LINES_SQL} SELECT doc_id, header FROM hdr",
    "parse_toc": f"""WITH {TOC_SQL} SELECT doc_id, regexp_extract(x, '{P.TOC_ENTRY}', 1) AS number,
      arg_max({_fix_sql(f"regexp_extract(x, '{P.TOC_ENTRY}', 2)")}, (page_no, line_no)) AS title FROM te WHERE regexp_matches(x, '{P.TOC_ENTRY}') GROUP BY ALL""",
    "fix_text": f"SELECT doc_id, length({_fix_sql('text')}) AS chars, md5({_fix_sql('text')}) AS digest FROM documents",
    "classify_line": f"WITH {LINES_SQL} SELECT doc_id, {_class_sql('s')} AS kind, count(*) AS lines FROM st GROUP BY ALL",
    "clean_lines": f"WITH {CLEAN_SQL} SELECT doc_id, CAST(page_no AS BIGINT) AS page_no, CAST(line_no AS BIGINT) AS line_no, md5(line) AS digest FROM cl",
}
