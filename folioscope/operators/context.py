"""Exact lookups, context packing and prompt building over request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.literals import match_literals
from folioscope.functions.text import (
    citation,
    estimate_tokens,
    label_line,
    nonblank,
    overlap_length,
    strip,
    truncate_tokens,
)
from folioscope.operators.dialogue import sanitize_history
from folioscope.operators.retrieval import send_small, top_ranked
from folioscope.session import materialise

# Limits and wording of the lookups and prompts.
HINT_ITEMS = 12
LITERAL_LIMIT = 40
PAYLOAD_TOKENS = 1200
EXPAND_TOKENS = 2400
LOW_CONFIDENCE = 1.0
RULE = "\n\n---\n\n"
SYSTEM_BASE = "你是一个专业的知识助手，负责根据公司内部文档回答用户的问题。"
SYSTEM_NO_HITS = (
    "知识库中没有检索到与问题相关的内容。请明确告知用户未在文档中找到相关信息，"
    "不要编造文档内容。"
)
SYSTEM_WITH_HITS = (
    "请仅根据以下参考资料回答问题。资料中没有的信息不要推测或编造，"
    "如资料不足以回答，请如实说明。引用具体内容时请指明出处编号。\n\n"
    "参考资料：\n"
)
FOOTER = "\n\n---\n参考来源："
FOOTER_SEPARATOR = "；"
BLOCK_LABEL = ("[资料", "｜出处: ", "]\n")
HINT_SEPARATOR = "、"
UNTITLED = "（无标题正文）"


# ---------------------------------------------------------------- exact lookups


def fetch_section(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks of the asked ``(source, heading)``, or of the whole source without a heading.

    ``requests(request_id, source, heading)``; rows keep ``chunk_index`` as document order.
    """
    asked, _ = send_small(requests.select("request_id", "source", F.col("heading").alias("_asked")))
    wanted = F.coalesce("_asked", F.lit(""))
    return (
        chunks.select("source", "chunk_index", "heading", "content")
        .join(asked, "source")
        .where((wanted == "") | (F.col("heading") == wanted))
        .drop("_asked")
    )


def document_exists(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(request_id, source, exists)``."""
    asked, small = send_small(requests.select("source").distinct())
    # Only the asked sources are kept while chunks are scanned, then counted once each.
    known = chunks.select("source").join(asked, "source", "left_semi").distinct().withColumn("_known", F.lit(True))
    return requests.join(known, "source", "left").select(
        "request_id", "source", F.coalesce("_known", F.lit(False)).alias("exists")
    )


def literal_matches(requests: DataFrame, chunks: DataFrame, limit: int = LITERAL_LIMIT) -> tuple[DataFrame, DataFrame]:
    """``(pattern, scope, total)`` and the first ``limit`` places ``(pattern, scope, source, chunk_index, rank)``.

    ``scope`` is the asked document, NULL for all. Texts are scanned once; what is kept of a match is its
    place, and equal requests are one.
    """
    scopes = requests.select("pattern", F.nullif("source", F.lit("")).alias("scope")).distinct()
    small, _ = send_small(scopes)
    places = match_literals(chunks.select("source", "chunk_index", "content"), "content", requests.select("pattern"))
    # Counted and ranked from one stored table of places, so that the texts are not scanned twice.
    places = materialise(places.select("pattern", "source", "chunk_index").join(small, "pattern").where(F.col("scope").isNull() | (F.col("scope") == F.col("source"))))
    totals = places.groupBy("pattern", "scope").agg(F.count("*").alias("total"))
    shown = top_ranked(places, max(1, limit), [F.asc("source"), F.asc("chunk_index")], by=("pattern", "scope"))
    return totals, shown


def _same_scope(left: str) -> Column:
    return F.col(left).eqNullSafe(F.col("scope"))


def find_literal(requests: DataFrame, chunks: DataFrame, limit: int = LITERAL_LIMIT) -> DataFrame:
    """Chunks whose body contains the asked string, the first ``limit`` with the true ``total``.

    ``requests(request_id, pattern, source)``; a NULL source searches everything. Headings are
    not searched and case matters. Texts are fetched for the places that are shown only.
    """
    totals, shown = literal_matches(requests, chunks, limit)
    # A place stored twice is two hits with two ranks; its texts pair up by their order.
    twin = Window.partitionBy("pattern", "scope", "source", "chunk_index").orderBy("rank")
    shown = shown.withColumn("_twin", F.row_number().over(twin))
    wanted, _ = send_small(shown.select("source", "chunk_index").distinct())
    body = chunks.select("source", "chunk_index", "heading", "content").join(wanted, ["source", "chunk_index"], "left_semi")
    by_place = Window.partitionBy("source", "chunk_index", "pattern").orderBy("heading", "content")
    asked_at = shown.select("source", "chunk_index", "pattern").distinct()
    texts = body.join(asked_at, ["source", "chunk_index"]).where(F.contains("content", F.col("pattern")))
    texts = texts.withColumn("_twin", F.row_number().over(by_place))
    hits = shown.join(texts, ["source", "chunk_index", "pattern", "_twin"]).drop("_twin")
    hits = hits.join(totals.withColumnsRenamed({"pattern": "_p", "scope": "_s"}), (F.col("pattern") == F.col("_p")) & F.col("scope").eqNullSafe(F.col("_s"))).drop("_p", "_s")
    asked = requests.select("request_id", F.col("pattern").alias("_pattern"), F.nullif("source", F.lit("")).alias("_asked"))
    found = asked.join(hits, (F.col("_pattern") == F.col("pattern")) & _same_scope("_asked"))
    return found.select("request_id", "pattern", "source", "chunk_index", "heading", "content", "rank", "total")


def literal_lookup(requests: DataFrame, chunks: DataFrame, limit: int = LITERAL_LIMIT) -> DataFrame:
    """Per request ``(status, total, shown, hint)``: ok, empty, no_document or blank.

    No hit in an unknown document is a miss, whose hint names the documents; no hit in a known one is an
    empty result.
    """
    asked = requests.select(
        "request_id", strip("pattern").alias("pattern"), F.nullif(strip("source"), F.lit("")).alias("source")
    )
    totals, _ = literal_matches(asked.where("pattern <> ''"), chunks, limit)
    found = totals.withColumnRenamed("pattern", "_pattern")
    found = asked.join(found, (F.col("pattern") == F.col("_pattern")) & _same_scope("source"), "left").select("request_id", "pattern", "source", "total")
    known = document_exists(asked.where("source is not null"), chunks).select("source", "exists").distinct()
    total = F.coalesce("total", F.lit(0))
    status = (
        F.when(~nonblank("pattern"), "blank")
        .when(total > 0, "ok")
        .when(F.col("source").isNotNull() & ~F.col("exists"), "no_document")
        .otherwise("empty")
    )
    rows = found.join(known, "source", "left").select("request_id", status.alias("status"), total.alias("total"), F.least(total, F.lit(max(1, limit))).alias("shown"))
    return with_document_hint(rows, chunks)


def with_document_hint(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add ``hint``, or fill an empty one: the documents there are, for rows with status ``no_document``."""
    names = document_hint(chunks).select(F.col("hint").alias("_names"), F.lit("no_document").alias("_status"))
    # One row, joined by the status it belongs to.
    joined = rows.join(F.broadcast(names), rows["status"] == F.col("_status"), "left")
    own = F.col("hint") if "hint" in rows.columns else F.lit(None).cast("string")
    return joined.withColumn("hint", F.coalesce(own, F.nullif("_names", F.lit("")))).drop("_names", "_status")


def stitch_section(chunks: DataFrame, max_overlap: int, by: tuple[str, ...] = ("source", "heading")) -> DataFrame:
    """Join neighbouring chunks by newline after cutting the text a chunk repeats from the last one.

    A section is part of one document, so a group is bounded by the document.
    """
    order = Window.partitionBy(*by).orderBy("chunk_index")
    cut = overlap_length(F.lag("content").over(order), F.col("content"), max_overlap) if max_overlap > 0 else F.lit(0)
    trimmed = F.substr(F.col("content"), F.col("_cut") + 1)
    return (
        chunks.select(*by, "chunk_index", "content", cut.alias("_cut"))
        .select(*by, "chunk_index", trimmed.alias("_text"))
        .groupBy(*by)
        .agg(
            F.array_sort(F.collect_list(F.struct("chunk_index", "_text"))).alias("_rows"),
            F.count("*").alias("chunks"),
        )
        .select(
            *by,
            F.array_join(F.filter(F.col("_rows")["_text"], nonblank), "\n").alias("body"),
            "chunks",
        )
    )


def heading_index(chunks: DataFrame) -> DataFrame:
    """``(source, heading, first, last, chunks)``: which chunks a heading of a document spans; no text is read."""
    return chunks.groupBy("source", F.coalesce("heading", F.lit("")).alias("heading")).agg(
        F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"), F.count("*").alias("chunks")
    )


def heading_hints(chunks: DataFrame) -> DataFrame:
    """Per source the headings in first-seen order: a joined line of at most 12, and their number."""
    return _hints_of(heading_index(chunks))


def _hints_of(index: DataFrame) -> DataFrame:
    return (
        index.where("heading <> ''")
        .groupBy("source")
        .agg(F.array_sort(F.collect_list(F.struct("first", "heading"))).alias("_rows"))
        .select("source", F.col("_rows")["heading"].alias("_all"))
        .select("source", hint_line(F.col("_all")).alias("hint"), F.size("_all").cast("long").alias("headings"))
    )


def hint_line(items: Column) -> Column:
    """The first 12 items in one line, with the total when more exist."""
    shown = F.array_join(F.slice(items, 1, HINT_ITEMS), HINT_SEPARATOR)
    tail = F.concat(F.lit("…（共 "), F.size(items), F.lit(" 项）"))
    return F.when(F.size(items) > HINT_ITEMS, F.concat(shown, tail)).otherwise(shown)


def document_hint(chunks: DataFrame) -> DataFrame:
    """The first 12 document names, for requests that name an unknown one."""
    names = chunks.where(F.coalesce("source", F.lit("")) != "").select("source").distinct()
    total = names.agg(F.count("*").alias("n")).first()["n"]
    first = names.orderBy("source").limit(HINT_ITEMS)  # the hint shows no more
    joined = first.agg(F.array_join(F.array_sort(F.collect_list("source")), HINT_SEPARATOR).alias("hint"))
    if total > HINT_ITEMS:
        joined = joined.select(F.concat("hint", F.lit(f"…（共 {total} 项）")).alias("hint"))
    return joined


def expand_section(requests: DataFrame, chunks: DataFrame, max_overlap: int = 50, index: DataFrame | None = None) -> DataFrame:
    """The stitched section a request names, with ``status``.

    ``exact``: the heading matches; ``partial``: headings of that document contain it, ignoring
    case; ``no_section``: a miss, with the headings as hint; ``no_document``: unknown document, with the
    documents as hint. Headings are settled on the :func:`heading_index` (a stored one may be given); texts
    are read of the sections that were found only, and equal requests are one.
    """
    asked = requests.select(
        "request_id", strip("source").alias("source"), F.coalesce(strip("heading"), F.lit("")).alias("section")
    )
    pairs = asked.select("source", "section").distinct()
    sources, _ = send_small(pairs.select("source").distinct())
    # A few rows per document that is asked for, used by every step below.
    index = materialise((heading_index(chunks) if index is None else index).join(sources, "source", "left_semi"))
    named = pairs.where("section <> ''")
    exact = named.join(index.withColumn("section", F.col("heading")), ["source", "section"])
    rest = named.join(exact.select("source", "section"), ["source", "section"], "left_anti")
    partial = rest.join(index, "source").where(F.contains(F.lower("heading"), F.lower("section")))
    columns = ["source", "section", "heading", "first"]
    chosen = exact.select(*columns, F.lit("exact").alias("status")).unionByName(partial.select(*columns, F.lit("partial").alias("status")))
    chosen = materialise(chosen)
    wanted, _ = send_small(chosen.select("source", "section", "heading"))
    body = chunks.select("source", "chunk_index", F.coalesce("heading", F.lit("")).alias("heading"), "content")
    bodies = stitch_section(body.join(wanted, ["source", "heading"]), max_overlap, by=("source", "section"))
    heads = chosen.groupBy("source", "section").agg(F.min_by("heading", "first").alias("heading"), F.min("status").alias("status"))
    known = index.select("source").distinct().withColumn("_known", F.lit(True))
    found = pairs.join(known, "source", "left").join(heads, ["source", "section"], "left")
    found = found.join(bodies, ["source", "section"], "left").join(_hints_of(index), "source", "left")
    unknown = (F.col("source") == "") | F.col("_known").isNull()
    status = F.when(unknown, "no_document").otherwise(F.coalesce("status", F.lit("no_section")))
    found = found.select(
        "source",
        "section",
        status.alias("status"),
        F.when(F.col("status").isNotNull(), F.coalesce(F.nullif("heading", F.lit("")), F.lit(UNTITLED))).alias("heading"),
        F.coalesce("chunks", F.lit(0)).alias("chunks"),
        "body",
        F.when(F.col("status").isNull(), F.col("hint")).alias("hint"),
    )
    rows = asked.join(with_document_hint(found, chunks), ["source", "section"])
    hint = F.when(F.col("source") != "", F.col("hint"))
    return rows.select("request_id", "source", "section", "status", "heading", "chunks", "body", hint.alias("hint"))


# ---------------------------------------------------------------- packing


def pack_contexts(hits: DataFrame, budget: int = PAYLOAD_TOKENS, by: tuple[str, ...] = ("query_id",), order: str = "rank", text: str = "content") -> DataFrame:
    """Whole items in order while they fit the token budget; stop at the first that does not.

    When the very first does not fit it is kept, cut to what is left after its label. Every row
    carries ``truncated``: whether anything of its group was left out or cut.
    """
    window = Window.partitionBy(*by).orderBy(order)
    label = estimate_tokens(label_line("source", "heading")) + 1
    measured = hits.withColumn("_label", label).withColumn("_cost", estimate_tokens(text) + F.col("_label"))
    running = measured.withColumns(
        {
            "_used": F.sum("_cost").over(window.rowsBetween(Window.unboundedPreceding, 0)),
            "_place": F.row_number().over(window),
            "_all": F.sum("_cost").over(Window.partitionBy(*by)),
        }
    )
    fits = F.col("_used") <= budget
    cut = (F.col("_place") == 1) & ~fits & (F.col("_label") < budget)
    return (
        running.where(fits | cut)
        .withColumn(text, F.when(fits, F.col(text)).otherwise(truncate_tokens(text, F.lit(budget) - F.col("_label"))))
        .withColumn("truncated", F.col("_all") > budget)
        .drop("_label", "_cost", "_used", "_place", "_all")
    )


def render_contexts(items: DataFrame, by: tuple[str, ...] = ("query_id",), order: str = "rank", text: str = "content") -> DataFrame:
    """One text per key: a locator line and the text of every item, joined by a rule."""
    piece = F.concat(label_line("source", "heading"), F.lit("\n"), F.col(text))
    return (
        items.groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("t")))).alias("_rows"))
        .select(*by, F.array_join(F.col("_rows")["t"], RULE).alias("rendered"))
    )


def confidence_flag(hits: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """``(query_id, top_rerank_score, low_confidence)``; only a rerank score can be low. Nothing is filtered."""
    top = hits.where(F.col("rank") == 1)
    low = (F.col("score_type") == "rerank") & (F.col("rerank_score") < threshold)
    return top.select(
        "query_id", F.col("rerank_score").alias("top_rerank_score"), F.coalesce(low, F.lit(False)).alias("low_confidence")
    )


def lookup_status(results: DataFrame) -> DataFrame:
    """Results per tool and state; failed, empty and ok are never merged."""
    state = F.when(~F.col("ok"), "failed").when(F.col("empty"), "empty").otherwise("ok")
    return results.groupBy("tool", state.alias("status")).agg(
        F.count("*").alias("results"), F.count_if(F.col("truncated")).alias("truncated")
    )


def dedupe_contexts(contexts: DataFrame) -> DataFrame:
    """First occurrence of each (source, heading, text) within a trace."""
    return contexts.groupBy("trace_id", "source", "heading", "text").agg(F.min("seq").alias("seq"))


# ---------------------------------------------------------------- prompts


def _ordered_blocks(hits: DataFrame) -> DataFrame:
    block = F.concat(
        F.lit(BLOCK_LABEL[0]),
        F.col("rank"),
        F.lit(BLOCK_LABEL[1]),
        citation("source", "heading"),
        F.lit(BLOCK_LABEL[2]),
        F.col("content"),
    )
    return (
        hits.groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("_rows"))
        .select("query_id", F.array_join(F.col("_rows")["block"], RULE).alias("_context"))
    )


def build_prompts(queries: DataFrame, hits: DataFrame, history_limit: int = 10) -> DataFrame:
    """``(query_id, messages)``: system text with numbered, cited contexts, history, question.

    The result is the input table of a batch inference job.
    """
    system = F.concat(
        F.lit(SYSTEM_BASE + "\n\n"),
        F.when(F.col("_context").isNull(), F.lit(SYSTEM_NO_HITS)).otherwise(
            F.concat(F.lit(SYSTEM_WITH_HITS), F.col("_context"))
        ),
    )

    def message(role: str, content: Column) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))

    past = (
        sanitize_history(F.col("history"), history_limit)
        if "history" in queries.columns
        else F.array().cast("array<struct<role:string,content:string>>")
    )
    return queries.join(_ordered_blocks(hits), "query_id", "left").select(
        "query_id", F.concat(message("system", system), past, message("user", F.col("question"))).alias("messages")
    )


def prompt_token_estimate(messages: Column | str) -> Column:
    """Sum of the token estimates of all message contents."""
    value = F.col(messages) if isinstance(messages, str) else messages
    return F.aggregate(value, F.lit(0).cast("long"), lambda acc, m: acc + estimate_tokens(m["content"]))


def citation_footer(hits: DataFrame) -> DataFrame:
    """Distinct citations per question in rank order, as the footer line."""
    return (
        hits.groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", citation("source", "heading").alias("c")))).alias("_rows"))
        .select(
            "query_id",
            F.concat(F.lit(FOOTER), F.array_join(F.array_distinct(F.col("_rows")["c"]), FOOTER_SEPARATOR)).alias("footer"),
        )
    )
