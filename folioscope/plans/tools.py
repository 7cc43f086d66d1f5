"""The three lookups as batch functions over request tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import nonblank, strip
from folioscope.operators import context as K
from folioscope.operators.embedding import Embedder
from folioscope.plans.retrieve import RetrieveOptions, retrieve

SMALLEST_BUDGET = 100


def _budget(tokens: int) -> int:
    return max(SMALLEST_BUDGET, int(tokens))


def search_docs(
    requests: DataFrame,
    chunks: DataFrame,
    embedder: Embedder,
    options: RetrieveOptions = RetrieveOptions(hybrid=True, rerank=True),
    budget: int = K.PAYLOAD_TOKENS,
    threshold: float = K.LOW_CONFIDENCE,
) -> DataFrame:
    """Per request: status, hits, the packed text, whether it was cut, and the confidence flag.

    A blank question fails; a question without hits is empty, which is not a failure.
    """
    asked = requests.select("query_id", strip("question").alias("question"))
    hits = retrieve(asked.where(nonblank("question")), chunks, embedder, options)
    found = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    packed = K.pack_contexts(hits, _budget(budget))
    sizes = packed.groupBy("query_id").agg(F.count("*").alias("kept"), F.bool_or("truncated").alias("truncated"))
    return (
        asked.join(found, "query_id", "left")
        .join(sizes, "query_id", "left")
        .join(K.render_contexts(packed), "query_id", "left")
        .join(K.confidence_flag(hits, threshold), "query_id", "left")
        .select(
            "query_id",
            F.when(~nonblank("question"), "failed").when(F.col("hits").isNull(), "empty").otherwise("ok").alias("status"),
            F.coalesce("hits", F.lit(0)).alias("hits"),
            F.coalesce("kept", F.lit(0)).alias("kept"),
            F.coalesce("truncated", F.col("hits").isNotNull()).alias("truncated"),
            "rendered",
            "top_rerank_score",
            F.coalesce("low_confidence", F.lit(False)).alias("low_confidence"),
        )
    )


def expand_section(requests: DataFrame, chunks: DataFrame, max_overlap: int = 50, budget: int = K.EXPAND_TOKENS) -> DataFrame:
    """:func:`folioscope.operators.context.expand_section` with the body cut to a token budget.

    A heading that takes the whole budget leaves an empty body, which counts as cut.
    """
    sections = K.expand_section(requests, chunks, max_overlap)
    found = sections.where("body is not null").select(
        "request_id", F.lit(1).alias("rank"), "source", "heading", F.col("body").alias("content")
    )
    packed = K.pack_contexts(found, max(_budget(K.PAYLOAD_TOKENS), budget), by=("request_id",))
    has_body = F.col("body").isNotNull()
    return sections.join(packed.select("request_id", F.col("content").alias("_kept"), "truncated"), "request_id", "left").withColumns(
        {"body": F.coalesce("_kept", F.when(has_body, "")), "truncated": F.coalesce("truncated", F.when(has_body, True))}
    ).drop("_kept")


def find_literal(requests: DataFrame, chunks: DataFrame, budget: int = K.PAYLOAD_TOKENS) -> DataFrame:
    """:func:`folioscope.operators.context.literal_lookup` with the shown hits packed and rendered."""
    status = K.literal_lookup(requests, chunks)
    hits = K.find_literal(requests.withColumn("pattern", strip("pattern")).where(nonblank("pattern")), chunks)
    packed = K.pack_contexts(hits, _budget(budget), by=("request_id",))
    cut = packed.groupBy("request_id").agg(F.bool_or("truncated").alias("_cut"))
    return (
        status.join(K.render_contexts(packed, by=("request_id",)), "request_id", "left")
        .join(cut, "request_id", "left")
        .withColumn("truncated", F.coalesce("_cut", F.lit(False)) | (F.col("shown") < F.col("total")))
        .drop("_cut")
    )
