"""Whole retrieval runs: one configuration, or the four switch settings side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import citation
from folioscope.operators import retrieval as R
from folioscope.operators.embedding import Embedder

# The switch settings that are compared, as (fusion, rerank).
COMBOS = {
    "baseline": (False, False),
    "hybrid": (True, False),
    "rerank": (False, True),
    "hybrid+rerank": (True, True),
}


@dataclass(frozen=True)
class RetrieveOptions:
    """Switches and sizes of a run."""

    top_k: int = 5
    candidate_pool_size: int = 20
    hybrid: bool = False
    rerank: bool = False
    min_similarity: float = 0.2
    rrf_k: int = R.RRF_K
    min_rerank_score: float | None = None
    tokenizer: str = "bigram"
    scorer: Callable[[Column, Column], Column] = R.lexical_overlap


def _vector_leg(queries: DataFrame, chunks: DataFrame, embedder: Embedder, pool: int, options: RetrieveOptions) -> DataFrame:
    asked = queries.select("query_id", embedder.query(F.col("question")).alias("vector"))
    return R.similarity_floor(R.cosine_topk(asked, chunks, pool), options.min_similarity)


def _legs(queries: DataFrame, chunks: DataFrame, embedder: Embedder, pool: int, options: RetrieveOptions) -> DataFrame:
    """Candidates of the legs that are switched on; the other branch is not in the plan."""
    vector = _vector_leg(queries, chunks, embedder, pool, options)
    if options.hybrid:
        bm25 = R.bm25_search(queries, R.bm25_index(chunks, options.tokenizer), pool)
        merged = R.merge_legs(vector, bm25)
    else:
        merged = vector.select(
            "query_id",
            "chunk_id",
            "similarity",
            F.col("rank").alias("vector_rank"),
            F.lit(None).cast("double").alias("bm25_score"),
            F.lit(None).cast("int").alias("bm25_rank"),
        )
    return merged.withColumn("rrf_score", R.fused_score(options.rrf_k) if options.hybrid else F.lit(None).cast("double"))


def retrieve(queries: DataFrame, chunks: DataFrame, embedder: Embedder, options: RetrieveOptions = RetrieveOptions()) -> DataFrame:
    """Ranked hits for ``queries(query_id, question)`` over ``chunks`` with vectors."""
    return retrieve_with_diagnostics(queries, chunks, embedder, options)[0]


def retrieve_with_diagnostics(
    queries: DataFrame, chunks: DataFrame, embedder: Embedder, options: RetrieveOptions = RetrieveOptions()
) -> tuple[DataFrame, DataFrame]:
    """Hits, and one row per question with the switches and the counts of every stage."""
    total, asking = chunks.count(), queries.count()
    top_k = max(1, int(options.top_k))
    widened = options.hybrid or options.rerank
    pool = R.candidate_pool(top_k, options.candidate_pool_size, total, widened)
    merged = _legs(queries, chunks, embedder, pool, options)
    order = R.fused_order() if options.hybrid else [F.asc("vector_rank")]
    score, score_type = ("rrf_score", "rrf") if options.hybrid else ("similarity", "cosine")
    if options.rerank:
        pooled = R.top_ranked(merged, pool, order).withColumnRenamed("rank", "pool_rank")
        asked = queries.select("query_id", "question")
        staged = R.rerank(
            R.backfill_candidates(pooled, chunks, asking * pool).join(asked, "query_id"), options.scorer, options.min_rerank_score
        )
        order = [F.desc(F.round("rerank_score", R.RANK_DIGITS)), F.asc("pool_rank")]
        hits = R.finalise(staged, top_k, "rerank_score", "rerank", order)
    else:
        staged = None
        cut = R.top_ranked(merged, top_k, order).drop("rank")
        hits = R.finalise(
            R.backfill_candidates(cut, chunks, asking * top_k).withColumn("rerank_score", F.lit(None).cast("double")),
            top_k,
            score,
            score_type,
            order,
        )
    hits = hits.select(
        "query_id",
        "rank",
        "chunk_id",
        "source",
        "heading",
        "content",
        "similarity",
        "bm25_score",
        "rrf_score",
        "rerank_score",
        "score",
        "score_type",
        "citation",
    )
    return hits, diagnostics(queries, merged, staged, hits, total, pool, top_k, options)


def diagnostics(
    queries: DataFrame,
    merged: DataFrame,
    reranked: DataFrame | None,
    hits: DataFrame,
    total: int,
    pool: int,
    top_k: int,
    options: RetrieveOptions,
) -> DataFrame:
    """Per question: corpus size, pool, counts per stage, switches. Questions without hits stay."""
    legs = merged.groupBy("query_id").agg(
        F.count("vector_rank").alias("vector_hits"),
        F.count("bm25_rank").alias("bm25_hits"),
        F.count("*").alias("fused_candidates"),
    )
    returned = hits.groupBy("query_id").agg(F.count("*").alias("returned"))
    out = queries.select("query_id").join(legs, "query_id", "left").join(returned, "query_id", "left")
    if reranked is not None:
        out = out.join(
            reranked.groupBy("query_id").agg(F.count("*").alias("reranked_candidates")), "query_id", "left"
        )
    else:
        out = out.withColumn("reranked_candidates", F.lit(None).cast("long"))
    zero = F.lit(0)
    return out.select(
        "query_id",
        F.lit(total).cast("long").alias("corpus_size"),
        F.lit(pool).cast("long").alias("candidate_pool_size"),
        F.coalesce("vector_hits", zero).alias("vector_hits"),
        (F.coalesce("bm25_hits", zero) if options.hybrid else F.lit(None).cast("long")).alias("bm25_hits"),
        F.coalesce("fused_candidates", zero).alias("fused_candidates"),
        (F.coalesce("reranked_candidates", zero) if options.rerank else F.lit(None).cast("long")).alias(
            "reranked_candidates"
        ),
        F.coalesce("returned", zero).alias("returned"),
        F.lit(options.hybrid).alias("hybrid_search_enabled"),
        F.lit(options.rerank).alias("rerank_enabled"),
        F.lit(top_k).cast("long").alias("top_k"),
    )


def ablation(
    queries: DataFrame,
    chunks: DataFrame,
    embedder: Embedder,
    options: RetrieveOptions = RetrieveOptions(),
    combos: dict[str, tuple[bool, bool]] = COMBOS,
) -> DataFrame:
    """The same questions under every switch setting, each leg and each pair score computed once.

    A candidate row is copied to the settings it takes part in, then one window ranks all of them.
    """
    total = chunks.count()
    top_k = max(1, int(options.top_k))
    pool = R.candidate_pool(top_k, options.candidate_pool_size, total, True)
    merged = _legs(queries, chunks, embedder, pool, replace(options, hybrid=True))
    # At most two pools per question, so a question is a bounded group.
    fused = R.top_ranked(merged, 2 * pool, R.fused_order()).withColumnRenamed("rank", "fused_rank")
    texts = R.backfill_candidates(fused, chunks, queries.count() * 2 * pool).join(queries.select("query_id", "question"), "query_id")
    scored = texts.withColumn("_pair", options.scorer(F.col("question"), F.col("content")).cast("double"))
    floor = F.lit(True) if options.min_rerank_score is None else F.col("_pair") >= options.min_rerank_score
    none = F.lit(None).cast("double")

    def setting(name: str, hybrid: bool, rerank: bool) -> Column:
        base = F.col("fused_rank") if hybrid else F.col("vector_rank")
        takes_part = base.isNotNull() & ((base <= pool) if rerank else F.lit(True))
        if rerank:
            takes_part = takes_part & floor
        score = F.col("_pair") if rerank else F.col("rrf_score") if hybrid else F.col("similarity")
        return F.when(
            takes_part,
            F.struct(
                F.lit(name).alias("combo"),
                (F.round("_pair", R.RANK_DIGITS) if rerank else F.lit(0.0)).alias("first_key"),
                base.alias("second_key"),
                score.alias("score"),
                F.lit("rerank" if rerank else "rrf" if hybrid else "cosine").alias("score_type"),
                (F.col("_pair") if rerank else none).alias("rerank_score"),
                (F.col("rrf_score") if hybrid else none).alias("rrf_score"),
            ),
        )

    settings = F.array_compact(F.array(*[setting(n, h, r) for n, (h, r) in combos.items()]))
    rows = scored.select(
        "query_id", "chunk_id", "source", "heading", "content", "similarity", "bm25_score", F.explode(settings).alias("s")
    ).select("query_id", "chunk_id", "source", "heading", "content", "similarity", "bm25_score", "s.*")
    ranked = R.top_ranked(
        rows, top_k, [F.desc("first_key"), F.asc("second_key")], by=("combo", "query_id")
    ).drop("first_key", "second_key")
    return ranked.withColumn("citation", citation("source", "heading"))
