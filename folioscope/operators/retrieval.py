"""A table of questions against a table of chunks: cosine, BM25, fusion, rerank.

Every function takes and returns DataFrames keyed by ``query_id`` and ``chunk_id``. Scores are
rounded to nine digits before they are compared, then ties fall to ``chunk_id``: the order does
not depend on how rows were spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.memory import giving_back
from folioscope.functions.text import citation, tokenize_bigram, with_heading
from folioscope.operators.scoring import RANK_DIGITS, Bm25Best, CosineBest, WeightedWords
from folioscope.session import materialise

# Fixed values of the ranking function and of the fusion.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
RRF_K = 60

# Size bounds for what may be sent to every executor.
BROADCAST_ROWS = 1_000_000
BROADCAST_VECTOR_BYTES = 64 << 20
WORD_BYTES = 64
#: Words or vector numbers that a task looks at at once.
PIECE_VALUES = 1 << 18
SALTS = 32


# ---------------------------------------------------------------- tokenizers

_TOKENIZERS: dict[str, Callable[[Column], Column]] = {"bigram": tokenize_bigram}
# Fixed value: the dictionary tokenizer that falls back to bigrams when nothing provides it.
DICTIONARY_TOKENIZER = "jieba"


def register_tokenizer(name: str, build: Callable[[Column], Column]) -> None:
    """Add a tokenizer: a function from a text column to an ``array<string>`` column."""
    _TOKENIZERS[name.lower()] = build


def get_tokenizer(name: str | None) -> Callable[[Column], Column]:
    """Tokenizer by name; a missing dictionary one falls back to bigrams, other names are errors."""
    key = (name or DICTIONARY_TOKENIZER).lower()
    if key in _TOKENIZERS:
        return _TOKENIZERS[key]
    if key == DICTIONARY_TOKENIZER:
        return tokenize_bigram
    raise ValueError(f"unknown tokenizer {name!r}, choose from {sorted({*_TOKENIZERS, DICTIONARY_TOKENIZER})}")


# ---------------------------------------------------------------- helpers


def send_small(df: DataFrame, limit: int = BROADCAST_ROWS, at_most: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` marked for broadcast when it holds at most ``limit`` rows, and whether it does.

    ``at_most`` is a bound the caller knows; without it the rows are counted, up to the limit.
    """
    small = (df.limit(limit + 1).count() if at_most is None else at_most) <= limit
    return (F.broadcast(df) if small else df), small


def top_ranked(df: DataFrame, limit: int, order: list[Column], by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Keep the first ``limit`` rows per key with their ``rank``; trimmed per task before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= int(limit))


# ---------------------------------------------------------------- BM25


@dataclass(frozen=True)
class Bm25Index:
    """``terms(term, df, idf)``, the corpus numbers, and the chunks the postings are read from."""

    chunks: DataFrame
    terms: DataFrame
    n_chunks: int
    n_terms: int
    avgdl: float
    mean_idf: float
    tokenizer: str


def _token_rows(chunks: DataFrame, tokenizer: str) -> DataFrame:
    tokens = get_tokenizer(tokenizer)(with_heading("heading", "content"))
    # The length is a column of its own before any explode: exploding next to an expression on
    # the whole array would copy that array into every exploded row.
    return chunks.select("chunk_id", tokens.alias("_tokens")).withColumn("dl", F.size("_tokens"))


def bm25_postings(chunks: DataFrame, tokenizer: str = "bigram", vocabulary: DataFrame | None = None) -> DataFrame:
    """``(term, chunk_id, tf, dl)`` over heading plus body.

    With a ``vocabulary(term)`` small enough to be broadcast, other words are dropped while the
    text is scanned, before anything is shuffled.
    """
    words = _token_rows(chunks, tokenizer).select(
        "chunk_id", "dl", F.explode("_tokens").alias("term")
    )
    if vocabulary is not None:
        small, _ = send_small(vocabulary)
        words = words.join(small, "term", "left_semi")
    return words.groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf"))


def bm25_index(chunks: DataFrame, tokenizer: str = "bigram") -> Bm25Index:
    """Corpus statistics in one pass over the text; the only shuffle is on distinct words.

    The vocabulary table is checkpointed, everything else is a handful of numbers.
    """
    words = _token_rows(chunks, tokenizer).select(
        "dl", F.posexplode(F.array_distinct("_tokens")).alias("_at", "term")
    )
    # The chunk length rides on the first distinct word, so it is summed in the same pass.
    counted = materialise(
        words.groupBy("term").agg(
            F.count("*").alias("df"), F.sum(F.when(F.col("_at") == 0, F.col("dl")).otherwise(0)).alias("_tokens")
        )
    )
    n_chunks = chunks.count()
    raw = F.ln(F.lit(n_chunks) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    totals = counted.agg(
        F.count("*").alias("n_terms"), F.avg(raw).alias("mean_idf"), F.sum("_tokens").alias("tokens")
    ).first()
    mean_idf = totals["mean_idf"] or 0.0
    # A word in more than half of the chunks would weigh negative: it gets a share of the mean.
    idf = F.when(raw < 0, F.lit(BM25_EPSILON * mean_idf)).otherwise(raw)
    return Bm25Index(
        chunks,
        counted.select("term", "df", idf.alias("idf")),
        n_chunks,
        totals["n_terms"],
        (totals["tokens"] or 0) / max(1, n_chunks),
        mean_idf,
        tokenizer,
    )


def query_terms(queries: DataFrame, tokenizer: str = "bigram") -> DataFrame:
    """``(query_id, term, qtf)`` with repeats counted."""
    return (
        queries.select("query_id", F.explode(get_tokenizer(tokenizer)(F.col("question"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def bm25_scores(queries: DataFrame, index: Bm25Index) -> DataFrame:
    """Positive ``(query_id, chunk_id, bm25_score)``; repeated query words count each time."""
    wanted = query_terms(queries, index.tokenizer)
    weighted = wanted.join(index.terms, "term").select("query_id", "term", "qtf", "idf")
    _, small = send_small(wanted)
    postings = bm25_postings(index.chunks, index.tokenizer, wanted.select("term").distinct())
    if small:
        # The question side is bounded: postings stay where their counts were made.
        pairs = postings.join(F.broadcast(weighted), "term")
    else:
        # A frequent term holds a large share of the postings; spread it over salted keys.
        # At most 100 x (mean distinct terms per chunk) terms can occur in 1% of the chunks.
        hot = index.terms.where(F.col("df") * 100 > index.n_chunks).select("term", F.lit(SALTS).alias("_salts"))
        hot, _ = send_small(hot)

        def salted(df: DataFrame, salt: Callable[[Column], Column]) -> DataFrame:
            width = F.coalesce(F.col("_salts"), F.lit(1))
            return df.join(hot, "term", "left").withColumn("_salt", salt(width)).drop("_salts")

        left = salted(postings, lambda w: F.pmod(F.xxhash64("chunk_id"), w).cast("int"))
        right = salted(weighted, lambda w: F.explode(F.sequence(F.lit(0), w - 1)))
        pairs = left.join(right, ["term", "_salt"])
    tf, dl = F.col("tf"), F.col("dl")
    gain = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / (index.avgdl or 1.0)))
    return (
        pairs.groupBy("query_id", "chunk_id")
        .agg(F.round(F.sum(F.col("qtf") * F.col("idf") * gain), RANK_DIGITS).alias("bm25_score"))
        .where(F.col("bm25_score") > 0)
    )


def bm25_search(queries: DataFrame, index: Bm25Index, limit: int, max_bytes: int = BROADCAST_VECTOR_BYTES) -> DataFrame:
    """The ``limit`` best chunks per question: ``(query_id, chunk_id, bm25_score, rank)``.

    The weighted question words travel to the chunks, in hashed blocks of at most ``max_bytes``.
    A task adds up the scores of its own chunks and emits its ``limit`` best per question, so
    neither postings nor (question, chunk) pairs are ever shuffled, however frequent a word is.
    """
    weighted = (
        query_terms(queries, index.tokenizer)
        .join(index.terms, "term")
        .select(F.col("query_id").cast("string").alias("query_id"), "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    )
    most = max(1, max_bytes // WORD_BYTES)
    rows = _token_rows(index.chunks, index.tokenizer).select(F.col("chunk_id").cast("string").alias("chunk_id"), "dl", "_tokens")
    first = weighted.limit(most + 1).toArrow()
    parts = [first]
    if first.num_rows > most:
        blocks = -(-(weighted.count() * WORD_BYTES) // max_bytes)
        parts = (weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow() for block in range(blocks))
    found = reduce(DataFrame.unionByName, [_block_bm25(part, rows, index.avgdl or 1.0, max(1, int(limit))) for part in parts])
    ranked = top_ranked(found, limit, [F.desc("bm25_score"), F.asc("chunk_id")])
    return ranked.withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType)).withColumn(
        "chunk_id", F.col("chunk_id").cast(index.chunks.schema["chunk_id"].dataType)
    )


def pieces(batches: Iterator[pa.RecordBatch], lists: str, values: int = PIECE_VALUES) -> Iterator[pa.RecordBatch]:
    """A task's batches in pieces whose lists hold about ``values`` values in all, one row at least.

    What a task works on then has one size, however many rows and long texts the engine puts into a batch.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(lists)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + values, "right")))
            yield batch.slice(low, high - low)
            low = high


def _block_bm25(asked: pa.Table, rows: DataFrame, avgdl: float, limit: int) -> DataFrame:
    words, names = (pc.dictionary_encode(asked.column(c).combine_chunks()) for c in ("term", "query_id"))
    parts = [x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (names, words)]
    sent = rows.sparkSession.sparkContext.broadcast(
        (names.dictionary.to_pylist(), words.dictionary, *parts, asked.column("weight").to_numpy())
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, question, word, weight = sent.value
        if not names:
            return
        table = WeightedWords(question, word, weight, len(names), len(known))
        best = Bm25Best(table, limit, BM25_K1 + 1)
        for batch in pieces(batches, "_tokens"):
            order = pc.array_sort_indices(batch.column("chunk_id"))
            batch = batch.take(order)
            dl = batch.column("dl").to_numpy()
            tokens = batch.column("_tokens")
            found = pc.index_in(tokens.flatten(), value_set=known)
            held = found.is_valid().to_numpy(zero_copy_only=False)
            found = found.drop_null().to_numpy().astype(np.int64)
            row = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)[held]
            keys, tf = np.unique(row * len(known) + found, return_counts=True)
            row, found = keys // len(known), keys % len(known)
            gain = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl[row] / avgdl))
            best.add(row, found, gain, np.array(batch.column("chunk_id").to_pylist(), dtype=np.str_))
        yield from best.best.batches(names, "bm25_score")

    return rows.mapInArrow(giving_back(search), "query_id string, chunk_id string, bm25_score double")


# ---------------------------------------------------------------- cosine


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    norms[norms == 0] = 1.0
    return matrix / norms[:, None]


def _as_matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.unique(column.value_lengths().to_numpy(zero_copy_only=False)) if len(column) else ()
    if len(sizes) > 1:
        raise ValueError(f"vectors of different sizes: {sizes.tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cosine_topk(queries: DataFrame, chunks: DataFrame, limit: int, max_bytes: int = BROADCAST_VECTOR_BYTES) -> DataFrame:
    """Exact ``(query_id, chunk_id, similarity, rank)`` for ``(query_id, vector)`` x ``(chunk_id, vector)``.

    Chunks are read once and never shuffled: each task multiplies its batches with the question
    matrix and emits only its own ``limit`` best rows per question. When the question matrix is
    over ``max_bytes`` it is cut into hashed blocks, one pass over the chunks each.
    """
    limit = max(1, int(limit))
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector").where("vector is not null")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    blocks = max(1, -(-(size["n"] * (size["dim"] or 1) * 8) // max_bytes))
    found = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        local = _block_topk(part, chunks, limit)
        found = local if found is None else found.unionByName(local)
    ranked = top_ranked(found, limit, [F.desc("similarity"), F.asc("chunk_id")])
    key = queries.schema["query_id"].dataType
    kind = chunks.schema["chunk_id"].dataType
    return ranked.withColumn("query_id", F.col("query_id").cast(key)).withColumn("chunk_id", F.col("chunk_id").cast(kind))


def _block_topk(queries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    spark = queries.sparkSession
    asked = queries.toArrow()  # bounded by the caller
    keys = asked.column("query_id").to_pylist()
    matrix = _unit(_as_matrix(asked.column("vector"))) if keys else np.zeros((0, 1))
    sent = spark.sparkContext.broadcast((keys, matrix))
    schema = "query_id string, chunk_id string, similarity double"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted = sent.value
        if not names:
            return
        best = CosineBest(wanted, limit)
        for batch in pieces(batches, "vector"):
            batch = batch.take(pc.array_sort_indices(batch.column("chunk_id")))
            vectors = _unit(_as_matrix(batch.column("vector")))
            if vectors.shape[1] != wanted.shape[1]:
                raise ValueError(f"vectors of size {vectors.shape[1]} against questions of size {wanted.shape[1]}")
            best.add(vectors, np.array(batch.column("chunk_id").to_pylist(), dtype=np.str_))
        yield from best.best.batches(names, "similarity")

    rows = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "vector").where("vector is not null")
    return rows.mapInArrow(giving_back(search), schema)


def similarity_floor(hits: DataFrame, threshold: float) -> DataFrame:
    """Keep vector hits at or above a similarity; used on the vector leg only."""
    return hits.where(F.col("similarity") >= float(threshold))


# ---------------------------------------------------------------- fusion and rerank


def candidate_pool(top_k: int, pool: int, total: int, widened: bool) -> int:
    """How many candidates each leg returns."""
    return min(max(top_k, pool), total) if widened else min(top_k, total)


def merge_legs(vector: DataFrame, bm25: DataFrame) -> DataFrame:
    """Each candidate once with the score and rank of both legs; missing ones are NULL."""
    left = vector.select("query_id", "chunk_id", "similarity", F.col("rank").alias("vector_rank"))
    right = bm25.select("query_id", "chunk_id", "bm25_score", F.col("rank").alias("bm25_rank"))
    return left.join(right, ["query_id", "chunk_id"], "full_outer")


def rrf(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Fuse any number of ``(query_id, chunk_id, rank)`` lists by summed reciprocal ranks."""
    union = rankings[0].select("query_id", "chunk_id", "rank")
    for ranking in rankings[1:]:
        union = union.unionByName(ranking.select("query_id", "chunk_id", "rank"))
    return union.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (F.col("rank") + k)).alias("rrf_score"))


def fused_score(k: int = RRF_K) -> Column:
    """The same score for a row of :func:`merge_legs`, without another shuffle."""
    return F.coalesce(1.0 / (F.col("vector_rank") + k), F.lit(0.0)) + F.coalesce(
        1.0 / (F.col("bm25_rank") + k), F.lit(0.0)
    )


def fused_order() -> list[Column]:
    """Fusion score, then vector hits in their order, then the id."""
    return [
        F.desc(F.round("rrf_score", RANK_DIGITS)),
        F.asc_nulls_last("vector_rank"),
        F.asc("chunk_id"),
    ]


def lexical_overlap(question: Column, text: Column) -> Column:
    """Share of the distinct question tokens that occur in the text; 0 without tokens."""
    wanted = F.array_distinct(tokenize_bigram(question))
    shared = F.size(F.array_intersect(wanted, tokenize_bigram(text)))
    return F.when(F.size(wanted) > 0, shared / F.size(wanted)).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_overlap, threshold: float | None = None) -> DataFrame:
    """Score ``(question, content)`` pairs of the pool and rank by the score.

    ``scorer`` builds a column: :func:`lexical_overlap`, or a user ``pandas_udf`` over pairs.
    The heading is not part of the scored text.
    """
    scored = candidates.withColumn("rerank_score", scorer(F.col("question"), F.col("content")).cast("double"))
    return rerank_floor(scored, threshold)


def rerank_floor(hits: DataFrame, threshold: float | None) -> DataFrame:
    """Drop hits under a rerank score; no threshold keeps all, NULL counts as 0."""
    if threshold is None:
        return hits
    return hits.where(F.coalesce("rerank_score", F.lit(0.0)) >= float(threshold))


def backfill_candidates(candidates: DataFrame, chunks: DataFrame, at_most: int | None = None) -> DataFrame:
    """Attach source, heading and text; chunks are filtered in place when the candidates are few.

    ``at_most`` bounds the number of candidates: questions times hits asked per question.
    """
    small, _ = send_small(candidates, at_most=at_most)
    return chunks.select("chunk_id", "source", "heading", "content").join(small, "chunk_id")


def finalise(hits: DataFrame, top_k: int, score: str, score_type: str, order: list[Column]) -> DataFrame:
    """Cut to ``top_k`` and name the score that decided the order."""
    ranked = top_ranked(hits, top_k, order)
    return ranked.withColumns(
        {
            "score": F.coalesce(F.col(score), F.lit(0.0)),
            "score_type": F.lit(score_type),
            "citation": citation("source", "heading"),
        }
    )
