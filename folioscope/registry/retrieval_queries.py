"""Registered retrieval queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import chunking as C
from folioscope.operators import embedding as E
from folioscope.operators import evaluation as V
from folioscope.operators import retrieval as R
from folioscope.plans.retrieve import COMBOS, RetrieveOptions, ablation, retrieve, retrieve_with_diagnostics
from folioscope.registry.chunk_queries import CHUNKS_SQL
from folioscope.registry.derive import CORPUS_SQL, corpus, judged_questions, load, markdown, questions, spread

OPTIONS = RetrieveOptions()
EMBEDDER = E.get_embedder("hashing")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Corpus with hashed vectors of the body."""
    return corpus(spark, d).withColumn("vector", E.hash_embed("content"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("query_id", E.hash_embed("question").alias("vector"))


def bm25_terms(spark: SparkSession, d: str) -> DataFrame:
    index = R.bm25_index(corpus(spark, d))
    return index.terms.select("term", F.col("df").cast("long").alias("df"), F.round("idf", 4).alias("idf"))


def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_postings(corpus(spark, d)).select(
        "term", "chunk_id", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl")
    )


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = R.bm25_search(questions(spark, d), R.bm25_index(corpus(spark, d)), OPTIONS.candidate_pool_size)
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("bm25_score", 4).alias("bm25_score")
    )


def bm25_hits_mrr(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: best five documents per question, judged by the expected keyword."""
    chunks = corpus(spark, d)
    asked = judged_questions(spark, d)
    found = R.bm25_search(asked, R.bm25_index(chunks), OPTIONS.top_k)
    hits = R.backfill_candidates(found, chunks, asked.count() * OPTIONS.top_k)
    return V.score_retrieval(hits, asked).select(
        "query_id",
        "returned",
        "hit",
        F.round("reciprocal_rank", 4).alias("reciprocal_rank"),
        F.round("precision_at_k", 4).alias("precision_at_k"),
    )


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).select("chunk_id", F.posexplode("vector").alias("slot", "weight"))
    return rows.where("weight > 0").select(
        "chunk_id", F.col("slot").cast("long").alias("slot"), F.round("weight", 4).alias("weight")
    )


def vector_dims(spark: SparkSession, d: str) -> DataFrame:
    return E.validate_vectors(load(spark, d, "embeddings"), "embedding")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = R.cosine_topk(_asked(spark, d), _vectors(spark, d), OPTIONS.candidate_pool_size)
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("similarity", 4).alias("similarity")
    )


def label_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Vectors nearest to the mean vector of each label."""
    table = spread(load(spark, d, "embeddings"))
    means = (
        table.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("vector"))
    )
    hits = R.cosine_topk(
        means.select(F.col("label").alias("query_id"), "vector"),
        table.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector")),
        10,
    )
    return hits.select(
        F.col("query_id").cast("long").alias("label"),
        F.col("rank").cast("long").alias("rank"),
        F.col("chunk_id").cast("long").alias("vec_id"),
        F.round("similarity", 4).alias("similarity"),
    )


def similarity_floor(spark: SparkSession, d: str) -> DataFrame:
    hits = R.similarity_floor(R.cosine_topk(_asked(spark, d), _vectors(spark, d), 20), 0.8)
    return hits.groupBy("query_id").agg(F.count("*").alias("kept"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    chunks = corpus(spark, d)
    vector = R.cosine_topk(_asked(spark, d), _vectors(spark, d), 20)
    bm25 = R.bm25_search(questions(spark, d), R.bm25_index(chunks), 20)
    return R.rrf([vector, bm25]).select("query_id", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"))


def merge_legs(spark: SparkSession, d: str) -> DataFrame:
    chunks = corpus(spark, d)
    vector = R.cosine_topk(_asked(spark, d), _vectors(spark, d), 20)
    bm25 = R.bm25_search(questions(spark, d), R.bm25_index(chunks), 20)
    merged = R.merge_legs(vector, bm25)
    return merged.groupBy("query_id").agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("bm25_rank").isNull()).alias("vector_only"),
        F.count_if(F.col("vector_rank").isNull()).alias("bm25_only"),
    )


def backfill_candidates(spark: SparkSession, d: str) -> DataFrame:
    chunks = corpus(spark, d)
    bm25 = R.bm25_search(questions(spark, d), R.bm25_index(chunks), 20)
    return R.backfill_candidates(bm25, chunks, questions(spark, d).count() * 20).select(
        "query_id", "chunk_id", "source", "heading", F.length("content").cast("long").alias("chars")
    )


def lexical_rerank(spark: SparkSession, d: str) -> DataFrame:
    chunks = corpus(spark, d)
    asked = questions(spark, d)
    pool = R.bm25_search(asked, R.bm25_index(chunks), 20).withColumnRenamed("rank", "pool_rank")
    scored = R.rerank(R.backfill_candidates(pool, chunks, asked.count() * 20).join(asked, "query_id"), threshold=0.2)
    ranked = R.top_ranked(scored, 5, [F.desc(F.round("rerank_score", 9)), F.asc("pool_rank")])
    return ranked.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "chunk_id",
        F.round("rerank_score", 4).alias("rerank_score"),
    )


def tokenize_bigram(spark: SparkSession, d: str) -> DataFrame:
    tokens = R.get_tokenizer("jieba")(F.col("text"))  # falls back to bigrams
    return load(spark, d, "documents").select(
        "doc_id", F.size(tokens).cast("long").alias("tokens"), F.md5(F.array_join(tokens, " ").cast("binary")).alias("digest")
    )


def embed_column(spark: SparkSession, d: str) -> DataFrame:
    """A user model behind the column hook: characters, words and letters e of the prefixed text."""

    def load_model():
        return lambda texts: [[len(t), t.count(" "), t.count("e")] for t in texts]

    rows = spread(load(spark, d, "documents").select("doc_id", "text"))
    return E.embed_column(rows, "text", load_model, prefix="passage: ").select(
        "doc_id", *[F.get("vector", i).cast("long").alias(n) for i, n in enumerate(["chars", "blanks", "es"])]
    )


def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    """A user service behind the batch hook, answering in reverse order."""

    def call(texts: list[str]) -> list[tuple[int, list[float]]]:
        return [(i, [float(len(t))]) for i, t in reversed(list(enumerate(texts)))]

    rows = spread(load(spark, d, "documents").select("doc_id", "text"))
    return E.embed_batches(rows, "doc_id", "text", call, batch=10).select(
        "doc_id", F.get("vector", 0).cast("long").alias("chars")
    )


def _flat_hits(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "chunk_id",
        "citation",
        "score_type",
        F.round("similarity", 4).alias("similarity"),
        F.round("bm25_score", 4).alias("bm25_score"),
        F.round("rrf_score", 6).alias("rrf_score"),
        F.round("rerank_score", 4).alias("rerank_score"),
        F.round("score", 4).alias("score"),
    )


def retrieve_hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    options = RetrieveOptions(hybrid=True, rerank=True)
    return _flat_hits(retrieve(questions(spark, d), _vectors(spark, d), EMBEDDER, options))


def retrieve_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _flat_hits(retrieve(questions(spark, d), _vectors(spark, d), EMBEDDER, RetrieveOptions(hybrid=True)))


def retrieve_chunks(spark: SparkSession, d: str) -> DataFrame:
    """From documents to answers: cut into chunks, embed them with their headings, search both legs, rerank."""
    chunks = E.embed_chunks(C.chunk_documents(markdown(spark, d)), EMBEDDER)
    return _flat_hits(retrieve(questions(spark, d), chunks, EMBEDDER, RetrieveOptions(hybrid=True, rerank=True)))


def retrieval_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    options = RetrieveOptions(hybrid=True, rerank=True)
    return retrieve_with_diagnostics(questions(spark, d), _vectors(spark, d), EMBEDDER, options)[1]


def _judged_ablation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked = judged_questions(spark, d)
    return ablation(asked, _vectors(spark, d), EMBEDDER, OPTIONS), asked


def ablation_scores(spark: SparkSession, d: str) -> DataFrame:
    hits, asked = _judged_ablation(spark, d)
    return V.score_retrieval(hits, asked, list(COMBOS)).select(
        "combo",
        "query_id",
        "returned",
        "hit",
        F.round("reciprocal_rank", 4).alias("reciprocal_rank"),
        F.round("precision_at_k", 4).alias("precision_at_k"),
    )


def ablation_summary(spark: SparkSession, d: str) -> DataFrame:
    hits, asked = _judged_ablation(spark, d)
    summary = V.sweep_summary(V.score_retrieval(hits, asked, list(COMBOS)))
    return summary.select(
        "combo", "questions", *[F.round(c, 4).alias(c) for c in summary.columns if c not in ("combo", "questions")]
    )


def source_hit(spark: SparkSession, d: str) -> DataFrame:
    hits, asked = _judged_ablation(spark, d)
    return V.source_hit(hits, asked, list(COMBOS))


# ---------------------------------------------------------------- SQL twins

WORD = "[\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}a-zA-Z0-9]+"

BM25_SQL = (
    CORPUS_SQL
    + f""",
tok AS (SELECT chunk_id, regexp_extract_all(lower(heading || chr(10) || content), '{WORD}') AS t FROM corpus),
post AS (SELECT chunk_id, term, any_value(dl) AS dl, count(*) AS tf
         FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
corp AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
rawidf AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw
           FROM post, corp GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rawidf) ELSE raw END AS idf FROM rawidf),
qt AS (SELECT query_id, term, count(*) AS qtf FROM
        (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, chunk_id,
         round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS bm25_score
       FROM qt JOIN idf USING (term) JOIN post USING (term), corp GROUP BY ALL HAVING bm25_score > 0),
bleg AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS bm25_rank
         FROM bm QUALIFY bm25_rank <= 20)"""
)


def _embed_sql(name: str, key: str, text: str, table: str) -> str:
    return f""",
{name}_c AS (SELECT {key} AS id, string_split(lower({text}), '') AS c FROM {table}),
{name}_b AS (SELECT id, c[i] || c[i + 1] AS b, count(*) AS n
  FROM (SELECT id, c, unnest(range(1, len(c))) AS i FROM {name}_c) GROUP BY ALL),
{name}_h AS (SELECT b, md5(b) AS h FROM (SELECT DISTINCT b FROM {name}_b) WHERE trim(b, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
{name}_s AS (SELECT id, CAST(('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2]) AS BIGINT) % 256 AS slot, sum(n) AS w
  FROM {name}_b JOIN {name}_h USING (b) GROUP BY ALL),
{name} AS (SELECT id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM {name}_s)"""


VECTORS_SQL = (
    CORPUS_SQL
    + _embed_sql("dv", "chunk_id", "content", "corpus")
    + _embed_sql("qv", "item_id", "text", "benchmark")
    + """,
sims AS (SELECT q.id AS query_id, d.id AS chunk_id, round(sum(q.weight * d.weight), 9) AS similarity
         FROM qv q JOIN dv d USING (slot) GROUP BY ALL),
vleg AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS vector_rank
         FROM sims QUALIFY vector_rank <= 20)"""
)

LEGS_SQL = (
    BM25_SQL
    + VECTORS_SQL[len(CORPUS_SQL) :]
    + f""",
merged AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.chunk_id, b.chunk_id) AS chunk_id,
         similarity, vector_rank, bm25_score, bm25_rank,
         coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + bm25_rank), 0) AS rrf_score
       FROM (SELECT * FROM vleg WHERE similarity >= 0.2) v FULL OUTER JOIN bleg b
         ON v.query_id = b.query_id AND v.chunk_id = b.chunk_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, vector_rank NULLS LAST, chunk_id) AS fused_rank
          FROM merged),
qset AS (SELECT item_id AS query_id, text AS question, list_distinct(regexp_extract_all(lower(text), '{WORD}')) AS words,
          substr(text, 21, 60) AS keyword FROM benchmark),
pairs AS (SELECT f.*, c.source, c.heading, c.content, q.keyword,
            CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_intersect(words, list_distinct(regexp_extract_all(lower(c.content), '{WORD}')))) / len(words) END AS pair
          FROM fused f JOIN corpus c USING (chunk_id) JOIN qset q USING (query_id)),
combos AS (
  SELECT 'baseline' AS combo, *, 0.0 AS k1, vector_rank AS k2, similarity AS score, 'cosine' AS score_type FROM pairs WHERE vector_rank IS NOT NULL
  UNION ALL SELECT 'hybrid', *, 0.0, fused_rank, rrf_score, 'rrf' FROM pairs
  UNION ALL SELECT 'rerank', *, round(pair, 9), vector_rank, pair, 'rerank' FROM pairs WHERE vector_rank IS NOT NULL
  UNION ALL SELECT 'hybrid+rerank', *, round(pair, 9), fused_rank, pair, 'rerank' FROM pairs WHERE fused_rank <= 20),
ranked AS (SELECT *, row_number() OVER (PARTITION BY combo, query_id ORDER BY k1 DESC, k2) AS rank FROM combos QUALIFY rank <= 5),
scored AS (
  SELECT c.combo, q.query_id, count(r.chunk_id) AS returned,
         coalesce(bool_or(contains(r.content, q.keyword)), false) AS hit,
         coalesce(1.0 / min(CASE WHEN contains(r.content, q.keyword) THEN rank END), 0.0) AS reciprocal_rank,
         CASE WHEN count(r.chunk_id) = 0 THEN 0.0 ELSE count(*) FILTER (contains(r.content, q.keyword)) / count(r.chunk_id) END AS precision_at_k,
         coalesce(bool_or(r.source = 'doc' || q.query_id || '.md'), false) AS source_hit
  FROM (SELECT DISTINCT combo FROM combos) c CROSS JOIN qset q
    LEFT JOIN ranked r ON r.combo = c.combo AND r.query_id = q.query_id
  GROUP BY c.combo, q.query_id)"""
)

_HIT_COLUMNS = """query_id, rank, chunk_id, source || ' › ' || heading AS citation, score_type,
  round(similarity, 4) AS similarity, round(bm25_score, 4) AS bm25_score, round(rrf_score, 6) AS rrf_score"""

#: The legs over chunks of the Markdown corpus, whose vectors are those of heading and body.
CHUNK_LEGS_SQL = (
    CHUNKS_SQL
    + ", corpus AS MATERIALIZED (SELECT chunk_id, source, heading, content FROM chunks)"
    + LEGS_SQL[len(CORPUS_SQL) :].replace("string_split(lower(content), '')", "string_split(lower(CASE WHEN heading = '' THEN content ELSE heading || chr(10) || content END), '')")
)

QUERIES = {
    "tokenize_bigram": tokenize_bigram,
    "embed_column": embed_column,
    "embed_batches": embed_batches,
    "bm25_terms": bm25_terms,
    "bm25_postings": bm25_postings,
    "bm25_topk": bm25_topk,
    "bm25_hits_mrr": bm25_hits_mrr,
    "hash_embed": hash_embed,
    "vector_dims": vector_dims,
    "cosine_topk": cosine_topk,
    "label_neighbours": label_neighbours,
    "similarity_floor": similarity_floor,
    "rrf_fusion": rrf_fusion,
    "merge_legs": merge_legs,
    "backfill_candidates": backfill_candidates,
    "lexical_rerank": lexical_rerank,
    "retrieve_hybrid": retrieve_hybrid,
    "retrieve_chunks": retrieve_chunks,
    "retrieve_hybrid_rerank": retrieve_hybrid_rerank,
    "retrieval_diagnostics": retrieval_diagnostics,
    "ablation_scores": ablation_scores,
    "ablation_summary": ablation_summary,
    "source_hit": source_hit,
}

ORACLES = {
    "tokenize_bigram": f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents)
      SELECT doc_id, len(t) AS tokens, md5(array_to_string(t, ' ')) AS digest FROM t""",
    "embed_column": """SELECT doc_id, length(text) + 9 AS chars, length(text) - length(replace(text, ' ', '')) + 1 AS blanks,
      length(text) - length(replace(text, 'e', '')) + 1 AS es FROM documents""",
    "embed_batches": "SELECT doc_id, length(text) AS chars FROM documents",
    "bm25_terms": f"WITH {BM25_SQL} SELECT term, df, round(idf, 4) AS idf FROM idf",
    "bm25_postings": f"WITH {BM25_SQL} SELECT term, chunk_id, tf, dl FROM post",
    "bm25_topk": f"WITH {BM25_SQL} SELECT query_id, bm25_rank AS rank, chunk_id, round(bm25_score, 4) AS bm25_score FROM bleg",
    "bm25_hits_mrr": f"""WITH {BM25_SQL},
      h AS (SELECT b.*, contains(c.content, substr(q.text, 21, 60)) AS good
            FROM bleg b JOIN corpus c USING (chunk_id) JOIN benchmark q ON q.item_id = b.query_id WHERE bm25_rank <= 5)
      SELECT q.item_id AS query_id, count(h.chunk_id) AS returned, coalesce(bool_or(good), false) AS hit,
        round(coalesce(1.0 / min(CASE WHEN good THEN bm25_rank END), 0.0), 4) AS reciprocal_rank,
        round(CASE WHEN count(h.chunk_id) = 0 THEN 0.0 ELSE count(*) FILTER (good) / count(h.chunk_id) END, 4) AS precision_at_k
      FROM benchmark q LEFT JOIN h ON h.query_id = q.item_id GROUP BY q.item_id""",
    "hash_embed": f"WITH {VECTORS_SQL} SELECT id AS chunk_id, slot, round(weight, 4) AS weight FROM dv",
    "vector_dims": """SELECT CAST(len(embedding) AS BIGINT) AS dim, count(*) AS vectors,
        count(*) FILTER (abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) - 1) > 0.001) AS not_unit
      FROM embeddings GROUP BY len(embedding)""",
    "cosine_topk": f"WITH {VECTORS_SQL} SELECT query_id, vector_rank AS rank, chunk_id, round(similarity, 4) AS similarity FROM vleg",
    "label_neighbours": """WITH e AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
      m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
      mn AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label), en AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY vec_id),
      s AS (SELECT m.label, e.vec_id, round(sum(m.x * e.x) / any_value(mn.n * en.n), 9) AS similarity
            FROM m JOIN e USING (i) JOIN mn ON mn.label = m.label JOIN en ON en.vec_id = e.vec_id GROUP BY m.label, e.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, CAST(vec_id AS VARCHAR)) AS rank FROM s)
      SELECT CAST(label AS BIGINT) AS label, rank, vec_id, round(similarity, 4) AS similarity FROM r WHERE rank <= 10""",
    "similarity_floor": f"WITH {VECTORS_SQL} SELECT query_id, count(*) AS kept FROM vleg WHERE similarity >= 0.8 GROUP BY query_id",
    "rrf_fusion": f"""WITH {LEGS_SQL}, u AS (SELECT query_id, chunk_id, vector_rank AS r FROM vleg UNION ALL SELECT query_id, chunk_id, bm25_rank FROM bleg)
      SELECT query_id, chunk_id, round(sum(1.0 / (60 + r)), 6) AS rrf_score FROM u GROUP BY ALL""",
    "merge_legs": f"""WITH {LEGS_SQL} SELECT query_id, count(*) AS candidates, count(*) FILTER (bm25_rank IS NULL) AS vector_only,
      count(*) FILTER (vector_rank IS NULL) AS bm25_only FROM merged GROUP BY query_id""",
    "backfill_candidates": f"""WITH {BM25_SQL} SELECT query_id, chunk_id, source, heading, length(content) AS chars
      FROM bleg JOIN corpus USING (chunk_id)""",
    "lexical_rerank": f"""WITH {BM25_SQL}, p AS (SELECT b.query_id, b.chunk_id, bm25_rank, list_distinct(regexp_extract_all(lower(q.text), '{WORD}')) AS w,
        list_distinct(regexp_extract_all(lower(c.content), '{WORD}')) AS t
        FROM bleg b JOIN corpus c USING (chunk_id) JOIN benchmark q ON q.item_id = b.query_id),
      s AS (SELECT *, CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_intersect(w, t)) / len(w) END AS pair FROM p),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(pair, 9) DESC, bm25_rank) AS rank FROM s WHERE pair >= 0.2)
      SELECT query_id, rank, chunk_id, round(pair, 4) AS rerank_score FROM r WHERE rank <= 5""",
    "retrieve_hybrid": f"""WITH {LEGS_SQL} SELECT {_HIT_COLUMNS}, CAST(NULL AS DOUBLE) AS rerank_score, round(score, 4) AS score
      FROM ranked WHERE combo = 'hybrid'""",
    "retrieve_chunks": f"""WITH RECURSIVE {CHUNK_LEGS_SQL} SELECT {_HIT_COLUMNS}, round(pair, 4) AS rerank_score, round(score, 4) AS score
      FROM ranked WHERE combo = 'hybrid+rerank'""",
    "retrieve_hybrid_rerank": f"""WITH {LEGS_SQL} SELECT {_HIT_COLUMNS}, round(pair, 4) AS rerank_score, round(score, 4) AS score
      FROM ranked WHERE combo = 'hybrid+rerank'""",
    "retrieval_diagnostics": f"""WITH {LEGS_SQL}
      SELECT q.query_id, (SELECT count(*) FROM corpus) AS corpus_size, CAST(20 AS BIGINT) AS candidate_pool_size,
        (SELECT count(vector_rank) FROM merged m WHERE m.query_id = q.query_id) AS vector_hits,
        (SELECT count(bm25_rank) FROM merged m WHERE m.query_id = q.query_id) AS bm25_hits,
        (SELECT count(*) FROM merged m WHERE m.query_id = q.query_id) AS fused_candidates,
        (SELECT count(*) FROM combos m WHERE m.query_id = q.query_id AND combo = 'hybrid+rerank') AS reranked_candidates,
        (SELECT count(*) FROM ranked m WHERE m.query_id = q.query_id AND combo = 'hybrid+rerank') AS returned,
        true AS hybrid_search_enabled, true AS rerank_enabled, CAST(5 AS BIGINT) AS top_k FROM qset q""",
    "ablation_scores": f"""WITH {LEGS_SQL} SELECT combo, query_id, returned, hit, round(reciprocal_rank, 4) AS reciprocal_rank,
      round(precision_at_k, 4) AS precision_at_k FROM scored""",
    "ablation_summary": f"""WITH {LEGS_SQL}, t AS (SELECT combo, count(*) AS questions, avg(returned) AS avg_contexts, avg(CAST(hit AS INTEGER)) AS hit_rate,
        avg(reciprocal_rank) AS mrr, avg(precision_at_k) AS precision_at_k, avg(CASE WHEN reciprocal_rank = 1 THEN 1 ELSE 0 END) AS top1_rate
        FROM scored GROUP BY combo), b AS (SELECT mrr AS base FROM t WHERE combo = 'baseline')
      SELECT combo, questions, round(avg_contexts, 4) AS avg_contexts, round(hit_rate, 4) AS hit_rate, round(mrr, 4) AS mrr,
        round(precision_at_k, 4) AS precision_at_k, round(top1_rate, 4) AS top1_rate,
        round(CASE WHEN base <> 0 AND combo <> 'baseline' THEN mrr - base END, 4) AS mrr_delta,
        round(CASE WHEN base <> 0 AND combo <> 'baseline' THEN (mrr - base) / base * 100 END, 4) AS mrr_delta_pct FROM t, b""",
    "source_hit": f"WITH {LEGS_SQL} SELECT combo, query_id, source_hit FROM scored",
}
