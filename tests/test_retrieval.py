"""Ranking against plain-Python models."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions.text import tokenize_bigram
from folioscope.operators import embedding as E
from folioscope.operators import retrieval as R
from folioscope.plans.retrieve import COMBOS, RetrieveOptions, ablation, retrieve, retrieve_with_diagnostics

WORDS = ["超时", "设置", "timeout", "error", "retry", "日志", "the", "kubectl", "Pod", "é"]


def tokens_of(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r.x for r in df.select(tokenize_bigram("t").alias("x")).collect()]


def test_tokenizer_goldens(spark):
    assert tokens_of(spark, ["超时设置 REQUEST_TIMEOUT", "字", "カタカナ", "café über", "a超b", "", "--"]) == [
        ["超时", "时设", "设置", "request", "timeout"],
        ["字"],
        ["カタカナ"],
        ["caf", "ber"],
        ["a超", "超b"],
        [],
        [],
    ]


def test_tokenizer_registry():
    assert R.get_tokenizer(None) is tokenize_bigram
    assert R.get_tokenizer("JIEBA") is tokenize_bigram
    with pytest.raises(ValueError):
        R.get_tokenizer("nope")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    docs = [(f"c{i:02d}", "s.md", rng.choice(["", "the 设置"]), " ".join(rng.choices(WORDS, k=rng.randint(0, 30)))) for i in range(60)]
    asked = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))) for i in range(25)]
    return docs, asked


def model_bm25(spark, docs, asked):
    bodies = tokens_of(spark, [f"{h}\n{c}" if h else c for _, _, h, c in docs])
    n, avgdl = len(docs), sum(map(len, bodies)) / len(docs)
    df = Counter(t for b in bodies for t in set(b))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    assert any(v < 0 for v in raw.values())
    out = {}
    for (q, _), words in zip(asked, tokens_of(spark, [t for _, t in asked])):
        for (doc, *_), body in zip(docs, bodies):
            tf = Counter(body)
            score = sum(
                idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(body) / avgdl)) for w in words if tf[w]
            )
            if round(score, 9) > 0:
                out[q, doc] = round(score, 9)
    return out


def frames(spark, corpus):
    docs, asked = corpus
    return (
        spark.createDataFrame(docs, "chunk_id string, source string, heading string, content string"),
        spark.createDataFrame(asked, "query_id long, question string"),
    )


def top(scores, k):
    by_query = {}
    for (q, doc), s in scores.items():
        by_query.setdefault(q, []).append((-s, doc))
    return {(q, i + 1): doc for q, rows in by_query.items() for i, (_, doc) in enumerate(sorted(rows)[:k])}


@pytest.mark.parametrize("max_bytes", [1 << 20, 640])
def test_bm25_search(spark, corpus, max_bytes):
    chunks, asked = frames(spark, corpus)
    want = model_bm25(spark, *corpus)
    index = R.bm25_index(chunks)
    hits = R.bm25_search(asked, index, 7, max_bytes).collect()
    assert {(r.query_id, r.rank): r.chunk_id for r in hits} == top(want, 7)
    for r in hits:
        assert r.bm25_score == pytest.approx(want[r.query_id, r.chunk_id], abs=1e-8)


@pytest.mark.parametrize("limit", [R.BROADCAST_ROWS, 0])
def test_bm25_scores_broadcast_and_salted(spark, corpus, limit, monkeypatch):
    chunks, asked = frames(spark, corpus)
    if not limit:
        monkeypatch.setattr(R, "send_small", lambda df, *a, **k: (df, False))
    got = {(r.query_id, r.chunk_id): r.bm25_score for r in R.bm25_scores(asked, R.bm25_index(chunks)).collect()}
    want = model_bm25(spark, *corpus)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_bm25_same_for_any_partitioning(spark, corpus):
    chunks, asked = frames(spark, corpus)
    runs = [
        sorted(map(tuple, R.bm25_search(asked, R.bm25_index(chunks.repartition(n)), 5).collect())) for n in (1, 4, 50)
    ]
    assert runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize("max_bytes", [1 << 20, 300])
def test_cosine_topk(spark, max_bytes):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    vectors = np.vstack([base, base[:10], np.zeros((1, 8))])  # exact copies tie, a zero vector is allowed
    asked = rng.normal(size=(9, 8))
    chunks = spark.createDataFrame([(f"v{i:02d}", v.tolist()) for i, v in enumerate(vectors)], "chunk_id string, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vector array<double>")
    hits = R.cosine_topk(queries, chunks.repartition(5), 6, max_bytes).collect()
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    for q, v in enumerate(asked):
        sims = np.round(unit @ (v / np.linalg.norm(v)), 9)
        want = sorted(range(len(vectors)), key=lambda i: (-sims[i], f"v{i:02d}"))[:6]
        assert [r.chunk_id for r in sorted(hits, key=lambda r: r.rank) if r.query_id == q] == [f"v{i:02d}" for i in want]


def test_rrf_does_not_depend_on_list_order(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id long, chunk_id string, rank int")
    rows = [{r.chunk_id: round(r.rrf_score, 12) for r in R.rrf(x).collect()} for x in ([a, b], [b, a])]
    assert rows[0] == rows[1]
    assert rows[0]["y"] == pytest.approx(1 / 61 + 1 / 62)


def test_pool_rules():
    assert R.candidate_pool(5, 20, 100, True) == 20
    assert R.candidate_pool(30, 20, 100, True) == 30
    assert R.candidate_pool(5, 20, 3, True) == 3
    assert R.candidate_pool(5, 20, 100, False) == 5


def test_ablation_equals_single_runs(spark, corpus):
    chunks, asked = frames(spark, corpus)
    embedder = E.get_embedder("hashing", dim=64)
    stored = chunks.withColumn("vector", embedder.documents(F.col("content")))
    options = RetrieveOptions(top_k=4, candidate_pool_size=8)
    rows = ablation(asked, stored, embedder, options).collect()
    for name, (hybrid, rerank) in COMBOS.items():
        single = retrieve(asked, stored, embedder, RetrieveOptions(top_k=4, candidate_pool_size=8, hybrid=hybrid, rerank=rerank))
        got = sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9), r.score_type) for r in rows if r.combo == name)
        assert got == sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9), r.score_type) for r in single.collect())


def test_rerank_threshold_and_diagnostics(spark, corpus):
    chunks, asked = frames(spark, corpus)
    embedder = E.get_embedder("hashing")
    stored = chunks.withColumn("vector", embedder.documents(F.col("content")))
    options = RetrieveOptions(rerank=True, min_rerank_score=0.6)
    hits, facts = retrieve_with_diagnostics(asked, stored, embedder, options)
    assert all(r.rerank_score >= 0.6 for r in hits.collect())
    assert {r.query_id for r in facts.collect()} == {q for q, _ in corpus[1]}
    assert all(r.bm25_hits is None and r.corpus_size == 60 for r in facts.collect())


def test_hash_embedding_edges(spark):
    df = spark.createDataFrame([("",), ("   ",), ("ab",), ("aB",), ("超时",), ("x",)], "t string")
    rows = [r.v for r in df.select(E.hash_embed("t", 16).alias("v")).collect()]
    assert rows[0] == rows[1] == rows[5] == [1.0] + [0.0] * 15
    assert rows[2] == rows[3] and sum(rows[4]) == 1.0


def test_embed_batches_counts(spark):
    df = spark.createDataFrame([(i, "t" * i) for i in range(25)], "id long, text string")
    with pytest.raises(Exception, match="vectors"):
        E.embed_batches(df, "id", "text", lambda texts: [(0, [1.0])], 10).collect()
    with pytest.raises(ValueError):
        E.get_embedder("nope")


def test_vectors_of_mixed_sizes_are_an_error(spark):
    queries = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, vector array<double>")
    for sizes in ((2, 4), (2, 2)):
        chunks = spark.createDataFrame([(i, [1.0] * n) for i, n in enumerate(sizes)], "chunk_id long, vector array<double>")
        with pytest.raises(Exception, match="size"):
            R.cosine_topk(queries, chunks.coalesce(1), 3).collect()


def test_cosine_keeps_the_type_of_ids(spark):
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>")
    chunks = spark.createDataFrame([(3, [1.0, 0.0]), (4, [0.0, 1.0])], "chunk_id long, vector array<double>")
    found = R.cosine_topk(queries, chunks, 1)
    assert dict(found.dtypes)["chunk_id"] == "bigint" and (found.first().query_id, found.first().chunk_id) == (7, 3)


def test_tasks_work_on_pieces_of_one_size(spark):
    """A batch of many rows or long texts is cut by its words; every row comes once, in order."""
    import pyarrow as pa

    lists = [["w"] * n for n in (3, 0, 9, 50, 1, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(8)]), pa.array(lists, pa.list_(pa.string()))], names=["chunk_id", "_tokens"])
    parts = list(R.pieces(iter([batch, batch.slice(0, 0), batch.slice(2, 3)]), "_tokens", 10))
    assert [p.column("chunk_id").to_pylist() for p in parts] == [["0", "1"], ["2"], ["3"], ["4", "5", "6", "7"], ["2"], ["3"], ["4"]]


def test_vectors_of_many_texts_in_one_batch(spark):
    """Vectors are made in small pieces and still belong to their texts, empty and NULL ones included."""
    rows = [(i, None if i % 97 == 0 else "" if i % 89 == 0 else f"text {i * i} äö 漢字") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = {r.id: r.v for r in df.select("id", E.hash_embed("text").alias("v")).collect()}
    for i, text in rows:
        assert got[i] == E._hash_vector(text or "", E.HASH_DIM, {}).tolist()
