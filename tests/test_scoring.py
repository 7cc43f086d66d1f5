"""Score kernels against plain sorting, with ties, few and many rows, and small memory."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import retrieval as R
from folioscope.operators import scoring as S


def best_of(scores, ids, limit):
    """Rows with a score per question by score, then id."""
    out = {}
    for q, row in enumerate(scores):
        ranked = sorted((-round(x, 9), i) for x, i in zip(row, ids, strict=True) if x is not None)
        out[q] = [(i, -x) for x, i in ranked[:limit]]
    return out


def kept(best, questions):
    out = {q: [] for q in range(questions)}
    for batch in best.batches([str(q) for q in range(questions)], "score"):
        for q, i, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            out[int(q)].append((i, x))
    return out


def fed(ids, size, draw):
    """Batches in a random order of rows, each sorted by id."""
    order = draw.permutation(len(ids))
    for at in range(0, len(ids), size):
        yield np.array(sorted(order[at : at + size], key=lambda i: ids[i]))


@pytest.mark.parametrize("kind", ["random", "equal", "few values", "groups"])
@pytest.mark.parametrize("cells", [60, 4_000_000])
def test_cosine(kind, cells):
    draw = np.random.default_rng(5)
    vectors = {
        "random": draw.normal(size=(300, 8)),
        "equal": np.ones((300, 8)),
        "few values": draw.integers(0, 2, (300, 8)) * 1.0,
        "groups": np.repeat(np.eye(8), 38, axis=0)[:300] + draw.normal(size=(300, 8)) * 1e-3,
    }[kind]
    unit, wanted = R._unit(vectors), R._unit(np.vstack([vectors[:7], draw.normal(size=(6, 8))]))
    ids = np.array([f"c{draw.integers(10**6)}-{i}" for i in range(300)])
    for limit in (1, 5, 400):
        best = S.CosineBest(wanted, limit, cells)
        for part in fed(ids, 90, draw):
            best.add(unit[part], ids[part])
        got, want = kept(best.best, len(wanted)), best_of(wanted @ unit.T, ids, limit)
        for q in want:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]] or kind in ("equal", "few values", "groups")
            assert np.allclose([x for _, x in got[q]], [x for _, x in want[q]], atol=2e-9) and len(got[q]) == len(want[q])
        if kind == "equal":
            assert all([i for i, _ in got[q]] == sorted(ids)[:limit] for q in range(7))


@pytest.mark.parametrize("cells", [50, 4_000_000])
def test_bm25(cells):
    draw = np.random.default_rng(6)
    rows, words, questions = 250, 40, 12
    held = draw.random((rows, words)) < 1 / (1 + np.arange(words))
    gain = np.round(draw.uniform(0.1, 2.5, (rows, words)), 1)
    weight = np.where(draw.random((questions, words)) < 0.3, draw.uniform(0.05, 6, words), 0)
    weight[:, 0] = -0.5 * (draw.random(questions) < 0.5)  # a word in most rows may weigh negative
    weight[3] = 0
    ids = np.array([f"r{draw.integers(1000)}-{i}" for i in range(rows)])
    q, w = np.nonzero(weight)
    scores = weight @ (held * gain).T
    plain = [[x if x > 0 else None for x in row] for row in scores]
    for limit in (1, 4, 300):
        best = S.Bm25Best(S.WeightedWords(q, w, weight[q, w], questions, words), limit, 2.5, cells)
        for part in fed(ids, 70, draw):
            row, word = np.nonzero(held[part])
            best.add(row, word, gain[part][row, word], ids[part])
        got, want = kept(best.best, questions), best_of(plain, ids, limit)
        assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}
        assert all(np.allclose([x for _, x in got[k]], [x for _, x in want[k]], atol=2e-9) for k in want)


def test_floors_spare_rows(monkeypatch):
    """Once floors are up, rows that cannot reach them are not scored."""
    seen = []
    add = S.RunningBest.add
    monkeypatch.setattr(S.RunningBest, "add", lambda self, question, *rest: (seen.append(len(question)), add(self, question, *rest)))
    words = S.WeightedWords(np.array([0, 0]), np.array([0, 1]), np.array([0.1, 9.0]), 1, 2)
    best = S.Bm25Best(words, 2, 2.5)
    ids = np.array([f"{i:05d}" for i in range(4000)])
    row = np.repeat(np.arange(4000), 2)
    word = np.tile([0, 1], 4000)
    present = (word == 0) | (row % 400 < 2)
    best.add(row[present], word[present], np.ones(present.sum()), ids)
    assert sum(seen) < 60
    assert [i for i, _ in kept(best.best, 1)[0]] == ["00000", "00001"]


def test_many_questions_in_blocks(spark):
    """More questions than one block holds give what one block gives."""
    chunks = spark.range(300).select(
        F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("").alias("heading"),
        F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 37).cast("string")) for k in (1, 3, 7)]).alias("content"),
        F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.cos(F.col("id") * i)).alias("vector"),
    )
    asked = spark.range(500).select(
        "id", F.col("id").alias("query_id"), F.concat(F.lit("w"), F.col("id") % 37, F.lit(" w"), F.col("id") % 11).alias("question"),
        F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("id") * i + 1)).alias("vector"),
    )
    index = R.bm25_index(chunks)
    for run in (lambda size: R.bm25_search(asked, index, 3, size), lambda size: R.cosine_topk(asked, chunks, 3, size)):
        one, many = (sorted(map(tuple, run(size).collect())) for size in (1 << 26, 6000))
        assert one == many and len(one) > 1000
