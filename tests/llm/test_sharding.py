"""Shards by differencing: a plain model of the method, whole groups, gapless slots."""

from __future__ import annotations

import random
import zlib

import numpy as np

from folioscope.llm import sharding

SCHEMA = "doc_id long, text string, lang string, bundle int, row int, shard int, size int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 4) for i, t in rows], SCHEMA)


def model(sizes, ways):
    """Differencing on lists of sets, one combination at a time."""
    partials = [[-size, i, [(size, [i])] + [(0, [])] * (ways - 1)] for i, size in enumerate(sizes)]
    fresh = len(sizes)
    while len(partials) > 1:
        partials.sort(key=lambda p: (p[0], p[1]))
        (_, _, a), (_, _, b) = partials[:2]
        both = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda s: -s[0])
        low = both[-1][0]
        partials = [*partials[2:], [low - both[0][0], fresh, [(s - low, items) for s, items in both]]]
        fresh += 1
    return [sum(sizes[i] for i in items) for _, items in partials[0][2]]


def test_differencing_equals_the_plain_model():
    draw = random.Random(3)
    for ways in (2, 3, 7):
        for n in (1, 2, 5, 40):
            sizes = [draw.choice([draw.randrange(1, 1000), 16]) for _ in range(n)]
            parts = sharding.differencing(np.array(sizes), ways)
            assert sorted(np.bincount(parts, np.array(sizes), ways).astype(int)) == sorted(model(sizes, ways))
    assert len(sharding.differencing(np.zeros(0, np.int64), 4)) == 0


def test_differencing_is_tighter_than_taking_turns():
    draw = random.Random(4)
    sizes = np.array([int(draw.paretovariate(1.2) * 100) for _ in range(4000)])
    sums = np.bincount(sharding.differencing(sizes, 40), sizes, 40)
    fair = max(sizes.max(), sizes.sum() / 40)
    assert sums.max() <= fair * 1.001


def test_whole_groups_gapless_slots_and_balance(spark):
    draw = random.Random(5)
    texts = [None, "", " ", "é" * 7, "x" * 60000, *["copy " * 9] * 500, *[str(draw.random()) * draw.randrange(1, 60) for _ in range(1500)]]
    rows = [*enumerate(texts), (7, "again"), (7, "again"), (None, "again"), (None, None)]
    got = sharding.shard_by_bytes(frame(spark, rows), shards=8).collect()
    assert len(got) == len(rows)
    by_id = {}
    for i, text in rows:
        raw = (text or "").encode()
        by_id.setdefault(i, []).append((len(raw) + 16, zlib.crc32(raw)))
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r["size"], r.text_crc32))
        assert (r.law, r.grown_shard) == ("bytes", None)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in by_id.items()}
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
    assert set(shards) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    of_text = {}
    for r in got:
        of_text.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())
    sums = [sum(r["size"] for r in got if r.shard == k) for k in range(8)]
    assert max(sums) <= max(60016, 1.01 * sum(sums) / 8)


def test_empty_and_one_text(spark):
    assert sharding.shard_by_bytes(frame(spark, [])).count() == 0
    got = sharding.shard_by_bytes(frame(spark, [(i, "same") for i in range(50)]), shards=4).collect()
    assert {r.shard for r in got} == {got[0].shard} and sorted(r.slot for r in got) == list(range(50))
