"""The trie of rebuilt conversations against a plain model, and centroid sums against plain sums."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from folioscope.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, ka long, m long, row long, place int, saved string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 9, 9, 9, 9, "x") for r in rows], SCHEMA)


def model(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(r[2], r[4]) for r in sorted(turns)] for c, turns in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = {}
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(len(y) == len(x) + 1 and y[:-1] == x for y in members) for x in below)
        joined = ",".join(map(str, sorted(ends.get(node, []))))
        parent = min(members[node[:-1]]) if node else None
        out[min(cs), len(node)] = (parent, len(cs), len(children), leaves, saved, hashlib.sha256(joined.encode()).hexdigest())
    return out


def awkward(seed, families=4, long=0):
    draw = random.Random(seed)
    rows = []
    for c in [*range(20 * families), 1000, 1001, 1023, 2047]:
        if draw.random() < 0.1:
            continue
        n = draw.choice([1, 1, 2, 3, 4, 6])
        rows += [(c, t, draw.choice(["user", "bot"]), draw.choice(["a b", "a", "", "c\td e"])) for t in range(n)]
    rows += [(c, t, "user", "same words here") for c in range(300, 330) for t in range(4)]
    rows += [(c, t, "user", f"step {t}") for c in range(400, 420) for t in range(c - 398)]
    rows += [(305, None, None, None), (305, None, "x", None), (305, 1, "user", "same words here"), (None, 1, "user", "no conversation"), (7, 3, None, "é 日本")]
    rows += [(500, t, "user", f"t{t // 3}") for t in range(long)] + [(501, t, "user", f"t{t // 3}") for t in range(long)]
    draw.shuffle(rows)
    return rows


def check(spark, rows, **options):
    got = prefix_trie.prefix_trie(frame(spark, rows), **options)
    assert tuple(got.columns) == COLUMNS
    found = {(r[0], r[1]): tuple(r[2:]) for r in got.collect()}
    wanted = model(rows)
    assert found == wanted
    return wanted


@pytest.mark.parametrize("span", [3, 4096])
def test_trie_equals_the_model(spark, span):
    assert len(check(spark, awkward(span), span=span)) > 100


def test_long_conversations_are_scanned_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 2)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    check(spark, awkward(8, families=2, long=41), span=5)


def test_empty_tables_and_rows_without_a_conversation(spark):
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
    # A conversation whose turns are all replaced by those of an absent one has the root only.
    lone = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    assert check(spark, [(lone, 0, "user", "x")]) == {(lone, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())}


def test_centroid_sums():
    draw = random.Random(2)
    for shape in (lambda i: i - 1, lambda i: 0, lambda i: draw.randrange(i), lambda i: max(0, i - draw.randrange(1, 4)), lambda i: draw.choice([-1, i - 1])):
        for n in (0, 1, 2, 3, 70):
            parent = [-1 if not i else shape(i) for i in range(n)]
            values = np.array([[draw.randrange(9), draw.randrange(99)] for _ in range(n)], np.int64).reshape(n, 2)
            plain = values.copy()
            for i in reversed(range(n)):
                if parent[i] >= 0:
                    plain[parent[i]] += plain[i]
            assert (prefix_trie.centroid_sums(parent, values) == plain).all()
