"""Phrases and their scores against a plain model; tiles against a counter."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from folioscope.llm import collocations

SCHEMA = "doc_id long, text string, lang string, key long, n int, phrase string, size int"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, "p", 3) for i, (t, lang) in enumerate(rows)], SCHEMA)


def model(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    best = {}
    for (lang, p), a in candidates.items():
        inside = [b for (x, q), b in candidates.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 80 * a for b in inside):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        best.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {
        (lang, rank): (p.decode(), -a, left, right, n[lang], -score)
        for lang, found in best.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


def awkward(seed):
    draw = random.Random(seed)
    words = ["the", "The", "of", "é", "日本", "new", "york", "city", "x" * 300, "a-b", "\x00", "\x0e", "don't"]
    marks = [" ", "\t", "  ", ". ", ",", "\n", "\x0b", "!", "\r\n", "\xa0"]
    rows = [(None, "en"), ("", "en"), (" . ", None), ("new york", None), ("a\nb", "und"), ("new york city is", "")]
    for _ in range(150):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", draw.choice(marks)]) for _ in range(draw.randrange(1, 30)))
        rows.append((text, draw.choice(["en", "en", "en", "de", None, "und", ""])))
    rows += [("new york city hall " * 3, "de")] * 20 + [("la la la la la la", "fr")] * 3 + [("one", "fr"), ("tail. one", "fr")]
    rows.append((" ".join(draw.choice(words) for _ in range(5000)), "en"))
    return rows


def test_equals_the_model(spark):
    for seed, least, top in ((1, 4, 2000), (2, 12, 7)):
        rows = awkward(seed)
        got = collocations.collocations(frame(spark, rows).repartition(5), least=least, top=top)
        assert got.columns == COLUMNS
        found = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()}
        assert found == model(rows, least, top) and len(found) > 10


def test_nothing_frequent(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(None, None), ("a b c", "en")])).count() == 0


def test_wide_products(spark):
    rows = [(3 * 10**15, 9 * 10**15), (1, 3), (9 * 10**18, 9 * 10**18), (30, 60)]
    df = spark.createDataFrame(rows, "a long, both long")
    assert [r.s for r in df.select(collocations.score_of("a", "both").alias("s")).collect()] == [2000000 * a // b for a, b in rows]


def test_tiles_equal_a_counter(monkeypatch):
    monkeypatch.setattr(collocations, "SIDE", 4)
    monkeypatch.setattr(collocations, "RANKS", 16)
    monkeypatch.setattr(collocations, "CROWDED", 9)
    draw = np.random.default_rng(1)
    keys = draw.integers(1, 2**63, 40, dtype=np.uint64)
    order = np.argsort(keys[:16])
    units = collocations.Units(keys[:16][order], order, keys[:16])
    none = collocations.Units(keys[:0], order[:0], keys[:0])
    left, right = (keys[np.minimum(draw.geometric(0.1, 4000) - 1, 39)] for _ in range(2))
    plain = Counter(zip(left.tolist(), right.tolist(), strict=True))
    for table in (units, none):
        a, b, numbers = (x.tolist() for x in collocations.count_pairs(left, right, table, units))
        assert len(a) == len(plain) and dict(zip(zip(a, b, strict=True), numbers, strict=True)) == plain
    assert not len(collocations.count_pairs(left[:0], right[:0], units, units)[2])
