"""Chunking by invariants over random texts, and hand-made cases."""

from __future__ import annotations

import hashlib
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from folioscope.operators import chunking as C

BREAKS = "。！？；\n！?!;:：，,、 \t"


def random_markdown(rng):
    alphabet = ["alpha", "beta", "超时设置", "，", "。", " ", "  ", "\t", "x" * 30, "é", "　", "。！", "\xa0", "😀", ", "]
    lines = []
    for _ in range(rng.randint(0, 25)):
        kind = rng.random()
        if kind < 0.2:
            lines.append("#" * rng.randint(1, 7) + rng.choice([" ", "\t", "", "　 "]) + rng.choice(["One", "二", "", " t "]))
        elif kind < 0.35:
            lines.append("")
        elif kind < 0.4:
            lines.append("```")
        else:
            lines.append("".join(rng.choice(alphabet) for _ in range(rng.choice([1, 3, 10, 60]))))
    return "\n".join(lines)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return [(f"d{i}.md", random_markdown(rng)) for i in range(150)]


def squeezed(text):
    return re.sub(r"\s+", "", text)


@pytest.mark.parametrize("size,overlap", [(500, 50), (60, 500), (50, 0), (10, 7), (81, 20)])
def test_chunk_invariants(spark, texts, size, overlap):
    """Bounded, trimmed and numbered chunks that hold all text of their sections, with suffixes as overlap."""
    docs = spark.createDataFrame(texts, "source string, content string")
    bodies, got = {}, {}
    for r in C.heading_path(docs).orderBy("source", "section_idx").collect():
        bodies.setdefault(r.source, []).append((r.heading, r.body))
    for r in C.chunk_documents(docs, size, overlap).orderBy("source", "chunk_index").collect():
        got.setdefault(r.source, []).append(r)
    bound, shared = C.chunk_params(size, overlap)
    assert got.keys() == bodies.keys()
    for source, chunks in got.items():
        assert [c.chunk_index for c in chunks] == list(range(len(chunks)))
        for c in chunks:
            assert 0 < len(c.content) <= bound and c.content == c.content.strip()
            assert c.embed_text == (f"{c.heading}\n{c.content}" if c.heading else c.content)
            key = f"{source}:{c.chunk_index}:{c.heading}:{c.content[:50]}"
            assert c.chunk_id == str(uuid.UUID(hex=hashlib.md5(key.encode()).hexdigest()))
        # Every way of reading the chunks: (section, characters of it read so far).
        parts = [(heading, squeezed(body)) for heading, body in bodies[source]]
        states, before = {(0, 0)}, ""
        for c in chunks:
            states |= {(k + 1, 0) for k, p in states if p == len(parts[k][1]) and k + 1 < len(parts)}
            text = squeezed(c.content)
            tail = squeezed(before[max(0, len(before) - shared) :]) if shared else ""
            reads = set()
            for k, p in states:
                heading, body = parts[k]
                for own in {text, text[len(tail) :] if p and tail and text.startswith(tail) else text}:
                    if own and heading == c.heading and body.startswith(own, p):
                        reads.add((k, p + len(own)))
            states, before = reads, c.content
        assert (len(parts) - 1, len(parts[-1][1])) in states


@pytest.mark.parametrize("size", [50, 81])
def test_long_texts_are_cut_behind_breaks(spark, texts, size):
    """A piece ends behind a break of its second half, or is full where that half has none."""
    rows = [(re.sub(r"\s*\n\s*", "", t) or "x",) for _, t in texts]
    df = spark.createDataFrame(rows, "t string")
    for r in df.select("t", C.split_long(F.col("t"), size).alias("p")).collect():
        assert squeezed("".join(r.p)) == squeezed(r.t)
        at = 0
        for piece in r.p[:-1]:
            start = r.t.index(piece, at)
            at = start + len(piece)
            behind = re.match(r"\s*", r.t[at:]).group()
            assert piece[-1] in BREAKS or behind or len(piece) == size
            window = r.t[start : start + size]
            last = max(window.rfind(c) for c in BREAKS)
            if last >= size // 2:
                assert len(piece) <= last + 1 and squeezed(window[len(piece) : last + 1]) == ""
            else:
                assert len(piece) == len(window.rstrip())


def test_sections_hold_all_text(spark, texts):
    """Headings and bodies in order are the document, and paths only name open headings."""
    docs = spark.createDataFrame(texts, "source string, content string")
    got = {}
    for r in C.heading_path(docs).orderBy("source", "section_idx").collect():
        got.setdefault(r.source, []).append(r)
    for source, content in texts:
        left = content
        for r in got.get(source, []):
            assert r.body == r.body.strip() and r.body in left
            skipped, _, left = left.partition(r.body)
            assert all(re.match(r"#{1,6}\s", line.lstrip()) or not line.strip() for line in skipped.split("\n"))


def test_heading_goldens(spark):
    text = "intro\n# A\na\n## B\n### C\nc\n## D\nd\n####### seven\n```\n# in fence\n```\n# E"
    docs = spark.createDataFrame([("m.md", text)], "source string, content string")
    rows = [(r.heading, r.body) for r in C.heading_path(docs).orderBy("section_idx").collect()]
    assert rows == [
        ("", "intro"),
        ("A", "a"),
        ("A › B › C", "c"),
        ("A › D", "d\n####### seven\n```"),
        ("in fence", "```"),
    ]


def test_long_text_without_breaks(spark):
    df = spark.createDataFrame([("x" * 1234,), ("文" * 777,), ("",)], "t string")
    sizes = [[len(p) for p in r.p] for r in df.select(C.split_long(F.col("t"), 500).alias("p")).collect()]
    assert sizes == [[500, 500, 234], [500, 277], [0]]


def test_params():
    assert C.chunk_params(10, 99) == (50, 25)
    assert C.chunk_params(500, -3) == (500, 0)


def test_plan_has_no_shuffle(spark, texts):
    docs = spark.createDataFrame(texts, "source string, content string")
    plan = C.chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_same_result_for_any_partitioning(spark, texts):
    docs = spark.createDataFrame(texts, "source string, content string")
    base = {tuple(r) for r in C.chunk_documents(docs.repartition(1)).collect()}
    assert base == {tuple(r) for r in C.chunk_documents(docs.repartition(40)).collect()}


def test_stats(spark):
    body = "\n\n".join(f"paragraph number {i} with some words in it" for i in range(12))
    docs = spark.createDataFrame([("a.md", body)], "source string, content string")
    row = C.chunk_stats(C.chunk_documents(docs, 120, 20), 20).first()
    assert row.max_chars <= 120 and row.chunks > 3 and row.overlapping > 0
