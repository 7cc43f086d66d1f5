"""Phrases of two to four words that say more than their parts, by direct-address tiling.

Words get ids by falling frequency. Pairs of ids fall into square tiles: crowded tiles are counted by a
dense ``bincount``, others as sorted coordinates. Frequent pairs are ranked anew and paired with the next
word, which gives phrases of three words, and so on. Ranks go to the commonest ``RANKS`` units only, a
fixed table; pairs with a rarer unit are coordinates, so every phrase is counted. Tasks count what they
read, Spark adds up the counts of equal phrases.

Phrases are known by 64-bit keys of their words and language, made from the key of all words but the
last and that of the last word; scores are found on keys. One more pass reads the texts of the best phrases
and of those that tie with them, and would meet two texts under one key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import BYTES, LOWER, U, mix, streamed, text_blocks, written

LONGEST = 4
#: Ids of the direct-address table and the side of its tiles.
RANKS = 1 << 14
SIDE = 1 << 9
#: A tile with at least this many pairs in a buffer is counted densely.
CROWDED = SIDE * SIDE // 16
#: Units that a task holds before it counts them.
BUFFER = 1 << 21
#: Size of the bitmaps that spare rows a shuffle; a full one only spares fewer.
BITS = 24
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
STEP = U(0x9E3779B97F4A7C15)
NO_LANGUAGE = "und"


def _longer(units: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The keys of phrases made of a unit and the word after it."""
    return mix(units * STEP + words)


@dataclass
class Block:
    """The words of some rows: places in ``text`` (words of a piece are one blank apart), keys, languages, pieces."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    keys: np.ndarray
    language: np.ndarray
    piece: np.ndarray

    def phrases(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to ``n`` words: the phrase's key from every word on, and whether it stays in one piece."""
        keys = self.keys
        whole = np.ones(len(keys), bool)
        yield keys, whole
        for size in range(2, n + 1):
            keys = _longer(keys[:-1], self.keys[size - 1 :]) if len(keys) else keys
            whole = self.piece[: len(keys)] == self.piece[len(self.piece) - len(keys) :]
            yield keys, whole


def language_keys(languages: list[str]) -> np.ndarray:
    keys = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(languages)}
    return np.array([keys[x] for x in languages], U)


def blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    """The words of a batch's texts in blocks of rows; every row has a language."""
    seed_of = language_keys(batch["lang"].to_pylist())
    for part in text_blocks(batch["text"]):
        data = LOWER[part.data]
        n = len(data)
        solid = ~GAP[data]
        cuts = part.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        first[cuts] = solid[cuts]
        last[cuts - 1] = solid[cuts - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        rows = np.searchsorted(part.offsets, start, "right") - 1
        breaks = np.cumsum(BREAK[data])
        # Rows and breaks both only grow, so their sum tells pieces apart.
        piece = (breaks[start] if n else start) + rows
        sums = BYTES.prefixes(data)
        keys = mix(BYTES.ranges(sums, start, end) + (end - start).astype(U))
        language = seed_of[part.first + rows]
        keys = mix(keys ^ language)
        # One blank after each word; what else stood between words goes.
        keep = solid.copy()
        keep[1:] |= solid[:-1]
        spaced = np.where(solid, data, np.uint8(0x20))[keep]
        place = np.cumsum(keep) - keep
        begin = place[start]
        yield Block(spaced, begin, begin + (end - start), keys, language, piece)


@dataclass
class Units:
    """The commonest units: their sorted keys, the rank of each, and the keys by rank."""

    keys: np.ndarray
    rank: np.ndarray
    by_rank: np.ndarray

    @classmethod
    def of(cls, frequent: DataFrame) -> Units:
        """At most ``RANKS`` keys reach the driver."""
        table = frequent.orderBy(F.desc("n"), "key").limit(RANKS).select("key").toArrow()
        by_rank = table["key"].to_numpy().view(U)
        order = np.argsort(by_rank)
        return cls(by_rank[order], order, by_rank)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """The rank of every key; -1 for rarer ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], -1)


def count_pairs(left: np.ndarray, right: np.ndarray, units: Units, words: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs ``left, right`` with their numbers, each pair once."""
    i, j = units.ranks(left), words.ranks(right)
    ranked = (i >= 0) & (j >= 0)
    rarer = np.flatnonzero(~ranked)
    _, at, counts = np.unique(_longer(left[rarer], right[rarer]), return_index=True, return_counts=True)
    found = [(left[rarer[at]], right[rarer[at]], counts)]
    i, j = i[ranked], j[ranked]
    across = RANKS // SIDE
    tile = ((i // SIDE) * across + j // SIDE).astype(np.uint16)
    order = np.argsort(tile, kind="stable")
    i, j = i[order], j[order]
    sizes = np.bincount(tile, minlength=across**2)
    ends = np.cumsum(sizes)
    sparse = np.ones(len(i), bool)
    for t in np.flatnonzero(sizes >= CROWDED):
        at = slice(ends[t] - sizes[t], ends[t])
        sparse[at] = False
        low, high = t // across * SIDE, t % across * SIDE
        cells = np.bincount((i[at] - low) * SIDE + (j[at] - high), minlength=SIDE * SIDE)
        cell = np.flatnonzero(cells)
        found.append((units.by_rank[low + cell // SIDE], words.by_rank[high + cell % SIDE], cells[cell]))
    if sparse.any():
        code, counts = np.unique(i[sparse] * RANKS + j[sparse], return_counts=True)
        found.append((units.by_rank[code // RANKS], words.by_rank[code % RANKS], counts))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


class Bitmap:
    """Which keys may be among some table's: never misses one."""

    def __init__(self, keys: DataFrame):
        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(1 << BITS, bool)
            for batch in batches:
                seen[(mix(batch.column(0).to_numpy().view(U)) >> U(64 - BITS)).astype(np.int64)] = True
            bits = np.packbits(seen, bitorder="little").view(np.int64)
            at = np.flatnonzero(bits)
            yield pa.RecordBatch.from_pydict({"word": pa.array(at, pa.int64()), "bits": pa.array(bits[at])})

        rows = keys.select("key").mapInArrow(fold, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.bits = np.zeros(1 << (BITS - 6), np.int64)
        self.bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()

    def has(self, keys: np.ndarray) -> np.ndarray:
        cell = mix(keys) >> U(64 - BITS)
        return self.bits.view(U)[(cell >> U(6)).astype(np.int64)] >> (cell & U(63)) & U(1) != 0


def count_words(docs: DataFrame) -> DataFrame:
    """Numbers of words by key, with their language's key, and by ``lang`` (no word's key) the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[Block] = []
        names: dict[int, str] = {}
        total: dict[int, int] = {}
        for batch in batches:
            languages = batch["lang"].to_pylist()
            names.update(zip(language_keys(languages).tolist(), languages, strict=True))
            for block in blocks(batch):
                held.append(block)
                for language, n in zip(*np.unique(block.language, return_counts=True), strict=True):
                    total[int(language)] = total.get(int(language), 0) + int(n)
                if sum(len(b.keys) for b in held) >= BUFFER:
                    yield flushed(held)
                    held = []
        if held:
            yield flushed(held)
        if total:
            of = np.array(list(total), U).view(np.int64)
            yield {"lang": pa.array([names[x] for x in total]), "language": pa.array(of), "n": pa.array(list(total.values()), pa.int64())}

    def flushed(held: list[Block]) -> dict:
        keys, at, counts = np.unique(np.concatenate([b.keys for b in held]), return_index=True, return_counts=True)
        language = np.concatenate([b.language for b in held])[at]
        return {"key": pa.array(keys.view(np.int64)), "language": pa.array(language.view(np.int64)), "n": pa.array(counts)}

    return streamed(docs, run, "lang string, language long, key long, n long")


def count_phrases(docs: DataFrame, size: int, units: Units, words: Units, frequent: Bitmap) -> DataFrame:
    """Numbers of the phrases of ``size`` words by the keys of all words but the last, and of the last.

    Both phrases one word shorter may be frequent; others cannot be.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        for batch in batches:
            for block in blocks(batch):
                if len(block.keys) < size:
                    continue
                *_, (shorter, _), (_, whole) = block.phrases(size)
                likely = frequent.has(shorter)
                at = np.flatnonzero(whole & likely[:-1] & likely[1:])
                left.append(shorter[at])
                right.append(block.keys[at + size - 1])
            if sum(map(len, left)) >= BUFFER:
                yield flushed(left, right)
                left, right = [], []
        if left:
            yield flushed(left, right)

    def flushed(left: list[np.ndarray], right: list[np.ndarray]) -> dict:
        before, last, counts = count_pairs(np.concatenate(left), np.concatenate(right), units, words)
        return {"left": pa.array(before.view(np.int64)), "word": pa.array(last.view(np.int64)), "n": pa.array(counts)}

    return streamed(docs, run, "left long, word long, n long")


def _with_key(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keys = _longer(batch["left"].to_numpy().view(U), batch["word"].to_numpy().view(U))
            yield {**{c: batch[c] for c in ("left", "word", "n")}, "key": pa.array(keys.view(np.int64))}

    return streamed(pairs, run, "key long, left long, word long, n long")


def with_parts(phrases: DataFrame) -> DataFrame:
    """The keys of what a cut after ``k`` words leaves (``heads``, ``rests``), and of shorter phrases inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for size in range(2, LONGEST + 1):
                part = batch.filter(pa.compute.equal(batch["size"], size))
                if not part.num_rows:
                    continue
                words = part["words"].flatten().to_numpy().view(U).reshape(-1, size)
                keys: dict[tuple[int, int], np.ndarray] = {}
                for start in range(size):
                    keys[start, start + 1] = words[:, start]
                    for end in range(start + 2, size + 1):
                        keys[start, end] = _longer(keys[start, end - 1], words[:, end - 1])
                lists = {
                    "heads": [(0, k) for k in range(1, size)],
                    "rests": [(k, size) for k in range(1, size)],
                    "inner": [(a, b) for a, b in keys if 2 <= b - a < size],
                }
                kept = {c: part[c] for c in ("key", "language", "a")}
                yield kept | {c: _lists([keys[x] for x in places], part.num_rows) for c, places in lists.items()}

    return streamed(phrases, run, "key long, language long, a long, heads array<long>, rests array<long>, inner array<long>")


def _lists(columns: list[np.ndarray], rows: int) -> pa.Array:
    flat = np.stack(columns, axis=1).ravel().view(np.int64) if columns else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * len(columns)), pa.array(flat))


def texts_of(docs: DataFrame, wanted: Bitmap) -> DataFrame:
    """``key, phrase`` of the phrases of two words and more that may be wanted, once a batch or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            seen = np.zeros(0, U)
            for block in blocks(batch):
                for size, (keys, whole) in enumerate(block.phrases(LONGEST), 1):
                    if size < 2 or not len(keys):
                        continue
                    at = np.flatnonzero(wanted.has(keys) & whole)
                    found, where = np.unique(keys[at], return_index=True)
                    new = ~np.isin(found, seen, assume_unique=True)
                    seen = np.union1d(seen, found[new])
                    at = at[where[new]]
                    if len(at):
                        yield {"key": pa.array(keys[at].view(np.int64)), "phrase": cut(block.text, block.start[at], block.end[at + size - 1])}

    return streamed(docs, run, "key long, phrase string")


def cut(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts from ``start`` to ``end``."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    data = text[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], end - start)]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data))


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``key, size, f, language, words`` of all phrases of one to four words found ``least`` times; ``lang, language, n``.

    One pass over the texts for each size.
    """
    counted = written(count_words(docs), "phrases-words")
    totals = counted.where("key is null").groupBy("lang", "language").agg(F.sum("n").alias("n"))
    single = counted.where("key is not null").groupBy("key", "language").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    level = written(single.select("key", "language", "n", F.lit(1).alias("size"), F.array("key").alias("words")), "phrases-1")
    words = units = Units.of(level)
    levels = [level]
    for size in range(2, LONGEST + 1):
        pairs = count_phrases(docs, size, units, words, Bitmap(level))
        pairs = pairs.groupBy("left", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        shorter = level.select(F.col("key").alias("left"), "language", F.col("words").alias("before"))
        longer = _with_key(pairs).join(shorter, "left").withColumns({"size": F.lit(size), "words": F.concat("before", F.array("word"))})
        level = written(longer.select("key", "language", "n", "size", "words"), f"phrases-{size}")
        units = Units.of(level)
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).withColumnRenamed("n", "f"), totals


def _wide(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def score_of(a: str, both: str) -> Column:
    """floor(2000000 * a / both), exact beyond 64 bits."""
    return F.expr(f"cast({a} as decimal(20,0)) * 2000000bd div cast({both} as decimal(20,0))")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of every language by the score of their weakest cut.

    Null texts are empty, null languages are ``und``; ids do not matter, so repeated and null ones are rows
    like any other. Texts without a frequent phrase add to ``n`` only. An empty table gives no rows,
    further columns are ignored.
    """
    docs = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    found, totals = frequent_phrases(docs, least)
    parts = written(with_parts(found.where("size > 1").withColumnRenamed("f", "a")), "phrases-parts")
    cuts = parts.select("key", "language", "a", F.posexplode(F.arrays_zip("heads", "rests")).alias("k", "cut"))
    heads = found.select(F.col("key").alias("head"), F.col("f").alias("l"))
    rests = found.select(F.col("key").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.select("key", "language", "a", "k", F.col("cut.heads").alias("head"), F.col("cut.rests").alias("rest"))
    scored = cuts.join(heads, "head").join(rests, "rest").withColumn("score", score_of("a", "l + r"))
    weakest = scored.groupBy("key", "language", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Runs of two words and more inside longer phrases, with the largest number among those phrases.
    inner = parts.select(F.explode("inner").alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    kept = weakest.join(inner, "key", "left").where(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * 80))
    order = Window.partitionBy("language").orderBy(F.desc("score"), F.desc("a"))
    kept = kept.select("key", "language", "a", "cut.l", "cut.r", "cut.score")
    # Ranks, not row numbers: phrases that tie with the last one are told apart by their texts.
    tied = written(kept.withColumn("rank", F.rank().over(order)).where(F.col("rank") <= top).drop("rank"), "phrases-best")
    texts = texts_of(docs, Bitmap(tied)).distinct()
    named = written(tied.join(texts, "key"), "phrases-named")
    if named.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").limit(1).count():
        raise RuntimeError("two phrases share a 64-bit key")
    order = Window.partitionBy("language").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "language").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
