"""N-gram Jaccard join: documents whose sets of word shingles are alike, found by count-vector R-trees.

A document's shingles are hashed into groups; the group counts are a point. For two documents the
intersection is at most the sum of the coordinate minima of their points, and for a document and a box
of points at most the sum of minima with the box's upper corner. Boxes and pairs below the needed
overlap are left out; what is left is bounded again by finer counts, about one group for two members, and
survivors are verified on the whole sets.

So that no tree has to hold all documents, the trees are built over buckets: two sets with Jaccard
similarity ``t`` share one of the first ``n - ceil(t n) + 1`` shingles of each in any common order. The
order puts shingles last that a sketch of fixed size, counted over all documents, finds frequent; a
line that stands in a third of all texts, or in one of some thousands, then is in the bucket key of few. Equal sets are one entity
from the start. Links are searched in rounds, since only classes are asked for: first one partner per
entity and bucket, then the most promising one in another class, and at last, among entities that are
not in one class yet, every surviving pair. No link between classes is lost.

Nulls and texts without words have no shingle, link with nothing and are their own class; texts with
fewer words than a shingle are one shingle. Rows repeating a text share a class. Other columns are not
read; rows without ``doc_id`` name no class and are not linked through. Sets are compared by 64-bit hashes of their shingles, entities by a 64-bit hash of the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import connected
from folioscope.llm.shared import WORDS, Texts, giving_back, in_arrow, likely_split, mix, streamed, text_blocks, window_hashes, words_of, written

GROUPS = 128
MOST_GROUPS = 8192
#: Cells that shingles are counted in, the fewer ones that counts are given for by default, and cells in a row of counts.
CELLS = 1 << 21
SKETCH = 1 << 16
ROW = 1 << 13
LEAF = 16
SMALL = 32
PART = 8192
#: Bytes of text that are cut into shingles at once: their hashes stay in the processor's cache.
BLOCK = 1 << 18
U = np.uint64
#: Upper bounds that a byte can stand for: exact up to 100, then rising by 6 % a step.
BOUND = np.concatenate([np.arange(101), np.ceil(100 * 1.06 ** np.arange(1, 156))]).astype(np.int64)


def _sorted_rows(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The values of each row in order; ``rows`` is sorted. Long rows are sorted one by one, which is much faster."""
    if n * 32 > len(values):
        return values[np.lexsort((values, rows))]
    values = values.copy()
    cuts = np.searchsorted(rows, np.arange(n + 1)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        values[a:b].sort()
    return values


def _by_level(level: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The order by row and level, else as it is."""
    if n * 32 > len(level):
        return np.lexsort((level, rows))
    order = np.empty(len(level), np.int64)
    cuts = np.searchsorted(rows, np.arange(n + 1)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        order[a:b] = a + level[a:b].argsort(kind="stable")
    return order


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row: row numbers and hashes, sorted by row and hash."""
    words = words_of(texts, lower=True)
    hashes, inside = window_hashes(words, width)
    row = words.rows()
    rows, values = row[: len(hashes)][inside], hashes[inside]
    count = np.diff(words.offsets)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        sums = WORDS.prefixes(words.hash)
        whole = WORDS.ranges(sums, words.offsets[short], words.offsets[short + 1])
        rows = np.concatenate([rows, short])
        values = np.concatenate([values, mix(mix(whole) + count[short].astype(U))])
        order = np.argsort(rows, kind="stable")
        rows, values = rows[order], values[order]
    values = _sorted_rows(values, rows, texts.rows)
    if len(rows):
        new = np.append(True, (rows[1:] != rows[:-1]) | (values[1:] != values[:-1]))
        rows, values = rows[new], values[new]
    return rows, values


def _sizes(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def _entity(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each row's set, from two sums over differently mixed members."""
    one, two = np.zeros(n, U), np.zeros(n, U)
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    if len(starts):
        one[rows[starts]] = np.add.reduceat(mix(values + U(1)), starts)
        two[rows[starts]] = np.bitwise_xor.reduceat(mix(values ^ U(0x5851F42D4C957F2D)), starts)
    return mix(one + mix(two))


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection that makes sets of ``n`` and ``m`` members link."""
    return -(-percent * (n + m) // (100 + percent))


def _cells(values: np.ndarray) -> np.ndarray:
    """The cells of shingles: the first bits of their hashes."""
    return (values >> U(64 - CELLS.bit_length() + 1)).astype(np.int64)


def frequency_levels(classes: DataFrame, cells: int = SKETCH, steps: int = 1) -> np.ndarray:
    """Power of two of the number of documents that hold a shingle, in ``steps`` for each, by the first bits of its hash."""
    width = CELLS // cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, seen in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(seen.as_buffer(), np.uint8).astype(np.int64)
        levels = [(steps * np.log2(1 + x.reshape(-1, width).sum(1))).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int64()), "level": pa.array(levels, pa.binary())})

    counted = classes.where("seen is not null").select(F.col("n").alias("part"), "seen").repartition("part")
    found = counted.mapInArrow(giving_back(run), "part long, level binary").toArrow()
    out = np.zeros((CELLS // ROW, ROW // width), np.uint8)
    for part, level in zip(found["part"].to_pylist(), found["level"], strict=True):
        out[part] = np.frombuffer(level.as_buffer(), np.uint8)
    return out.ravel()


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A column of byte strings of the given sizes."""
    cuts = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, cuts.buffers()[1], pa.py_buffer(values.tobytes())])


def classes_of(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, entity, point, fine, seen`` of every row; entity is null for an empty set.

    ``point`` has ``GROUPS`` counts, ``fine`` about one for two members; groups halve in order, so points of
    different fineness compare after adding up neighbours. Further rows of each task, the only ones with
    ``seen``, count its documents by the cells of their shingles, up to 255, ``n`` being the row of cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for texts in text_blocks(batch.column(1), BLOCK):
                rows, values = shingle_sets(texts, width)
                np.add.at(seen, _cells(values), np.uint32(1))
                n = _sizes(rows, texts.rows)
                spread = mix(values + U(7))
                bits = np.clip(np.ceil(np.log2(np.maximum(n, 1) / 2)), np.log2(GROUPS), np.log2(MOST_GROUPS)).astype(np.int64)
                first = np.append(0, np.cumsum(1 << bits))
                fine = np.bincount(first[rows] + (spread >> (64 - bits[rows]).astype(U)).astype(np.int64), minlength=first[-1])
                group = (spread >> U(64 - GROUPS.bit_length() + 1)).astype(np.int64)
                point = np.bincount(rows * GROUPS + group, minlength=texts.rows * GROUPS)
                yield {
                    "doc_id": batch.column(0).slice(texts.first, texts.rows),
                    "n": n,
                    "entity": pa.array(_entity(rows, values, texts.rows).view(np.int64), mask=n == 0),
                    "point": _binary(np.searchsorted(BOUND, point).astype(np.uint8), np.full(texts.rows, GROUPS)),
                    "fine": _binary(np.searchsorted(BOUND, fine).astype(np.uint8), 1 << bits),
                }
        seen = np.minimum(seen, 255).astype(np.uint8).reshape(-1, ROW)
        parts = np.flatnonzero(seen.any(1))
        yield {"n": parts, "seen": _binary(seen[parts], np.full(len(parts), ROW))}

    return streamed(docs.select("doc_id", "text"), run, "doc_id long, n long, entity long, point binary, fine binary, seen binary")


def prefixes_of(docs: DataFrame, levels: np.ndarray, width: int, percent: int) -> DataFrame:
    """``shingle, entity, n, place``: the bucket keys of each entity with their place, once per task that sees it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(0, U)
        for batch in batches:
            for texts in text_blocks(batch.column(0), BLOCK):
                rows, values = shingle_sets(texts, width)
                n = _sizes(rows, texts.rows)
                entity = _entity(rows, values, texts.rows)
                _, first = np.unique(entity, return_index=True)
                fresh = np.zeros(texts.rows, bool)
                fresh[first] = True
                fresh &= ~np.isin(entity, met)
                met = np.concatenate([met, entity[fresh & (n > 0)]])
                # The order of all shingles: by level, then by hash, as they stand in their row.
                order = _by_level(levels[_cells(values)], rows, texts.rows)
                place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                keep = (place < (n - -(-percent * n // 100) + 1)[rows]) & fresh[rows]
                yield pa.RecordBatch.from_pydict({
                    "shingle": pa.array(values[order][keep].view(np.int64)),
                    "entity": pa.array(entity[rows[keep]].view(np.int64)),
                    "n": pa.array(n[rows[keep]].astype(np.int32)),
                    "place": pa.array(place[keep].astype(np.int32)),
                })

    return docs.select("text").mapInArrow(giving_back(run), "shingle long, entity long, n int, place int")


def shared_keys(prefixes: DataFrame) -> DataFrame:
    """The rows of ``prefixes`` whose shingle belongs to two entities at least, each once, cut into parts.

    Rows of one shingle stand together after the sort, so a task keeps one row in hand. ``part`` counts
    ``PART`` rows of a shingle; every further part begins with a copy of the shingle's first row.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_shared = None, False
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key, entity = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (entity[1:] != entity[:-1])))
            key = key[at]
            before = np.append(held_shared, key[1:] == key[:-1])
            good = before | np.append(key[1:] == key[:-1], False)
            yield batch.take(pa.array(at[:-1][good[:-1]]))
            held, held_shared = batch.slice(int(at[-1]), 1), bool(before[-1])
        if held is not None and held_shared:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = None, 0  # of the shingle that the last batch ended in
        for batch in shared(batches):
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            place = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
            goes_on = first is not None and key[0] == first.column(0)[0].as_py()
            if goes_on:
                place[: starts[1] if len(starts) > 1 else None] += done
            part = place // PART
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names)
            for i in np.flatnonzero((place % PART == 0) & (place > 0)):
                start = starts[np.searchsorted(starts, i, "right") - 1]
                row = first if start == 0 and goes_on else batch.slice(int(start), 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([part[i]], pa.int32())], names)
            if not goes_on or len(starts) > 1:
                first = batch.slice(int(starts[-1]), 1)
            done = int(place[-1]) + 1

    names = ["shingle", "entity", "n", "place", "part"]
    ordered = prefixes.repartition("shingle").sortWithinPartitions("shingle", "n", "entity")
    return ordered.mapInArrow(giving_back(run), "shingle long, entity long, n int, place int, part int")


class CountTree:
    """An R-tree over count points: leaves of neighbouring points, boxes kept as upper corners and sizes."""

    def __init__(self, points: np.ndarray, n: np.ndarray):
        self.order = np.lexsort((points[:, 1], points[:, 0], n))
        self.points, self.n = points[self.order], n[self.order]
        cuts = np.arange(0, len(n), LEAF)
        self.levels = [(np.maximum.reduceat(self.points, cuts), np.minimum.reduceat(self.n, cuts), np.maximum.reduceat(self.n, cuts))]
        while len(self.levels[-1][0]) > LEAF:
            upper, least, most = self.levels[-1]
            cuts = np.arange(0, len(least), LEAF)
            self.levels.append((np.maximum.reduceat(upper, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)))

    def search(self, point: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Numbers of the points that can link with ``point``, ascending."""
        nodes = np.arange(len(self.levels[-1][0]))
        for upper, least, most in self.levels[::-1]:
            nodes = nodes[nodes < len(least)]
            near = (100 * np.minimum(n, most[nodes]) >= percent * np.maximum(n, least[nodes]))
            nodes = nodes[near]
            low = np.maximum(least[nodes], -(-percent * n // 100))
            nodes = nodes[np.minimum(upper[nodes], point).sum(1) >= needed(n, low, percent)]
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        nodes = nodes[nodes < len(self.n)]
        fit = np.minimum(self.points[nodes], point).sum(1) >= needed(n, self.n[nodes], percent)
        fit &= 100 * np.minimum(n, self.n[nodes]) >= percent * np.maximum(n, self.n[nodes])
        return np.sort(self.order[nodes[fit]])


def candidates(rows: DataFrame, percent: int, mode: str) -> DataFrame:
    """Pairs ``a, b`` of entities of one bucket and different classes that the trees leave.

    ``rows`` has ``shingle, lo, hi, part, entity, n, place, root, point``; a bucket is a shingle with one
    part (``lo = hi``) or two, whose rows then are paired across the parts only. A bucket's size is bounded.
    In mode ``first`` an entity gets one earlier partner in a bucket: the bucket's first row if the bounds
    allow it, else the first that its tree search finds; in mode ``best`` the one with the largest bound;
    in mode ``every`` all. Besides the counts, a pair is bounded by what follows the shared shingle in
    either order: in the bucket of its first common shingle a linked pair passes.
    """

    def pairs_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        shingle, lo, hi, part, entity, n, place, root = (
            table[c].to_numpy() for c in ("shingle", "lo", "hi", "part", "entity", "n", "place", "root")
        )
        n = n.astype(np.int64)
        points = np.frombuffer(b"".join(table["point"].to_pylist()), np.uint8).reshape(-1, GROUPS)
        new = np.append(True, (shingle[1:] != shingle[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(n)))
        begin = np.repeat(starts, sizes)

        def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            fit = (root[i] != root[j]) & ((lo[i] == hi[i]) | (part[i] != part[j]))
            fit &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            return fit & (np.minimum(n[i] - place[i], n[j] - place[j]) >= needed(n[i], n[j], percent))

        def bound(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """The counts' bound where it allows a link, else 0."""
            out = np.zeros(len(i), np.int64)
            left = np.flatnonzero(may(i, j))
            for some in np.array_split(left, len(left) // 25_000 + 1):
                low = np.minimum(points[i[some]], points[j[some]])
                both = BOUND[low].sum(1) if len(low) and low.max() > 100 else low.sum(1, dtype=np.int64)
                out[some] = np.where(both >= needed(n[i[some]], n[j[some]], percent), both, 0)
            return out

        at = np.arange(len(n))
        mixed = np.repeat(np.maximum.reduceat(root, starts) != np.minimum.reduceat(root, starts), sizes)
        asks = (at > begin) & mixed
        left, right = [], []
        if mode == "first":
            fit = bound(begin, at) > 0
            left, right = [begin[fit]], [at[fit]]
            asks &= ~fit & (root != root[begin])
        asked = np.flatnonzero(asks & (np.repeat(sizes, sizes) <= SMALL))
        for some in np.array_split(asked, len(asked) // 20_000 + 1):
            count = some - begin[some]
            i = np.repeat(some, count)
            j = begin[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            both = bound(i, j)
            good = both > 0
            i, j, both = i[good], j[good], both[good]
            if mode != "every" and len(i):
                order = np.lexsort((j, -both if mode == "best" else j, i))
                i, j = i[order], j[order]
                one = np.append(True, i[1:] != i[:-1])
                i, j = i[one], j[one]
            left.append(j)
            right.append(i)
        for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            ask = np.flatnonzero(asks[start : start + size]) + start
            if not len(ask):
                continue
            values = BOUND[points[start : start + size]]
            tree = CountTree(values, n[start : start + size])
            for i in ask:
                found = tree.search(values[i - start], n[i], percent) + start
                found = found[found < i]
                found = found[may(np.full(len(found), i), found)]
                if mode == "best" and len(found):
                    found = found[[np.minimum(values[found - start], values[i - start]).sum(1).argmax()]]
                elif mode == "first":
                    found = found[:1]
                left.append(found)
                right.append(np.full(len(found), i))
        none = np.zeros(0, np.int64)
        a, b = entity[np.concatenate([none, *left])], entity[np.concatenate([none, *right])]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < 2 * PART:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = table.slice(table.num_rows - 1)
            same = pc.and_(pc.equal(table["shingle"], last["shingle"][0]), pc.and_(pc.equal(table["lo"], last["lo"][0]), pc.equal(table["hi"], last["hi"][0])))
            cut = pc.index(same, True).as_py()
            held = table.slice(cut).to_batches()
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs_of(table.slice(0, cut))], ["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs_of(pa.Table.from_batches(held))], ["a", "b"])

    ordered = rows.repartition("shingle", "lo", "hi").sortWithinPartitions("shingle", "lo", "hi", "n", "entity")
    return ordered.mapInArrow(giving_back(run), "a long, b long").distinct()


def plausible(pairs: DataFrame, entities: DataFrame, percent: int) -> DataFrame:
    """The pairs that the bound over their fine counts leaves."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        both = np.zeros(len(a), np.int64)
        for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            x, y = BOUND[np.frombuffer(x, np.uint8)], BOUND[np.frombuffer(y, np.uint8)]
            size = min(len(x), len(y))
            both[i] = np.minimum(x.reshape(size, -1).sum(1), y.reshape(size, -1).sum(1)).sum()
        good = both >= needed(n, m, percent)
        yield {"a": a[good], "b": b[good]}

    one = entities.select(F.col("entity").alias("a"), F.col("n").alias("n_a"), F.col("fine").alias("fine_a"))
    two = entities.select(F.col("entity").alias("b"), F.col("n").alias("n_b"), F.col("fine").alias("fine_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "fine_a", "fine_b")
    return in_arrow(joined, run, "a long, b long")


def verified(pairs: DataFrame, entities: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose whole sets link, with the size of their intersection and union.

    Only documents that stand for an entity of a pair are looked up, by their ids.
    """

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for texts in text_blocks(batch.column(2), BLOCK):
            here = slice(texts.first, texts.first + texts.rows)
            one_rows, one = shingle_sets(texts, width)
            others = next(text_blocks(batch.column(3).slice(texts.first, texts.rows), 1 << 62))
            two_rows, two = shingle_sets(others, width)
            rows, values = np.concatenate([one_rows, two_rows]), np.concatenate([one, two])
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            values = _sorted_rows(values[order], rows, texts.rows)
            same = (rows[1:] == rows[:-1]) & (values[1:] == values[:-1])
            both = np.bincount(rows[1:][same], minlength=texts.rows)
            union = _sizes(one_rows, texts.rows) + _sizes(two_rows, texts.rows) - both
            good = 100 * both >= percent * union
            yield {
                "a": batch.column(0).to_numpy()[here][good],
                "b": batch.column(1).to_numpy()[here][good],
                "both": both[good],
                "either": union[good],
            }

    asked = pairs.select(F.explode(F.array("a", "b")).alias("entity")).distinct()
    asked = written(entities.join(asked, "entity").select("doc_id", "entity"), "asked")
    texts = likely_split(docs.select("doc_id", "text"), asked, "doc_id")[0].join(asked, "doc_id").select("entity", "text")
    one = texts.select(F.col("entity").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("entity").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return in_arrow(joined, run, "a long, b long, both long, either long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two documents link when ``100 * intersection >= percent * union``; ``component_id`` is the smallest
    ``doc_id`` that links reach.
    """
    counted = written(classes_of(docs, width), "classes")
    levels = frequency_levels(counted, CELLS, 4)
    classes = counted.where("seen is null").drop("seen")
    keys = written(shared_keys(prefixes_of(docs, levels, width, percent)), "keys")
    told = classes.where("entity is not null and doc_id is not null")
    vectors = [F.first(c).alias(c) for c in ("n", "point", "fine")]
    entities = written(told.groupBy("entity").agg(F.min("doc_id").alias("doc_id"), *vectors), "entities")
    points = entities.select("entity", "point")

    def links_of(rows: DataFrame, mode: str) -> DataFrame:
        pairs = written(plausible(candidates(rows, percent, mode), entities, percent), "pairs")
        return written(verified(pairs, entities, docs, width, percent).select("a", "b"), "links")

    alone = [F.col("part").alias("lo"), F.col("part").alias("hi")]
    rows = keys.select("*", *alone).join(points.withColumn("root", F.col("entity")), "entity")
    links = links_of(rows, "first")
    for mode in ("best", "every"):
        roots = written(connected(links), "roots")
        classed = points.join(roots.withColumnRenamed("node", "entity"), "entity", "left")
        rows = keys.join(classed.withColumn("root", F.coalesce("root", "entity")), "entity")
        # Buckets of one class have nothing left to find.
        mixed = rows.groupBy("shingle").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.max("part").alias("top"))
        rows = rows.join(mixed.where("r <> s").select("shingle", "top"), "shingle")
        if mode == "every":
            rows = rows.select("*", F.explode(F.sequence(F.lit(0), "top")).alias("other"))
            rows = rows.select("*", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
        else:
            rows = rows.select("*", *alone)
        links = links.unionByName(links_of(rows, mode))

    roots = connected(links)
    named = entities.select("entity", "doc_id").join(roots.withColumnRenamed("node", "entity"), "entity", "left")
    named = written(named.withColumn("root", F.coalesce("root", "entity")), "named")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = named.join(least, "root").select("entity", "component_id")
    narrow = classes.select("doc_id", "n", "entity")
    out = narrow.where("entity is not null").join(component, "entity", "left")
    empty = narrow.where("entity is null").withColumn("component_id", F.col("doc_id"))
    return out.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
