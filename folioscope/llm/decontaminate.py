"""Benchmark decontamination by greedy string tiling.

Words are compared in lower case. Karp-Rabin hashes of every run of ``min_match`` words are the seeds; a
document and a benchmark item meet where they share one. Runs of seeds on one diagonal are the common
passages. The longest is marked as a tile again and again, what it overlaps is cut down to its unmarked
parts, until no part of ``min_match`` words is left. Tiles may lie in any order, so a reordered passage
still covers its item. A document is contaminated by an item of which tiles cover ``coverage`` or more.

Items with fewer words than ``min_match`` are one seed of their own width; items without words (or null)
never match. Null and empty documents have no tile. Of equally covered items the smallest id is named;
repeated rows are judged each; columns other than those named are carried or not read.

The benchmark is sent to the tasks in blocks of at most ``BLOCK`` bytes of text, by a hash of the item;
documents pass all blocks in one narrow chain of passes without a shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Texts, in_arrow, ragged, text_blocks, window_hashes, words_of

BLOCK = 32 << 20
#: Bytes of document text that are looked up at once.
TEXT_BLOCK = 1 << 18


@dataclass
class Index:
    """Seeds of some benchmark items: for each width the sorted hashes with their items and places."""

    ids: list
    words: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def index_of(ids: list, texts: list, min_match: int) -> Index:
    seeds: dict[int, list] = {}
    block = next(text_blocks(pa.array(texts, pa.string()), 1 << 62), None)
    if block is None:
        return Index([], np.zeros(0, np.int64), {})
    words = words_of(block, lower=True)
    count = np.diff(words.offsets)
    row = words.rows()
    for width in sorted({min(min_match, int(c)) for c in count if c}):
        hashes, inside = window_hashes(words, width)
        at = np.flatnonzero(inside & (np.minimum(count, min_match)[row[: len(hashes)]] == width))
        order = at[np.argsort(hashes[at], kind="stable")]
        seeds[width] = (hashes[order], row[order], order - words.offsets[row[order]])
    return Index(ids, count, seeds)


def tile(matches: list[tuple[int, int, int]], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(document start, item start, length)`` out of maximal common passages."""
    heap = [(-length, i, j) for i, j, length in matches]
    heapq.heapify(heap)
    mine: set[int] = set()
    theirs: set[int] = set()
    tiles = []
    while heap:
        minus, i, j = heapq.heappop(heap)
        free = [i + k not in mine and j + k not in theirs for k in range(-minus)]
        if all(free):
            mine.update(range(i, i - minus))
            theirs.update(range(j, j - minus))
            tiles.append((i, j, -minus))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= min_match:
                    heapq.heappush(heap, (start - k, i + start, j + start))
                start = None
    return sorted(tiles)


def tilings(texts: Texts, index: Index) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """``(row, item number, tiles)`` for every document and item with a common seed."""
    words = words_of(texts, lower=True)
    rows = words.rows()
    for width, (seeds, item, place) in index.seeds.items():
        hashes, inside = window_hashes(words, width)
        low = np.searchsorted(seeds, hashes)
        at = np.flatnonzero(inside & (seeds[np.minimum(low, len(seeds) - 1)] == hashes))
        if not len(at):
            continue
        low = low[at]
        count = np.searchsorted(seeds, hashes[at], "right") - low
        here = np.repeat(at, count)
        step = np.arange(len(here)) - np.repeat(np.cumsum(count) - count, count)
        seed = np.repeat(low, count) + step
        row = rows[here]
        i, j = here - words.offsets[row], place[seed]
        order = np.lexsort((i, i - j, item[seed], row))
        row, which, i, j = row[order], item[seed][order], i[order], j[order]
        pair = np.append(True, (row[1:] != row[:-1]) | (which[1:] != which[:-1]))
        new = pair | np.append(True, (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1))
        starts = np.flatnonzero(new)
        length = np.diff(np.append(starts, len(row))) + width - 1
        cuts = np.append(np.flatnonzero(pair[starts]), len(starts))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            some = starts[a:b]
            runs = list(zip(i[some].tolist(), j[some].tolist(), length[a:b].tolist(), strict=True))
            yield int(row[some[0]]), int(which[some[0]]), tile(runs, width)


def indexes(benchmark: DataFrame, min_match: int) -> Iterator[Index]:
    """The benchmark in blocks of bounded size."""
    size = benchmark.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    blocks = -(-size // BLOCK)
    for k in range(blocks):
        rows = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        yield index_of(rows["item_id"].to_pylist(), rows["text"].to_pylist(), min_match)


def common_tiles(docs: DataFrame, benchmark: DataFrame, min_match: int = 5) -> DataFrame:
    """``doc_id, item_id, item_words, covered, doc_starts, item_starts, lengths`` of every pair with a tile."""
    schema = "doc_id long, item_id long, item_words long, covered long, doc_starts array<int>, item_starts array<int>, lengths array<int>"

    def of(index: Index) -> DataFrame:
        def run(batch: pa.RecordBatch) -> Iterator[dict]:
            for texts in text_blocks(batch.column(1), TEXT_BLOCK):
                found = list(tilings(texts, index))
                tiles = np.array([t for _, _, some in found for t in some], np.int64).reshape(-1, 3)
                count = np.array([len(some) for _, _, some in found], np.int64)
                yield {
                    "doc_id": batch.column(0).take(pa.array([texts.first + r for r, _, _ in found], pa.int64())),
                    "item_id": pa.array([index.ids[k] for _, k, _ in found], pa.int64()),
                    "item_words": pa.array([int(index.words[k]) for _, k, _ in found], pa.int64()),
                    "covered": pa.array([sum(t[2] for t in some) for _, _, some in found], pa.int64()),
                    **{name: ragged(tiles[:, c], count, pa.int32()) for c, name in enumerate(("doc_starts", "item_starts", "lengths"))},
                }

        return in_arrow(docs.select("doc_id", "text"), run, schema)

    parts = [of(index) for index in indexes(benchmark, min_match)]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _worst(texts: Texts, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row: highest coverage, number of items it is reached by, that item's number, and tiles."""
    share, item, tiles = np.zeros(texts.rows), np.full(texts.rows, -1), np.zeros(texts.rows, np.int64)
    for row, which, some in tilings(texts, index):
        part = sum(t[2] for t in some) / index.words[which]
        if part > share[row] or part == share[row] and item[row] >= 0 and index.ids[which] < index.ids[item[row]]:
            share[row], item[row], tiles[row] = part, which, len(some)
    return share, item, tiles


def judge(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.6) -> DataFrame:
    """``doc_id, item_id, coverage, n_tiles, contaminated`` of every row, for the item that it covers most."""
    schema = "doc_id long, text string, item_id long, coverage double, n_tiles long"
    out = docs.select("doc_id", "text").selectExpr("*", "cast(null as long) item_id", "0D coverage", "0L n_tiles")
    for index in indexes(benchmark, min_match):
        out = in_arrow(out, _judging(index), schema)
    return out.select("doc_id", "item_id", "coverage", "n_tiles", (F.col("coverage") >= coverage).alias("contaminated"))


def _judging(index: Index) -> object:
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = np.array([*index.ids, 0], object)
        for texts in text_blocks(batch.column(1), TEXT_BLOCK):
            here = batch.slice(texts.first, texts.rows)
            share, item, tiles = _worst(texts, index)
            old = here.column(3).to_numpy()
            old_item = np.array(here.column(2).to_pylist(), object)
            both = [x is not None and k >= 0 and ids[k] < x for x, k in zip(old_item, item, strict=True)]
            better = (share > old) | ((share == old) & np.array(both, bool))
            yield {
                "doc_id": here.column(0),
                "text": here.column(1),
                "item_id": pa.array(np.where(better, ids[item], old_item).tolist(), pa.int64()),
                "coverage": np.where(better, share, old),
                "n_tiles": np.where(better, tiles, here.column(4).to_numpy()),
            }

    return run


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.6) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that no item contaminates."""
    at = docs.columns.index("text")
    for index in indexes(benchmark, min_match):

        def run(batch: pa.RecordBatch, index: Index = index) -> Iterator[pa.Table]:
            good = [_worst(texts, index)[0] < coverage for texts in text_blocks(batch.column(at), TEXT_BLOCK)]
            if good:
                yield pa.Table.from_batches([batch.filter(pa.array(np.concatenate(good)))])

        docs = in_arrow(docs, run, docs.schema)
    return docs
