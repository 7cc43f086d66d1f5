"""Repeated windows of many documents, found through sampled anchors.

Both substring operators ask which windows of ``window`` units (bytes or words) occur more than once. Every
window picks an anchor: the ``anchor`` consecutive units inside it that have the least hash, leftmost
first. Equal windows pick equal anchors at equal distance, so only windows with a repeated anchor can be
repeated, and a text needs one row per run of windows with one anchor, not one per window.

A run's context is all that its windows cover. Runs with equal contexts (a class) repeat window by window;
only where an anchor has several classes do windows have to be compared one by one, and one run of each
class stands for the others. Counting and classing are grouped sums with partial aggregation, so a passage
that a third of all documents hold costs a row per task and class before the shuffle.

A text is known by ``doc``, its id, and ``copy``, a 64-bit hash of its bytes, so that rows without an id, or
with one id and different texts, each have their own runs and spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Roller, Texts, in_arrow, mix, text_blocks, written

U = np.uint64
#: Stands for a document without an id.
NO_ID = -(2**63)
RUN = "anchor long, context long, doc long, copy long, start int, windows int, left int"


@dataclass
class Units:
    """The units of a block as values to hash, and where each row's units begin."""

    values: np.ndarray
    offsets: np.ndarray


@dataclass
class Runs:
    """Runs of windows with one anchor: row, first window (in units of the row), count, anchor's distance."""

    anchor: np.ndarray
    context: np.ndarray
    row: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    left: np.ndarray


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in each run of ``width`` values, by doubling."""
    at = np.arange(len(values))
    reach = 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while reach * 2 <= width:
        at = better(at[:-reach], at[reach:])
        reach *= 2
    rest = width - reach
    return better(at[:-rest], at[rest:]) if rest else at


def runs_of(units: Units, window: int, anchor: int, roller: Roller) -> Runs | None:
    """All runs of a block; rows shorter than a window have none."""
    n = len(units.values)
    if n < window:
        return None
    sums = roller.prefixes(units.values)
    at = np.arange(n - anchor + 1)
    hashes = mix(roller.ranges(sums, at, at + anchor))
    position = first_least(hashes, window - anchor + 1)
    row = np.repeat(np.arange(len(units.offsets) - 1), np.diff(units.offsets))
    inside = row[: n - window + 1] == row[window - 1 :]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (position[1:] != position[:-1]) | (row[1 : n - window + 1] != row[: n - window])
    start = np.flatnonzero(new)
    if not len(start):
        return None
    stop = np.append(start[1:], n - window + 1)
    total = np.append(0, np.cumsum(inside))
    count = total[stop] - total[start]  # windows that lie inside their row
    end = start + count - 1 + window
    context = mix(roller.ranges(sums, start, end) + (end - start).astype(U) * U(1024) + (position[start] - start).astype(U))
    rows = row[start]
    return Runs(hashes[position[start]], context, rows, start - units.offsets[rows], count, position[start] - start)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of every row, with ``doc`` and ``copy``, which its text is known by."""
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("copy"))


def runs_table(docs: DataFrame, units: Callable[[Texts], Units], window: int, anchor: int, roller: Roller) -> DataFrame:
    """Every run of every row."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        doc, copy = (batch.column(c).to_numpy() for c in (0, 1))
        for texts in text_blocks(batch.column(2), 1 << 18):
            found = runs_of(units(texts), window, anchor, roller)
            if found is not None:
                yield {
                    "anchor": found.anchor.view(np.int64),
                    "context": found.context.view(np.int64),
                    "doc": doc[texts.first + found.row],
                    "copy": copy[texts.first + found.row],
                    "start": found.start,
                    "windows": found.windows,
                    "left": found.left,
                }

    return in_arrow(keyed(docs).select("doc", "copy", "text"), run, RUN)


@dataclass
class Repeats:
    """Runs whose anchor is repeated, their classes, and the classes that share an anchor with another."""

    members: DataFrame
    classes: DataFrame
    open: DataFrame


def repeats(runs: DataFrame) -> Repeats:
    """Keep the runs with a repeated anchor, and class them. ``first`` is a class's smallest (doc, copy, start)."""
    # A table of its own leaves the join between two plain shuffles, whose large partitions Spark can split.
    anchors = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    anchors = written(anchors, "anchors")
    members = written(runs.join(anchors, "anchor"), "runs")
    least = F.min(F.struct("doc", "copy", "start", "windows", "left")).alias("first")
    classes = written(members.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), least), "classes")
    several = written(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "several")
    flat = classes.join(several, "anchor").select("anchor", "context", "n", "size", "first.*")
    return Repeats(members, classes, written(flat, "open"))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal disjoint ones; touching intervals are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.append(True, starts[1:] > ends[:-1]) if len(starts) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:], len(starts)) - 1] if len(at) else ends


def per_document(spans: DataFrame) -> DataFrame:
    """``copy, doc, starts, ends``: the spans of a text, in one row; rows repeating a text have them once."""
    gathered = spans.groupBy("copy", "doc").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return gathered.select("copy", "doc", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
