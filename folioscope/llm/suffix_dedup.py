"""Substring deduplication by a hash-compared suffix sort.

A byte goes if a string of ``window`` bytes that covers it starts anywhere else too. Runs of windows whose
whole context is repeated are settled by counting. For the others, one context per class, a task sorts the
suffixes that begin at the anchors, and the reversed prefixes that end there: a merge sort in which two
suffixes are compared by a binary search for their common extension over prefix hashes, so a comparison
takes logarithmic time. Neighbours' common extensions are verified on the bytes themselves, and give, for
every distance of a window from its anchor, the groups of contexts that agree on the left and on the right;
a window is repeated where two contexts agree on both.

Anchors with more than ``PART`` classes are dealt over several tasks by a salt; their windows are compared
across the parts by grouped counts of window hashes.

Null is the empty text. Texts shorter than a window lose nothing. Equal rows are each other's repetition;
rows without an id, or with one id, are told apart by their texts, other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.repeats import Units, keyed, merged, per_document, repeats, runs_table
from folioscope.llm.shared import BYTES, SECOND, Texts, in_arrow, likely_split, mix, streamed, text_blocks, written

U = np.uint64
PART = 2048
FLUSH = 6144


def _bytes(texts: Texts) -> Units:
    return Units(texts.data, texts.offsets)


class Suffixes:
    """Equal-length rows of bytes (padded, with true lengths), sorted by merge sort on hash comparisons."""

    def __init__(self, group: np.ndarray, rows: np.ndarray, length: np.ndarray):
        self.group, self.rows, self.length = group, rows, length
        width = rows.shape[1]
        self.base = np.arange(len(rows)) * width
        self.sums = BYTES.prefixes(rows.ravel())

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes ``a`` and ``b``, by binary search over hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        x, y = self.base[a], self.base[b]
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            same = BYTES.ranges(self.sums, x, x + middle) == BYTES.ranges(self.sums, y, y + middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, np.maximum(middle - 1, low))

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix ``a`` sorts before ``b``: by group, then bytes, then length."""
        lcp = self.common(a, b)
        end_a, end_b = lcp == self.length[a], lcp == self.length[b]
        at = np.minimum(lcp, self.rows.shape[1] - 1)
        less = np.where(end_a, ~end_b, ~end_b & (self.rows[a, at] < self.rows[b, at]))
        return (self.group[a] < self.group[b]) | ((self.group[a] == self.group[b]) & less)

    def order(self) -> np.ndarray:
        """All suffixes in order. Each round merges neighbouring runs by ranking every one in the other run."""
        n = len(self.rows)
        out = np.argsort(self.group, kind="stable")
        run = 1
        while run < n:
            at = np.arange(n)
            mine = at // run
            other = mine ^ 1
            low, high = np.minimum(other * run, n), np.minimum(other * run + run, n)
            first = low.copy()
            left = mine % 2 == 0
            while True:
                some = np.flatnonzero(low < high)
                if not len(some):
                    break
                middle = (low[some] + high[some]) // 2
                a, b = out[middle], out[at[some]]
                # Equal ones keep their order: the left run's go first.
                goes = np.where(left[some], self.before(a, b), ~self.before(b, a))
                low[some] = np.where(goes, middle + 1, low[some])
                high[some] = np.where(goes, high[some], middle)
            place = at % run + (low - first) + (mine // 2) * 2 * run
            following = np.empty_like(out)
            following[place] = out
            out = following
            run *= 2
        return out


def neighbours(group: np.ndarray, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order, and the verified common extension of each suffix with the one before it (-1: other group)."""
    suffixes = Suffixes(group, rows, length)
    order = suffixes.order()
    lcp = np.full(len(order), -1, np.int64)
    for attempt in range(2):
        a, b = order[:-1], order[1:]
        differs = rows[a] != rows[b]
        true = np.minimum(np.where(differs.any(1), differs.argmax(1), rows.shape[1]), np.minimum(length[a], length[b]))
        if attempt or (true == suffixes.common(a, b)).all():
            lcp[1:] = np.where(group[a] == group[b], true, -1)
            return order, lcp
        # Two hashes collided: sort by the bytes.
        order = np.array(sorted(range(len(rows)), key=lambda i: (group[i], rows[i, : length[i]].tobytes())), np.int64)
    raise AssertionError


def repeated_windows(group: np.ndarray, context: list[bytes], left: np.ndarray, windows: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each context and distance of a window from the anchor, whether another of the group has it too."""
    n, most = len(context), window - anchor
    size = np.array([len(c) for c in context], np.int64)
    reach = size - left
    right_rows = np.zeros((n, window), np.uint8)
    left_rows = np.zeros((n, most + 1), np.uint8)
    for i, text in enumerate(context):
        data = np.frombuffer(text, np.uint8)
        right_rows[i, : reach[i]] = data[left[i] :][:window]
        left_rows[i, : left[i]] = data[: left[i]][::-1]
    right_order, right_lcp = neighbours(group, right_rows, np.minimum(reach, window))
    left_order, left_lcp = neighbours(group, left_rows, left)
    out = np.zeros((n, most + 1), bool)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for distance in range(most + 1):
        has = np.flatnonzero((distance <= left) & (distance > left - windows))
        if len(has) < 2:
            continue
        right_class[right_order] = np.cumsum(right_lcp < window - distance)
        left_class[left_order] = np.cumsum(left_lcp < distance)
        key = left_class[has] * (n + 1) + right_class[has]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        out[has, distance] = count[back] > 1
    return out


def _contexts(docs: DataFrame, open_: DataFrame, window: int) -> DataFrame:
    """The rows of ``open_`` with ``text``, the bytes that their windows cover."""
    wanted = written(open_.groupBy("copy", "doc").agg(F.collect_list(F.struct("anchor", "size", "n", "start", "windows", "left")).alias("runs")), "wanted")
    some, _ = likely_split(keyed(docs), wanted, "copy")
    joined = some.join(wanted, ["copy", "doc"]).select("doc", F.col("text").cast("binary").alias("text"), "runs", "copy")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py() or b""
            rows = pa.Table.from_struct_array(batch.column(2).slice(i, 1).flatten())
            ends = rows["start"].to_numpy() + rows["windows"].to_numpy() - 1 + window
            yield {
                **{c: rows[c] for c in rows.column_names},
                "doc": np.full(rows.num_rows, batch.column(0)[i].as_py()),
                "copy": np.full(rows.num_rows, batch.column(3)[i].as_py()),
                "text": pa.array([text[a:b] for a, b in zip(rows["start"].to_numpy().tolist(), ends.tolist(), strict=True)], pa.binary()),
            }

    return in_arrow(joined, run, "anchor long, size long, n long, doc long, copy long, start int, windows int, left int, text binary")


def _sorted_windows(contexts: DataFrame, window: int, anchor: int) -> DataFrame:
    """Spans repeated within a part, and for anchors in several parts the hashes of the other windows.

    ``kind`` is ``span`` (``start``, ``end``) or ``window`` (``start``, hashes ``one`` and ``two``, ``alone``:
    whether it is not settled yet). One window of each value stands for a part.
    """
    schema = "doc long, copy long, kind string, start int, end int, one long, two long, alone boolean"

    def settle(table: pa.Table) -> Iterator[dict]:
        parts = table["part"].to_numpy()
        group = np.unique(np.stack([table["anchor"].to_numpy(), parts], 1), axis=0, return_inverse=True)[1].ravel()
        context = table["text"].to_pylist()
        doc, copy, start, windows, left, n = (table[c].to_numpy() for c in ("doc", "copy", "start", "windows", "left", "n"))
        found = repeated_windows(group, context, left.astype(np.int64), windows.astype(np.int64), window, anchor)
        found |= (n > 1)[:, None]
        i, distance = np.nonzero(found)
        inside = (distance <= left[i]) & (distance > left[i] - windows[i]) & (n[i] == 1)
        i, begin = i[inside], (start[i] + left[i] - distance)[inside]
        yield {"doc": doc[i], "copy": copy[i], "kind": pa.array(["span"] * len(i)), "start": begin, "end": begin + window}
        several = np.flatnonzero(table["size"].to_numpy() > PART)
        for k in several:
            data = np.frombuffer(context[k], np.uint8)
            at = np.arange(windows[k])
            one, two = (mix(r.ranges(r.prefixes(data), at, at + window)) for r in (BYTES, SECOND))
            alone = ~found[k, left[k] - at]
            yield {
                "doc": np.full(len(at), doc[k]), "copy": np.full(len(at), copy[k]), "kind": pa.array(["window"] * len(at)), "start": start[k] + at,
                "end": start[k] + at + window, "one": one.view(np.int64), "two": two.view(np.int64), "alone": alone,
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < FLUSH:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([table["anchor"].to_numpy(), table["part"].to_numpy()])
            same = (key == key[:, -1:]).all(0)
            cut = int(np.argmax(same))
            held = table.slice(cut).to_batches()
            while cut:  # whole groups, not many more than FLUSH rows at a time
                take = min(cut, FLUSH)
                if take < cut:
                    edge = (key[:, :take] == key[:, take : take + 1]).all(0)
                    take = int(np.argmax(edge)) if edge.any() else take
                    take = take or int(np.argmax((key[:, : cut] != key[:, :1]).any(0))) or cut
                yield from settle(table.slice(0, take))
                table, key, cut = table.slice(take), key[:, take:], cut - take
        if held:
            yield from settle(pa.Table.from_batches(held))

    salts = F.ceil(F.col("size") / F.lit(PART)).cast("int")
    dealt = contexts.withColumn("part", F.when(F.col("size") > PART, F.pmod(F.xxhash64("doc", "copy", "start"), salts)).otherwise(0).cast("int"))
    ordered = dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return streamed(ordered, run, schema)


def repeated_spans(docs: DataFrame, window: int = 400, anchor: int | None = None) -> DataFrame:
    """``doc, copy, start, end``: byte ranges covered by repeated windows; they may overlap and touch."""
    anchor = anchor or window // 2
    found = repeats(runs_table(docs, _bytes, window, anchor, BYTES))
    common = found.classes.where("n > 1").select("anchor", "context")
    whole = found.members.join(common, ["anchor", "context"]).selectExpr("doc", "copy", "start", f"start + windows - 1 + {window} as end")
    settled = written(_sorted_windows(_contexts(docs, found.open, window), window, anchor), "settled")
    others = settled.where("kind = 'window'")
    again = written(others.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    late = others.where("alone").join(again, ["one", "two"])
    columns = ["doc", "copy", "start", "end"]
    return whole.unionByName(settled.where("kind = 'span'").select(*columns)).unionByName(late.select(*columns))


def remove_repeats(docs: DataFrame, window: int = 400) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` of every row; ``kept`` is the text that is left.

    Removal may cut a character; its remaining bytes are in ``kept`` (binary) as they are.
    """
    spans = written(per_document(repeated_spans(docs, window)), "spans")
    some, rest = likely_split(keyed(docs), spans, "copy")
    joined = some.join(spans, ["copy", "doc"], "left").select("doc_id", "text", "starts", "ends")
    rest = rest.selectExpr("doc_id", "text", "cast(null as array<int>) starts", "cast(null as array<int>) ends")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for texts in text_blocks(batch.column(1)):
            kept, removed, count = [], [], []
            for k in range(texts.rows):
                text = texts.data[texts.offsets[k] : texts.offsets[k + 1]].tobytes()
                starts, ends = (batch.column(c)[texts.first + k].values for c in (2, 3))
                a, b = merged(starts.to_numpy(), ends.to_numpy()) if starts is not None else ((), ())
                pieces, at = [], 0
                for x, y in zip(a, b, strict=True):
                    pieces.append(text[at:x])
                    at = y
                kept.append(b"".join([*pieces, text[at:]]))
                removed.append(len(text) - len(kept[-1]))
                count.append(len(a))
            yield {
                "doc_id": batch.column(0).slice(texts.first, texts.rows),
                "n_bytes": np.diff(texts.offsets),
                "n_removed": removed,
                "n_spans": count,
                "kept": pa.array(kept, pa.binary()),
                "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept],
            }

    return in_arrow(joined.unionByName(rest), run, schema)
