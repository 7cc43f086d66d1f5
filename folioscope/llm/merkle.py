"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words.

A text is cut into leaves: a leaf ends at the end of a sentence, at a line end, or after eight words, and
keeps its white space, so the leaves make up the text. Lines are paragraphs; a section ends at an empty
line or after a paragraph whose hash says so, which keeps cuts in place when text before them changes.
Every node is a 128-bit hash of its children in order. Equal texts have equal roots; where roots differ,
only branches that differ have to be followed down to the edited leaves.

A fingerprint is the root and a short code for each leaf. Two fingerprints with one root have likeness 1,
others the share of leaves that they have in common (twice the common ones, by the leaves of both).

Null is the empty text, a tree without leaves. Repeated rows have equal fingerprints; other columns are
not read. For the edited text, rows of one id stand in the order of their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import BYTES, SECOND, WORDS, Texts, in_arrow, mix, streamed, text_blocks, words_of, written

U = np.uint64
LEAF_WORDS = 8
ROWS_BYTES = 1 << 20


@dataclass
class Tree:
    """Nodes of all texts of a block, level by level; ``*_of`` is the parent's number, rows for sections."""

    leaf_start: np.ndarray
    leaf_end: np.ndarray
    leaf: np.ndarray
    paragraph_of: np.ndarray
    section_of: np.ndarray
    row_of: np.ndarray
    paragraph: np.ndarray
    section: np.ndarray
    root: np.ndarray

    def leaf_rows(self) -> np.ndarray:
        return self.row_of[self.section_of[self.paragraph_of]]


def _starts(parent: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if len(parent) else np.zeros(0, np.int64)


def _above(children: np.ndarray, starts: np.ndarray, level: int) -> np.ndarray:
    """Two 64-bit hashes for each run of children; ``children`` has two rows."""
    ends = np.append(starts[1:], children.shape[1]).astype(np.int64)
    out = np.zeros((2, len(starts)), U)
    for k, roller in enumerate((WORDS, SECOND)):
        sums = roller.prefixes(children[k])
        out[k] = mix(roller.ranges(sums, starts, ends) + (ends - starts).astype(U) * U(8) + U(level))
    return out


def trees_of(texts: Texts) -> Tree:
    """The trees of all rows of a block."""
    data, offsets = texts.data, texts.offsets
    words = words_of(texts, lower=False)
    row = words.rows()
    lines = np.append(0, np.cumsum(data == 10))
    new_row = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    gap = np.zeros(len(row), np.int64)
    hard = new_row.copy()
    if len(row):
        gap[1:] = lines[words.start[1:]] - lines[words.end[:-1]]
        ended = np.isin(data[words.end - 1], [33, 46, 63])
        hard[1:] |= ended[:-1] | (gap[1:] > 0)
    at = np.arange(len(row))
    since = at - np.maximum.accumulate(np.where(hard, at, 0)) if len(row) else at
    begin = np.flatnonzero(hard | (since % LEAF_WORDS == 0))
    # The first leaf of a row starts with the row; rows of white space alone are one leaf.
    start = np.where(new_row[begin], offsets[:-1][row[begin]], words.start[begin])
    leaf_row, leaf_gap = row[begin], np.where(new_row[begin], 1, gap[begin])
    blank = np.setdiff1d(np.flatnonzero(np.diff(offsets) > 0), leaf_row)
    if len(blank):
        start, leaf_row = np.append(start, offsets[blank]), np.append(leaf_row, blank)
        leaf_gap = np.append(leaf_gap, np.ones(len(blank), np.int64))
        order = np.argsort(start, kind="stable")
        start, leaf_row, leaf_gap = start[order], leaf_row[order], leaf_gap[order]
    end = np.append(start[1:], len(data))
    leaf = np.stack([mix(r.ranges(r.prefixes(data), start, end) + (end - start).astype(U)) for r in (BYTES, SECOND)])
    first_of_row = np.append(True, leaf_row[1:] != leaf_row[:-1]) if len(leaf_row) else np.zeros(0, bool)
    cut = first_of_row | (leaf_gap > 0)
    paragraph_of = np.cumsum(cut) - 1
    heads = np.flatnonzero(cut)
    paragraph = _above(leaf, heads, 1)
    closes = np.append(False, paragraph[0][:-1] % U(4) == 0) if len(heads) else np.zeros(0, bool)
    cut = first_of_row[heads] | (leaf_gap[heads] > 1) | closes
    section_of = np.cumsum(cut) - 1
    tops = np.flatnonzero(cut)
    section = _above(paragraph, tops, 2)
    row_of = leaf_row[heads[tops]]
    root = np.zeros((2, texts.rows), U)
    root[:, row_of[_starts(row_of)]] = _above(section, _starts(row_of), 3)
    return Tree(start, end, leaf, paragraph_of, section_of, row_of, paragraph, section, root)


def _bytes_hex(values: np.ndarray, digits: int) -> str:
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - digits // 2 :].tobytes().hex()


@dataclass
class Prints:
    """Fingerprints of some texts: strings, roots, and the codes of their leaves by row."""

    text: list[str]
    root: np.ndarray
    row: np.ndarray
    code: np.ndarray

    def part(self, start: int, end: int) -> Prints:
        some = slice(*np.searchsorted(self.row, [start, end]))
        return Prints(self.text[start:end], self.root[:, start:end], self.row[some] - start, self.code[some])


def prints_of(texts: list[str]) -> Prints:
    block = next(text_blocks(pa.array(texts, pa.string()), 1 << 62))
    tree = trees_of(block)
    rows = tree.leaf_rows()
    code = tree.leaf[0] & U(0xFFFFFF)
    cuts = np.searchsorted(rows, np.arange(block.rows + 1)) * 6
    leaves = _bytes_hex(code, 6)
    roots = _bytes_hex(np.ascontiguousarray(tree.root.T).ravel(), 16)
    out = [f"{roots[32 * i : 32 * i + 32]}.{leaves[cuts[i] : cuts[i + 1]]}" for i in range(block.rows)]
    return Prints(out, tree.root, rows, code)


def likeness(one: Prints, two: Prints) -> np.ndarray:
    """Likeness of the fingerprints of one row each."""
    n = one.root.shape[1]
    found = []
    for side in (one, two):
        key, count = np.unique((side.row.astype(U) << U(24)) | side.code, return_counts=True)
        found.append((key, count))
    (a, count_a), (b, count_b) = found
    key, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = np.bincount((key >> U(24)).astype(np.int64), np.minimum(count_a[i], count_b[j]), n)
    total = np.bincount(one.row, minlength=n) + np.bincount(two.row, minlength=n)
    share = 2 * both / np.maximum(total, 1)
    return np.where((one.root == two.root).all(0), 1.0, np.minimum(share, 1 - 1e-9))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row; one pass without a shuffle."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for texts in text_blocks(batch.column(1), ROWS_BYTES):
            some = batch.column(1).slice(texts.first, texts.rows).fill_null("").to_pylist()
            yield {
                "doc_id": batch.column(0).slice(texts.first, texts.rows),
                "n_chars": [len(t) for t in some],
                "fingerprint": prints_of(some).text,
            }

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_chars long, fingerprint string")


def nodes(docs: DataFrame) -> DataFrame:
    """Every leaf with its branch: ``doc_id, root, section, paragraph, leaf, start, end`` (byte range)."""
    schema = "doc_id long, root string, section string, paragraph string, leaf string, start long, end long"

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for texts in text_blocks(batch.column(1), ROWS_BYTES):
            tree = trees_of(texts)
            section_of = tree.section_of[tree.paragraph_of]
            rows = tree.row_of[section_of]

            def named(level: np.ndarray, at: np.ndarray) -> list[str]:
                names = _bytes_hex(np.ascontiguousarray(level.T).ravel(), 16)
                return [names[32 * i : 32 * i + 32] for i in at.tolist()]

            yield {
                "doc_id": batch.column(0).take(pa.array(rows + texts.first)),
                "root": named(tree.root, rows),
                "section": named(tree.section, section_of),
                "paragraph": named(tree.paragraph, tree.paragraph_of),
                "leaf": named(tree.leaf, np.arange(len(rows))),
                "start": tree.leaf_start - texts.offsets[rows],
                "end": tree.leaf_end - texts.offsets[rows],
            }

    return in_arrow(docs.select("doc_id", "text"), run, schema)


def edited_leaves(old: DataFrame, new: DataFrame) -> DataFrame:
    """Leaves of ``new`` that ``old`` (both from ``nodes``) does not have in the document of that id.

    Documents with equal roots, then sections and paragraphs with equal hashes, are left out on the way.
    """
    rest = new
    for level in (["root"], ["section"], ["paragraph"], ["leaf"]):
        keys = ["doc_id", *level]
        rest = rest.join(old.select(*keys).distinct(), keys, "left_anti")
    return rest.select("doc_id", "leaf", "start", "end")


def _edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str]) -> Iterator[dict]:
    """Results for all rows but the last, each against the one that follows it."""
    at = 0
    while at < len(ids) - 1:
        end, size = at, 0
        while end < len(ids) - 1 and (end == at or size + len(texts[end]) <= ROWS_BYTES):
            size += len(texts[end])
            end += 1
        own = prints_of(texts[at : end + 1])
        edited = [_edited(a, b) for a, b in zip(texts[at:end], texts[at + 1 : end + 1], strict=True)]
        changed = prints_of(edited)
        here, following = own.part(0, end - at), own.part(1, end - at + 1)
        yield {
            "doc_id": pa.array(ids[at:end], pa.int64()),
            "n_chars": [len(t) for t in texts[at:end]],
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": here.text,
            "edited_fingerprint": changed.text,
            "near_edited": likeness(here, changed),
            "near_next": likeness(here, following),
        }
        at = end


def against_next(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint against its edited text's and the next document's.

    Rows are dealt and sorted by ranges of ``doc_id``; a task compares neighbours as they stream by. The
    first and the last row of each range are handed on: the last one meets the first of the next range.
    """
    schema = f"{COLUMNS}, range int, edge string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        here = TaskContext.get().partitionId()
        held = None

        def edge(kind: str, row: tuple) -> dict:
            return {"doc_id": pa.array([row[0]], pa.int64()), "range": pa.array([here], pa.int32()), "edge": [kind], "text": [row[1]]}

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            if not ids:
                continue
            if held is None:
                yield edge("first", (ids[0], texts[0]))
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            yield from _compared(ids, texts)
            held = (ids[-1], texts[-1])
        if held is not None:
            yield edge("last", held)

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = written(streamed(ranged, run, schema), "fingerprints")
    firsts = rows.where("edge = 'first'").select("range", "text")
    lasts = rows.where("edge = 'last'").select("range", "doc_id", "text")
    # Numbers of the ranges only: a row for each range.
    order = firsts.select("range").withColumn("following", F.lead("range").over(Window.orderBy("range")))
    order = order.withColumn("following", F.coalesce("following", F.min("range").over(Window.partitionBy(F.lit(1)))))
    pairs = lasts.join(order, "range").join(firsts.select(F.col("range").alias("following"), F.col("text").alias("next_text")), "following")

    def meet(batch: pa.RecordBatch) -> Iterator[dict]:
        for i in range(batch.num_rows):
            yield from _compared([batch.column(0)[i].as_py(), None], [batch.column(1)[i].as_py(), batch.column(2)[i].as_py()])

    ends = in_arrow(pairs.select("doc_id", "text", "next_text"), meet, COLUMNS)
    return rows.where("edge is null").select(*ends.columns).unionByName(ends)

