"""Token counts by a compiled finite-state tokenizer.

The split into pieces of a byte-level BPE (contractions, letters, numbers, marks, white space) is compiled
into a deterministic transducer over classes of characters. With one class more for what the next
characters are (a blank before a word, an apostrophe before a contraction) it needs no look-ahead, and
each transition says whether a piece begins. A text is cut into chunks of equal size; each chunk is first
run from all states at once, which gives its map from states to states; the maps are composed by a
parallel prefix scan, so every chunk knows its state, and a second run from it emits the pieces.

A finished piece emits its number of tokens: the transducer's output for the piece, compiled on demand by
the library's merges, once per piece and worker. Texts that hold a special token's string are cut at it
first, as the library does by default; the string itself is one token.

Null and empty texts have no token. Repeated rows are counted each; other columns are not read.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import BYTES, Texts, in_arrow, mix, text_blocks

CHUNK = 64
STATES = 8
START, LETTERS, NUMBERS, MARKS, BLANK, SPACES, LAST_ONE, LAST_TWO = range(STATES)
#: Classes of characters; an apostrophe and white space are told apart by what follows.
LETTER, NUMBER, MARK, SHORT, LONG, BLANK_BEFORE, SPACE_BEFORE, SPACE_WITHIN = range(8)
CLASSES = 8


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """Letter, number, white space (as SPACE_WITHIN) or mark for every code point."""
    out = np.full(0x110000, MARK, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            out[code] = LETTER
        elif kind == "N":
            out[code] = NUMBER
    spaces = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[spaces] = SPACE_WITHIN
    return out


@lru_cache(1)
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, for ``state * 2 * CLASSES + class``.

    The second half of the classes is the same character as the first of a text: its state does not count.
    """
    following = np.zeros((STATES, 2 * CLASSES), np.uint8)
    begins = np.zeros((STATES, 2 * CLASSES), bool)
    run = {LETTER: LETTERS, NUMBER: NUMBERS, MARK: MARKS, SHORT: MARKS, LONG: MARKS}
    for told in range(STATES):
        for kind in range(2 * CLASSES):
            state, c = (START if kind >= CLASSES else told), kind % CLASSES
            begin = True
            if c in (LETTER, NUMBER, MARK, SHORT, LONG):
                goes_on = state in (run[c], BLANK)
                if state == LAST_ONE and c == LETTER:
                    begin, to = False, START
                elif state == LAST_TWO and c == LETTER:
                    begin, to = False, LAST_ONE
                elif goes_on:
                    begin, to = False, run[c]
                else:
                    to = {SHORT: LAST_ONE, LONG: LAST_TWO}.get(c, run[c])
            elif c == BLANK_BEFORE:
                to = BLANK
            elif c == SPACE_BEFORE:
                to = START
            else:
                begin, to = state != SPACES, SPACES
            following[told, kind], begins[told, kind] = to, begin
    return following.ravel(), begins.ravel()


def classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Class of every character; ``first`` marks those that begin a text."""
    kind = code_point_classes()[points]
    n = len(points)
    new = np.append(first[1:], True)
    space = kind == SPACE_WITHIN
    solid_next = np.append(~space[1:], False) & ~new
    kind[space & solid_next] = SPACE_BEFORE
    kind[space & solid_next & (points == 0x20)] = BLANK_BEFORE
    for at in (np.flatnonzero(points == 0x27),):
        one = np.where(at + 1 < n, points[np.minimum(at + 1, n - 1)], 0) * ~new[at]
        two = np.where(at + 2 < n, points[np.minimum(at + 2, n - 1)], 0) * ~new[at] * ~new[np.minimum(at + 1, n - 1)]
        kind[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        kind[at[np.any([(one == a) & (two == b) for a, b in pairs], axis=0)]] = LONG
    kind[first] += CLASSES
    return kind


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each character begins a piece, by chunk maps and their prefix scan."""
    n = len(points)
    following, begins = transducer()
    chunks = -(-n // CHUNK)
    kind = np.zeros(chunks * CHUNK, np.uint8)
    kind[:n] = classes(points, first)
    kind = kind.reshape(chunks, CHUNK).T.copy()
    wide = 2 * CLASSES
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for step in range(CHUNK):
        maps = following[maps.astype(np.intp) * wide + kind[step][:, None]]
    reach = 1
    while reach < chunks:  # maps[k] becomes the map of chunks 0 to k
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), 1)
        reach *= 2
    state = np.append(np.uint8(START), maps[:-1, START])
    out = np.zeros((CHUNK, chunks), bool)
    for step in range(CHUNK):
        at = state.astype(np.intp) * wide + kind[step]
        out[step] = begins[at]
        state = following[at]
    return out.T.ravel()[:n]


class Counter:
    """Tokens per piece, kept by the hash of its bytes."""

    LIMIT = 2_000_000
    loaded: dict[str, Counter] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[int, int] = {}

    @classmethod
    def at(cls, path: str) -> Counter:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def counts(self, hashes: np.ndarray, text: object) -> np.ndarray:
        if len(self.known) > self.LIMIT:
            self.known = {}
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        get = self.known.get
        count = np.fromiter((get(h, -1) for h in unique.tolist()), np.int64, len(unique))
        new = np.flatnonzero(count < 0)
        if len(new):
            coded = self.tokenizer.encode_batch([text(i) for i in first[new].tolist()], add_special_tokens=False)
            count[new] = [len(c.ids) for c in coded]
            self.known.update(zip(unique[new].tolist(), count[new].tolist(), strict=True))
        return count[back]


def row_counts(texts: Texts, counter: Counter) -> np.ndarray:
    """Tokens of every row."""
    out = np.zeros(texts.rows, np.int64)
    data, offsets = texts.data, texts.offsets
    if not len(data):
        return out
    raw = data.tobytes()
    parts = np.array([], np.int64)
    if any(s.encode() in raw for s in counter.special):
        parts, drop = _cut_at_special(raw, offsets, counter.special, out)
        keep = np.ones(len(data), bool)
        for a, b in drop:
            keep[a:b] = False
        shift = np.append(0, np.cumsum(keep))
        data, offsets, parts = data[keep], shift[offsets], shift[parts]
        raw = data.tobytes()
        if not len(data):
            return out
    points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # where each character begins
    starts = np.concatenate([offsets[:-1][np.diff(offsets) > 0], parts])
    first = np.zeros(len(points), bool)
    first[np.searchsorted(lead, starts[starts < len(data)])] = True
    begin = lead[piece_starts(points, first)]
    end = np.append(begin[1:], len(data))
    hashes = mix(BYTES.ranges(BYTES.prefixes(data), begin, end) + (end - begin).astype(np.uint64))
    count = counter.counts(hashes, lambda i: raw[begin[i] : end[i]].decode())
    row = np.searchsorted(offsets, begin, "right") - 1
    return out + np.bincount(row, count, texts.rows).astype(np.int64)


def _cut_at_special(raw: bytes, offsets: np.ndarray, special: list[str], out: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Where texts go on after special strings, and the strings' ranges; each adds a token to its row."""
    pattern = re.compile(b"|".join(re.escape(s.encode()) for s in special))
    drop = []
    for row in range(len(offsets) - 1):
        for hit in pattern.finditer(raw, int(offsets[row]), int(offsets[row + 1])):
            out[row] += 1
            drop.append(hit.span())
    return np.array([b for _, b in drop], np.int64), drop


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row; one pass without a shuffle."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        counter = Counter.at(path)
        for texts in text_blocks(batch.column(1), 2 << 20):
            yield {
                "doc_id": batch.column(0).slice(texts.first, texts.rows),
                "n_bytes": np.diff(texts.offsets),
                "n_tokens": row_counts(texts, counter),
            }

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long")


def with_limit(counted: DataFrame, limit: int = 1024) -> DataFrame:
    """Adds ``over_limit``: more tokens than ``limit``."""
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
