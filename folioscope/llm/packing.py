"""Best-fit packing of tokenised documents by bin completion.

Every document becomes its token ids and a closing id; only longer ones are cut, into full pieces and a
rest. What has to be packed is then a histogram: how many pieces there are of each length, at most
``max_tokens`` numbers however large the corpus is. The search works on it and returns patterns, a
filling and how often it is used:

* Take the largest length left and enumerate the undominated fillings of the room beside it: a filling is
  dominated if a larger length fits where it puts smaller ones. Larger parts come first.
* The filling with the least waste (the best fit) is used as often as the counts allow; so each step
  uses up a length, and there are at most as many steps as lengths.
* The first descent is the incumbent. Other fillings are tried at its steps, pruned as soon as their waste
  exceeds what the incumbent may lose, and the search ends when the incumbent meets the lower bound.

Pieces get their place by their rank among the pieces of their length: ranks come from counts per
length and salt, so no length is numbered in one task.

Null and empty texts are one piece with the closing id alone. Repeated rows are packed each. Other
columns are not read.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import BYTES, LOWER, SPACE, Texts, U, give_back, in_arrow, mix, smaller, text_blocks, written

Pattern = tuple[dict[int, int], int]


#: Units of ASCII fall into these parts, each a token run of its own; units with other signs are not cut here.
PARTS = re.compile(r"[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")
#: Kinds of bytes that a unit is made of: 1 for ASCII letters, digits and all other signs than ASCII, 2 for the rest, 0 for space.
KIND = np.full(256, 2, np.uint8)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[SPACE] = 0
WORD_END = "</w>"
#: Bytes of text that are tokenised at once: a unit is looked up once in each block.
BLOCK = 1 << 20
#: Bytes whose words are found at once.
RUN = 1 << 18


def parts_of(word: str) -> int:
    """How many runs of tokens a unit becomes, 0 if its whole word is left to the library."""
    if word.isascii():
        if word.isalpha():
            return 1
        return 0 if "'" in word or "<|" in word else len(PARTS.findall(word))
    return int(word.isalpha() and unicodedata.normalize("NFC", word).lower().isalpha())


class Vocabulary:
    """Token ids of units and words, worked out by the library once for each of them and worker."""

    #: In place of the number of a unit whose words are left to the library.
    LEFT = -2
    LIMIT = 1_000_000
    TOGETHER = 512
    #: Groups of words that the library is given at once: it returns far more than the ids of each.
    GROUPS = 16
    loaded: dict[str, "Vocabulary"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for name, i in names.items() if name.endswith(WORD_END)]] = True
        self.clear()

    @classmethod
    def at(cls, path: str) -> Vocabulary:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def clear(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.offsets = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64)
        self.size = 0

    def make_room(self) -> None:
        """Forget the entries when they are too many; numbers given before are void then."""
        if len(self.known) > self.LIMIT:
            self.clear()

    def numbers(self, hashes: np.ndarray, texts: Callable[[np.ndarray], list[str]], whole: bool = False) -> np.ndarray:
        """Numbers of entries for hashes; ``texts`` gives the texts at places, for those not met yet.

        A ``whole`` word is left to the library, a unit that cannot be told apart from its neighbours is ``LEFT``.
        """
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, unique)
        number = np.full(len(unique), -1)
        inside = np.flatnonzero(place < len(self.known))
        met = inside[self.known[place[inside]] == unique[inside]]
        number[met] = self.number[place[met]]
        new = np.flatnonzero(number == -1)
        if len(new):
            words = texts(first[new])
            parts = np.zeros(len(words), np.int64) if whole else np.array([parts_of(w) for w in words])
            asked = np.arange(len(words)) if whole else np.flatnonzero(parts)
            number[new] = self.LEFT
            number[new[asked]] = self.size + np.arange(len(asked))
            self._keep(*(self._alone(words) if whole else self._together([words[i] for i in asked.tolist()], parts[asked])))
            self.known = np.insert(self.known, place[new], unique[new])
            self.number = np.insert(self.number, place[new], number[new])
        return number[back]

    def _together(self, words: list[str], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their numbers, of units with known parts.

        They are encoded many at a time: the last token of every part, and no other, carries the word end.
        """
        cuts = range(0, len(words), self.TOGETHER)
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(cuts), self.GROUPS):
            some = cuts[at : at + self.GROUPS]
            coded = self.tokenizer.encode_batch_fast([" ".join(words[a : a + self.TOGETHER]) for a in some], add_special_tokens=False)
            for a, found in zip(some, coded, strict=True):
                flat = np.array(found.ids, np.uint32)
                ends = np.flatnonzero(self.ends[flat])
                last = np.cumsum(parts[a : a + self.TOGETHER]) - 1
                if len(ends) != last[-1] + 1:
                    raise RuntimeError("the tokenizer cuts words in another way")
                ids.append(flat)
                sizes.append(np.diff(ends[last], prepend=-1))
        return np.concatenate(ids), np.concatenate(sizes)

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their numbers, of words that the library cuts."""
        ids, sizes = [np.zeros(0, np.uint32)], []
        for at in range(0, len(words), self.TOGETHER):
            coded = self.tokenizer.encode_batch_fast(words[at : at + self.TOGETHER], add_special_tokens=False)
            ids += [np.array(c.ids, np.uint32) for c in coded]
            sizes += [len(c.ids) for c in coded]
        return np.concatenate(ids), np.array(sizes, np.int64)

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append to buffers that double as they fill."""
        begin = self.offsets[self.size]
        for name, need in (("flat", begin + len(ids)), ("offsets", self.size + len(sizes) + 1)):
            old = getattr(self, name)
            if need > len(old):
                grown = np.zeros(2 * int(need), old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        self.flat[begin : begin + len(ids)] = ids
        self.offsets[self.size + 1 : self.size + 1 + len(sizes)] = begin + np.cumsum(sizes)
        self.size += len(sizes)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after the other, each followed by a blank, and where each ends before it."""
    size = end - start + 1
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    flat = data[np.minimum(at, len(data) - 1)]
    flat[ends - 1] = 32
    return flat, ends - 1


@dataclass
class Units:
    """Runs of one kind of bytes inside the words of a block, in order: byte ranges, hashes without case, words.

    ``first`` marks the first unit of a word, ``row`` is the text, ``special`` marks units with signs that tie
    a word together.
    """

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray
    special: np.ndarray


def units_of(texts: Texts) -> Units:
    """The units of a block; sums over bytes are held for ``RUN`` bytes at a time only."""
    found = [np.zeros((2, 0), np.int64)]
    hashes = [np.zeros(0, U)]
    for run in smaller(texts, RUN):
        if not len(run.data):
            continue
        kind = KIND[run.data]
        new = np.append(True, kind[1:] != kind[:-1])
        cuts = run.offsets[1:-1]
        new[cuts[cuts < len(kind)]] = True
        start = np.flatnonzero(new)
        solid = kind[start] != 0
        end = np.append(start[1:], len(kind))[solid]
        start = start[solid]
        # Case of ASCII letters does not count beside other letters; words with other signs are looked at as they are.
        hashes.append(mix(BYTES.ranges(BYTES.prefixes(LOWER[run.data]), start, end) + (end - start).astype(U)))
        found.append(np.stack([start, end]) + texts.offsets[run.first])
    start, end = np.concatenate(found, axis=1)
    row = np.repeat(np.arange(texts.rows), np.diff(np.searchsorted(start, texts.offsets)))
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != end[:-1]) | (row[1:] != row[:-1])
    special = np.zeros(len(start), bool)
    tied = np.append(np.flatnonzero(texts.data == 39), np.flatnonzero((texts.data[:-1] == 60) & (texts.data[1:] == 124)))
    special[np.searchsorted(start, tied, "right") - 1] = True
    return Units(start, end, np.concatenate(hashes), row, first, special)


def token_ids(texts: Texts, vocabulary: Vocabulary, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all rows, each closed by ``end_id``, and where each row begins.

    The tokenizer drops white space and never joins over it, so a text is the ids of its words in turn. It
    cuts words between letters or digits and other ASCII signs, so a word is the ids of its units in turn;
    a word with signs of other kinds, or with those that tie it together, is looked up as a whole.
    """
    vocabulary.make_room()
    units = units_of(texts)

    def named(start: np.ndarray, end: np.ndarray) -> Callable[[np.ndarray], list[str]]:
        return lambda at: spans(texts.data, start[at], end[at])[0].tobytes()[:-1].decode().split(" ")

    word = np.cumsum(units.first) - 1
    first = np.flatnonzero(units.first)
    whole = np.zeros(len(first), bool)
    whole[word[units.special]] = True
    free = np.flatnonzero(~whole[word])
    number = np.full(len(word), vocabulary.LEFT)
    number[free] = vocabulary.numbers(units.hash[free], named(units.start[free], units.end[free]))
    whole[word[number == vocabulary.LEFT]] = True
    tied = np.flatnonzero(whole)
    row = units.row
    if len(tied):
        start, end = units.start[first[tied]], units.end[np.append(first[1:], len(word))[tied] - 1]
        hashes = np.zeros(len(tied), U)
        ends = np.cumsum(end - start)
        at = 0
        while at < len(tied):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN, "right")))
            flat, stop = spans(texts.data, start[at:to], end[at:to])
            size = end[at:to] - start[at:to]
            hashes[at:to] = mix(mix(BYTES.ranges(BYTES.prefixes(flat), stop - size, stop) + size.astype(U)))
            at = to
        kept = units.first | ~whole[word]
        number[first[tied]] = vocabulary.numbers(hashes, named(start, end), whole=True)
        number, row = number[kept], row[kept]
    size = vocabulary.offsets[number + 1] - vocabulary.offsets[number]
    row_size = np.zeros(texts.rows, np.int64)
    np.add.at(row_size, row, size)
    offsets = np.append(0, np.cumsum(row_size + 1))
    out = np.full(offsets[-1], end_id, np.uint32)
    # A token stands as many places further on as rows were closed before it.
    at = np.arange(int(size.sum()))
    source = np.repeat(vocabulary.offsets[number] - (np.cumsum(size) - size), size)
    source += at
    at += np.repeat(row, size)
    out[at] = vocabulary.flat[source]
    return out, offsets


def pieces_of(docs: DataFrame, path: str, max_tokens: int, end_id: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece; one pass without a shuffle."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        vocabulary = Vocabulary.at(path)
        for texts in text_blocks(batch.column(1), BLOCK):
            ids, offsets = token_ids(texts, vocabulary, end_id)
            ids = ids.astype("<u4")
            n = np.diff(offsets)
            count = -(-n // max_tokens)
            row = np.repeat(np.arange(texts.rows), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * max_tokens
            length = np.minimum(n[row] - start, max_tokens)
            begin = offsets[row] + start
            yield {
                "doc_id": batch.column(0).take(pa.array(row + texts.first)),
                "piece": piece,
                "start": start,
                "length": length,
                "ids_crc32": [zlib.crc32(ids[a : a + k]) for a, k in zip(begin.tolist(), length.tolist(), strict=True)],
            }
        give_back()

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fillings(room: int, counts: dict[int, int], lengths: list[int], most: int, steps: int) -> list[dict[int, int]]:
    """Undominated fillings of ``room``, the least waste first, at most ``most`` of them.

    Lengths are tried from the largest on. A filling is complete when no length left fits, so a smaller
    part never stands where a larger one would do; ``steps`` bounds the search, not the data.
    """
    found: list[tuple[int, int, dict[int, int]]] = []
    least = min((x for x in lengths if counts[x]), default=room + 1)
    stack: list[tuple[int, int, dict[int, int]]] = [(0, room, {})]
    while stack and steps > 0:
        steps -= 1
        at, left, used = stack.pop()
        if left < least or at >= len(lengths):
            found.append((left, len(found), used))
            if left == 0 and sum(x[0] == 0 for x in found) >= most:
                break
            continue
        while at < len(lengths) and (lengths[at] > left or counts[lengths[at]] == 0):
            at += 1
        if at == len(lengths):
            found.append((left, len(found), used))
            continue
        x = lengths[at]
        take = min(left // x, counts[x])
        # Exact ends first: a length equal to the room left after the larger part.
        if left - x > 0 and counts.get(left - x, 0) > (left - x == x) and left - x <= x:
            stack.append((at + 1, left, used))
            exact = dict(used)
            for y in (x, left - x):
                exact[y] = exact.get(y, 0) + 1
            found.append((0, len(found), exact))
            if sum(f[0] == 0 for f in found) >= most:
                break
            continue
        stack.append((at + 1, left, used))
        for k in range(1, take + 1):
            stack.append((at + 1, left - k * x, {**used, x: k}))
    found.sort(key=lambda f: (f[0], f[1]))
    return [f[2] for f in found[:most]] or [{}]


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by pieces too large to share with others."""
    best = -(-sum(x * n for x, n in histogram.items()) // capacity)
    for small in sorted({0, *(x for x in histogram if x <= capacity // 2)}):
        large = sum(n for x, n in histogram.items() if x > capacity - small)
        middle = {x: n for x, n in histogram.items() if capacity // 2 < x <= capacity - small}
        rest = sum(x * n for x, n in histogram.items() if small <= x <= capacity // 2)
        spare = sum((capacity - x) * n for x, n in middle.items())
        best = max(best, large + sum(middle.values()) + max(0, -(-(rest - spare) // capacity)))
    return best


def complete_bins(histogram: dict[int, int], capacity: int, budget: int = 30_000, steps: int = 3000) -> list[Pattern]:
    """Patterns ``({length: copies}, times)`` that use up the histogram in few sequences.

    ``budget`` bounds the patterns tried by the search, after a first descent that is always finished.
    """
    goal = lower_bound(histogram, capacity)
    total = sum(x * n for x, n in histogram.items())
    best: list[Pattern] = []
    best_bins = None
    # Each entry: choices made at the first steps of a descent; the rest follows the best fit.
    agenda: list[tuple[int, ...]] = [()]
    while agenda and (budget > 0 or best_bins is None):
        choices = agenda.pop(0)
        counts = dict(histogram)
        lengths = sorted((x for x in counts if counts[x]), reverse=True)
        out: list[Pattern] = []
        bins, waste, pruned = 0, 0, False
        while lengths:
            x = lengths[0]
            counts[x] -= 1
            step = len(out)
            wanted = choices[step] if step < len(choices) else 0
            options = fillings(capacity - x, counts, lengths, wanted + 1, steps)
            counts[x] += 1
            pattern = dict(options[min(wanted, len(options) - 1)])
            pattern[x] = pattern.get(x, 0) + 1
            times = min(counts[y] // k for y, k in pattern.items())
            for y, k in pattern.items():
                counts[y] -= times * k
            lengths = [y for y in lengths if counts[y]]
            out.append((pattern, times))
            budget -= 1
            bins += times
            waste += times * (capacity - sum(y * k for y, k in pattern.items()))
            # Sequences still needed cannot be fewer than the total plus the waste so far allows.
            if best_bins is not None and -(-(total + waste) // capacity) >= best_bins:
                pruned = True
                break
        if not pruned and (best_bins is None or bins < best_bins):
            best, best_bins = out, bins
            if bins <= goal:
                break
        if len(choices) < min(len(out), 24):
            free = range(min(len(out), 24) - len(choices))
            agenda.extend((*choices, *[0] * k, other) for k in free for other in (1, 2))
    return best


def slots_of(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """Where ranks go: per interval of ranks of a length its key, copies, first sequence and offset.

    There is an interval for each length of each pattern: a bound by ``max_tokens`` alone.
    """
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for x in sorted(pattern, reverse=True):
            copies = pattern[x]
            rows.append((x, used.get(x, 0), copies, sequence, offset))
            used[x] = used.get(x, 0) + copies * times
            offset += copies * x
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return (columns[0] << 40) + columns[1], columns[1], columns[2], columns[3], columns[4]


def pack(docs: DataFrame, path: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    pieces = written(pieces_of(docs, path, max_tokens, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    patterns = complete_bins(histogram, max_tokens)
    key, first, copies, sequence, offset = slots_of(patterns)
    salts = max(1, sum(histogram.values()) // 5_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counted = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counted = counted.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(counted, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        at = np.searchsorted(key, (length << 40) + rank, "right") - 1
        within = rank - first[at]
        yield {
            **{c: batch.column(k) for k, c in enumerate(columns)},
            "sequence_id": sequence[at] + within // copies[at],
            "offset": offset[at] + within % copies[at] * length,
        }

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return in_arrow(ranked.select(*columns, "rank"), run, schema)
