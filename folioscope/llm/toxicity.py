"""Toxicity by a subsequence string kernel: a support vector machine on Nystroem landmarks.

A segment (a word, a piece of a long word, or a run of single letters read as one word) is compared
with landmark words by the gap-weighted kernel over subsequences of three characters, normalised to
1 for equal segments. Gapped or padded spellings therefore keep most of their likeness. The kernel's
features are finite (32**3 triples), so the trained machine folds into one weight per triple, and a
segment's score is a sum over its own triples divided by its own norm: no landmark is visited later.

A document is as toxic as its most toxic segment (multiple-instance form). Positive segments are all those
whose texts are labelled toxic beyond chance, copies and near copies counted once, under a bound that is
cross-validated on whole texts; negative ones are frequent segments, a draw, and in each round the segment
of every clean text that scored highest. Training runs in one task, on a sample of labelled rows bounded by
``max_rows`` and ``max_bytes``.

Null and empty texts have no segment and get the score of the bias alone, below one half. Repeated
rows are scored as often as they appear; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import LOWER, Texts, give_back, in_arrow, mix, streamed, text_blocks, words_of

LETTERS = 32
WIDEST = 20
DECAY = 0.8
#: Bytes of text that are scored at once.
TEXT_BLOCK = 1 << 19
#: Letters a-z, digits, marks, and bytes of other scripts in four classes.
CLASS = np.full(256, 27, np.int64)
CLASS[97:123] = np.arange(26)
CLASS[48:58] = 26
CLASS[128:256] = 28 + np.arange(128) % 4
SOLID = np.zeros(256, bool)
SOLID[97:123] = SOLID[48:58] = SOLID[128:256] = True


@lru_cache(64)
def triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of every subsequence of three characters, and its weight by what it spans."""
    at = np.array(list(combinations(range(length), 3)), np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def features(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triple codes and weights of segments of one length (rows of character classes)."""
    at, weight = triples(segments.shape[1])
    code = (segments[:, at[:, 0]] * LETTERS + segments[:, at[:, 1]]) * LETTERS + segments[:, at[:, 2]]
    return code, weight


def norms(segments: np.ndarray) -> np.ndarray:
    """Square root of the kernel of each segment with itself, by the usual recurrence over both copies."""
    n, length = segments.shape
    same = segments[:, :, None] == segments[:, None, :]
    square = DECAY * DECAY
    inner = np.ones((n, length + 1, length + 1))
    total = np.zeros(n)
    for step in range(3):
        total = np.zeros(n)
        following = np.zeros((n, length + 1, length + 1))
        for i in range(1, length + 1):
            row = np.zeros(n)
            for j in range(1, length + 1):
                hit = same[:, i - 1, j - 1] * inner[:, i - 1, j - 1] * square
                total += hit
                row = DECAY * row + hit
                following[:, i, j] = DECAY * following[:, i - 1, j] + row
        inner = following
    return np.sqrt(total)


def dense(segments: list[bytes]) -> np.ndarray:
    """Normalised feature vectors, for the few segments that training looks at."""
    out = np.zeros((len(segments), LETTERS**3), np.float32)
    for i, text in enumerate(segments):
        code, weight = features(CLASS[np.frombuffer(text, np.uint8)][None])
        np.add.at(out[i], code[0], weight)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass
class Segments:
    """Segments of a block: a padded matrix of bytes, lengths, and the row each belongs to."""

    chars: np.ndarray
    length: np.ndarray
    row: np.ndarray


def segments_of(texts: Texts) -> Segments:
    """Each row's distinct segments of three to ``WIDEST`` bytes."""
    data = LOWER[texts.data]
    words = words_of(texts, lower=True)
    start, end, row = words.start.copy(), words.end.copy(), words.rows()
    for _ in range(3):  # marks around a word
        start += (start < end) & ~SOLID[data[np.minimum(start, len(data) - 1)]] if len(data) else 0
        end -= (start < end) & ~SOLID[data[end - 1]] if len(data) else 0
    size = end - start
    single = size == 1
    spans = [(start[size >= 3], end[size >= 3], row[size >= 3])]
    long = spans[0][1] - spans[0][0] > WIDEST
    if long.any():
        s, e, r = (x[long] for x in spans[0])
        pieces = -(-(e - s - WIDEST) // (WIDEST // 2)) + 1
        which = np.repeat(np.arange(len(s)), pieces)
        step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.minimum(s[which] + step * (WIDEST // 2), e[which] - WIDEST)
        spans = [tuple(x[~long] for x in spans[0]), (begin, begin + WIDEST, r[which])]
    start0, end0, row0 = (np.concatenate(x) for x in zip(*spans, strict=True))
    chars = np.zeros((len(start0), WIDEST), np.uint8)
    length = end0 - start0
    if len(start0):
        for k in range(WIDEST):
            inside = length > k
            chars[inside, k] = data[start0[inside] + k]
    more_chars, more_length, more_row = _spelled(data, start, row, single)
    chars = np.concatenate([chars, more_chars])
    length = np.concatenate([length, more_length])
    return Segments(chars, length, np.concatenate([row0, more_row]))


def _spelled(data: np.ndarray, start: np.ndarray, row: np.ndarray, single: np.ndarray) -> tuple:
    """Runs of three or more one-letter words of a row, read as one segment; long runs in pieces."""
    at = np.flatnonzero(single)
    if len(at) < 3:
        return np.zeros((0, WIDEST), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero((np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])) + 1
    chars, lengths, rows = [], [], []
    for run in np.split(at, breaks):
        for begin in range(0, max(1, len(run) - WIDEST // 2), WIDEST // 2) if len(run) >= 3 else ():
            part = run[begin : begin + WIDEST]
            if len(part) < 3:
                continue
            line = np.zeros(WIDEST, np.uint8)
            line[: len(part)] = data[start[part]]
            chars.append(line)
            lengths.append(len(part))
            rows.append(row[part[0]])
    if not chars:
        return np.zeros((0, WIDEST), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.array(chars), np.array(lengths, np.int64), np.array(rows, np.int64)


@dataclass
class Model:
    """One weight per triple, the machine's bias, and the sigmoid that turns its value into a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def values(self, chars: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The machine's value of each segment; equal segments are worked out once."""
        out = np.full(len(length), -1.0)
        if not len(length):
            return out
        key = np.zeros(len(length), np.uint64)
        for part in chars.view(np.uint32).T.astype(np.uint64):
            key = mix(key + part)
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        chars, length = chars[first], length[first]
        own = np.zeros(len(length))
        for size in np.unique(length):
            members = np.flatnonzero(length == size)
            at, _ = triples(int(size))
            for some in np.array_split(members, 1 + len(members) * max(len(at), 4 * (int(size) + 1) ** 2) // 1_000_000):
                classes = CLASS[chars[some, :size]]
                code, weight = features(classes)
                raw = self.weights[code] @ weight
                likely = raw > 0  # others cannot pass the bias; their value is bounded by it
                own[some] = self.bias
                if likely.any():
                    own[some[likely]] += raw[likely] / norms(classes[likely])
        return own[back]

    def scores(self, texts: Texts) -> np.ndarray:
        """Probability for each row."""
        found = segments_of(texts)
        best = np.full(texts.rows, self.bias)
        np.maximum.at(best, found.row, self.values(found.chars, found.length))
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -40, 40)))


@dataclass
class Bags:
    """Distinct segments of all training texts, and which of them each text holds."""

    names: list[bytes]
    chars: np.ndarray
    length: np.ndarray
    index: np.ndarray
    row: np.ndarray
    rows: int

    def best(self, values: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Highest value of each text and the segment that has it (-1: none)."""
        order = np.lexsort((values[self.index], self.row))
        last = np.searchsorted(self.row[order], np.arange(self.rows), "right") - 1
        has = np.isin(np.arange(self.rows), self.row)
        which = np.where(has, self.index[order[last]] if len(order) else -1, -1)
        return np.where(has, values[which] if len(values) else floor, floor), which


def bags_of(texts: list[str]) -> Bags:
    chars, lengths, rows, at = [], [], [], 0
    for block in text_blocks(pa.array(texts, pa.string())):
        found = segments_of(block)
        chars.append(found.chars)
        lengths.append(found.length)
        rows.append(found.row + at)
        at += block.rows
    chars, lengths, rows = np.concatenate(chars), np.concatenate(lengths), np.concatenate(rows)
    line = chars.view(f"S{WIDEST}").ravel()
    _, first, back = np.unique(line, return_index=True, return_inverse=True)
    pairs = np.unique(rows * len(first) + back)
    names = [chars[i, : lengths[i]].tobytes() for i in first]
    return Bags(names, chars[first], lengths[first], pairs % max(1, len(first)), pairs // max(1, len(first)), len(texts))


def fit(texts: list[str], toxic: list[int], landmarks: int = 256, negatives: int = 3000, rounds: int = 3, seed: int = 5) -> Model:
    """Train on labelled texts: every text is a bag of segments, toxic by the worst of them.

    Positive segments are those whose texts are labelled toxic beyond chance, by a bound on evidence that
    is cross-validated on whole texts, however many they are and however rare.

    ``landmarks`` bounds the Nystroem basis and ``negatives`` the segments drawn from clean texts; neither
    bounds the positive segments, nor the hardest segment that every clean text adds in each round. Without
    both labels, or where no segment explains anything, the model is constant at the share of positives.
    """
    y = np.array(toxic)
    rate = float(y.mean()) if len(y) else 0.0
    odds = np.log((rate * len(y) + 0.5) / ((1 - rate) * len(y) + 0.5)) if len(y) else -1.0
    constant = Model(np.zeros(LETTERS**3), 0.0, 1.0, float(odds))
    bags = bags_of(texts) if 0 < rate < 1 else None
    if bags is None or not bags.names:
        return constant
    weight = _once(bags, y)
    draw = np.random.default_rng(seed)
    evidence, bad = _evidence(bags, y, weight)
    positives = np.flatnonzero(evidence >= _least_evidence(bags, y, weight, draw))
    if not len(positives):
        return constant
    good = np.bincount(bags.index, ((1 - y) * weight)[bags.row], len(bags.names))
    common = np.setdiff1d(np.argsort(-good, kind="stable")[:negatives], positives)
    basis = [*positives[np.argsort(-bad[positives], kind="stable")][: landmarks * 3 // 4], *draw.permutation(common)[: landmarks // 4]]
    z = dense([bags.names[i] for i in basis])
    values, vectors = np.linalg.eigh(z @ z.T)
    keep = values > 1e-6
    whiten = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)

    def mapped(which: np.ndarray) -> np.ndarray:
        parts = [dense([bags.names[i] for i in some]) @ z.T for some in np.array_split(which, len(which) // 60 + 1)]
        return np.concatenate(parts) @ whiten

    # Other segments: frequent ones, a draw of all, and in each round the most toxic of each clean text.
    drawn = draw.permutation(np.flatnonzero(good))[: negatives * 2 // 3]
    others = np.setdiff1d(np.union1d(drawn, common[: negatives // 3]), positives)
    share = np.sqrt(bad[positives]) / np.sqrt(bad[positives]).sum()
    x, fresh, hardest = mapped(positives), others, np.zeros(len(bags.names))
    t = np.ones(len(positives))
    for _ in range(rounds):
        x = np.concatenate([x, mapped(fresh)])
        t = np.append(t, -np.ones(len(fresh)))
        # What clean texts weigh is spread evenly, but for a part on the segments that let them down.
        cost = 1 / len(others) + 0.3 * hardest[others] / max(hardest.sum(), 1e-12)
        v, bias = _machine(x, t, np.concatenate([share, cost / cost.sum()]))
        model = Model(z.T.astype(np.float64) @ (whiten.astype(np.float64) @ v), bias, 1.0, 0.0)
        best, which = bags.best(model.values(bags.chars, bags.length), model.bias)
        worst = (y == 0) & (which >= 0)
        hardest += np.bincount(which[worst], weight[worst], len(bags.names))
        hardest[positives] = 0.0
        fresh = np.setdiff1d(which[worst], np.union1d(positives, others))
        others = np.append(others, fresh)
    model.slope, _ = _sigmoid(best, y, weight)
    model.shift = -model.slope * _threshold(best, y, weight)
    return model


def _evidence(bags: Bags, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much better each segment's texts are told apart by their label than by chance, in log likelihood,
    and the weight of the toxic texts that hold it; 0 for segments that lean to clean texts."""
    bad = np.bincount(bags.index, (y * weight)[bags.row], len(bags.names))
    good = np.bincount(bags.index, ((1 - y) * weight)[bags.row], len(bags.names))
    rate = (y * weight).sum() / max(weight.sum(), 1e-12)
    share = bad / np.maximum(bad + good, 1e-12)
    value = bad * np.log(np.maximum(share, 1e-12) / max(rate, 1e-12)) + good * np.log(np.maximum(1 - share, 1e-12) / (1 - rate))
    return np.where(share > max(0.5, rate), value, 0.0), bad


def _least_evidence(bags: Bags, y: np.ndarray, weight: np.ndarray, draw: np.random.Generator, folds: int = 5) -> float:
    """The bound on evidence whose segments tell best the texts of a fold that took no part in it."""
    fold = draw.integers(0, folds, bags.rows)
    steps = np.array([3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 12.0])
    right = np.zeros(len(steps))
    for part in range(folds):
        out = fold == part
        value, _ = _evidence(bags, y, weight * ~out)
        best, _ = bags.best(value, 0.0)
        for label, sign in ((1, 1.0), (0, -2.0)):
            some = weight * out * (y == label)
            right += sign * (some * (best >= steps[:, None])).sum(axis=1) / max(some.sum(), 1e-12)
    return float(steps[len(steps) - 1 - np.argmax(right[::-1])])


def _threshold(value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Where the share of toxic texts above exceeds that of clean ones most; the middle of the gap there."""
    order = np.argsort(-value, kind="stable")
    value, y, weight = value[order], y[order], weight[order]
    toxic, clean = np.cumsum(y * weight), np.cumsum((1 - y) * weight)
    apart = toxic / toxic[-1] - clean / clean[-1]
    ends = np.append(value[1:] < value[:-1], True)
    at = int(np.argmax(np.where(ends, apart, -1.0)))
    return float(value[at] + value[min(at + 1, len(value) - 1)]) / 2


def _once(bags: Bags, y: np.ndarray, bands: int = 4, hashes: int = 3) -> np.ndarray:
    """Weights that count copies and near copies of a text once: texts of a label that share a band of least hashes."""
    largest = np.ones(bags.rows)
    for band in range(bands):
        shared = y.astype(np.uint64)
        for turn in range(hashes):
            word = mix(np.arange(1, len(bags.names) + 1, dtype=np.uint64) + np.uint64(band * hashes + turn << 40))
            least = np.full(bags.rows, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, bags.row, word[bags.index])
            shared = mix(shared * np.uint64(0x9E3779B97F4A7C15) + least)
        _, group, size = np.unique(shared, return_inverse=True, return_counts=True)
        largest = np.maximum(largest, size[group.ravel()])
    return 1.0 / largest


def _machine(x: np.ndarray, t: np.ndarray, cost: np.ndarray, c: float = 200.0, steps: int = 600) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    rate = 1.0 / (1.0 + 2 * c * np.linalg.norm((x * cost[:, None]).T @ x, 2))
    v = w = np.zeros(x.shape[1])
    for k in range(steps):
        slack = np.maximum(0, 1 - t * (x @ w))
        step = w * np.append(np.ones(x.shape[1] - 1), 1e-3) - 2 * c * x.T @ (cost * slack * t)
        following = w - rate * step
        w = following + k / (k + 3) * (following - v)
        v = following
    return v[:-1], float(v[-1])


def _sigmoid(value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on the smoothed labels."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.stack([value, np.ones(len(value))], 1)
    a = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = x.T @ (x * (weight * p * (1 - p) + 1e-6)[:, None]) + 1e-4 * np.eye(2)
        a = a - np.linalg.solve(h, x.T @ (weight * (p - t)) + 1e-4 * a)
        a[0] = max(a[0], 0.0)
    return float(a[0]), float(a[1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, max_bytes: int = 64 << 20) -> Model:
    """Fit on the documents of at most ``max_rows`` labels, drawn by a hash of the id, in one task.

    Null labels are left out; an id counts once, with its larger label and its last text by value. Texts beyond
    ``max_bytes`` in the order of ids are left out as well. The driver gets the weights only.
    """
    once = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    drawn = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # The drawn ids are at most ``max_rows`` rows, so they can be sent to the documents.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).repartition(1).sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        texts, toxic, room = [], [], max_bytes
        for batch in batches:
            for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                room -= len(text.encode())
                if room >= 0:
                    texts.append(text)
                    toxic.append(int(bool(label)))
        model = fit(texts, toxic)
        del texts, toxic
        give_back()
        yield {"weights": pa.array([model.weights.tobytes()]), **{c: pa.array([float(getattr(model, c))]) for c in ("bias", "slope", "shift")}}

    fitted = streamed(rows, run, "weights binary, bias double, slope double, shift double").toArrow().to_pylist()
    if not fitted:  # Spark may plan no task at all for a join that it knows to be empty
        return fit([], [])
    return Model(np.frombuffer(fitted[0]["weights"], np.float64), *(fitted[0][c] for c in ("bias", "slope", "shift")))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every row; one pass without a shuffle."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for texts in text_blocks(batch.column(1), TEXT_BLOCK):
            score = model.scores(texts)
            yield {
                "doc_id": batch.column(0).slice(texts.first, texts.rows),
                "score": score,
                "predicted": (score >= 0.5).astype(np.int32),
            }

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the model does not predict toxic; one pass."""
    schema = docs.schema
    at = schema.names.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        good = [model.scores(texts) < 0.5 for texts in text_blocks(batch.column(at), TEXT_BLOCK)]
        if good:
            yield pa.Table.from_batches([batch.filter(pa.array(np.concatenate(good)))])

    return in_arrow(docs, run, schema)
