"""Document quality by a byte-level convolutional network, in numpy.

The whole text's UTF-8 bytes are embedded and passed through learned filters of ``WIDTH`` bytes. Their
answers are max-pooled over overlapping chunks that cover the text from end to end; a document's maximum
and mean over its chunks go through a small hidden layer into one probability. Only bytes are read: ids,
languages, sources and labels are no inputs.

Training runs on the driver, on a sample of labelled rows bounded by ``max_rows``, with Adam on the mean
log loss. A null or empty text is one chunk of padding and gets the network's answer to that. Repeated
rows are scored each; other columns are not read. Without both labels the score is the share of ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Texts, in_arrow, text_blocks

WIDTH = 12
STRIDE = 4
#: Filter answers in a sub-block, sub-blocks in a chunk, and sub-blocks from one chunk to the next.
SUB, CHUNK, STEP = 32, 4, 3
EMBEDDING, FILTERS, HIDDEN = 8, 32, 16
PAD = 256


@dataclass
class Layout:
    """Where filters look (positions of bytes) and which sub-blocks make up the chunks of each row."""

    codes: np.ndarray
    position: np.ndarray
    sub_starts: np.ndarray
    chunk_subs: np.ndarray
    chunk_row: np.ndarray
    rows: int


def layout_of(texts: Texts) -> Layout:
    size = np.diff(texts.offsets)
    answers = np.maximum(1, -(-np.maximum(size - WIDTH, 0) // STRIDE) + 1)
    padded = (answers - 1) * STRIDE + WIDTH
    begin = np.append(0, np.cumsum(padded))
    codes = np.full(begin[-1], PAD, np.int64)
    codes[np.arange(len(texts.data)) + np.repeat(begin[:-1] - texts.offsets[:-1], size)] = texts.data
    first = np.append(0, np.cumsum(answers))
    row = np.repeat(np.arange(texts.rows), answers)
    within = np.arange(first[-1]) - first[row]
    position = begin[row] + within * STRIDE
    sub_starts = np.flatnonzero(within % SUB == 0)
    subs = -(-answers // SUB)
    sub_first = np.append(0, np.cumsum(subs))
    chunks = np.maximum(1, -(-(subs - (CHUNK - STEP)) // STEP))
    chunk_row = np.repeat(np.arange(texts.rows), chunks)
    number = np.arange(len(chunk_row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    member = number[:, None] * STEP + np.arange(CHUNK)
    chunk_subs = sub_first[chunk_row][:, None] + np.minimum(member, subs[chunk_row][:, None] - 1)
    return Layout(codes, position, sub_starts, chunk_subs, chunk_row, texts.rows)


class Network:
    """Embedding, filters, hidden layer and output."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return draw.normal(0, scale, shape).astype(np.float32)

        self.p = {
            "embedding": normal(257, EMBEDDING, scale=0.5),
            "filters": normal(WIDTH * EMBEDDING, FILTERS, scale=(2 / (WIDTH * EMBEDDING)) ** 0.5),
            "filter_bias": np.zeros(FILTERS, np.float32),
            "hidden": normal(2 * FILTERS, HIDDEN, scale=(1 / FILTERS) ** 0.5),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, scale=HIDDEN**-0.5),
            "out_bias": np.zeros(1, np.float32),
        }

    def windows(self, layout: Layout, position: np.ndarray) -> np.ndarray:
        codes = layout.codes[position[:, None] + np.arange(WIDTH)]
        return self.p["embedding"][codes].reshape(len(position), WIDTH * EMBEDDING)

    def pooled(self, layout: Layout) -> np.ndarray:
        """Highest answer of each filter in each sub-block; answers are made some sub-blocks at a time."""
        bounds = np.append(layout.sub_starts, len(layout.position))
        out = np.empty((len(layout.sub_starts), FILTERS), np.float32)
        for a in range(0, len(layout.sub_starts), 512):
            b = min(a + 512, len(layout.sub_starts))
            answers = self.windows(layout, layout.position[bounds[a] : bounds[b]]) @ self.p["filters"]
            out[a:b] = np.maximum.reduceat(answers, layout.sub_starts[a:b] - bounds[a])
        return np.maximum(out + self.p["filter_bias"], 0)

    def combined(self, chunk: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.append(True, layout.chunk_row[1:] != layout.chunk_row[:-1]))
        count = np.diff(np.append(starts, len(chunk)))[:, None]
        both = np.hstack([np.maximum.reduceat(chunk, starts), np.add.reduceat(chunk, starts) / count])
        return both, count

    def scores(self, texts: Texts) -> np.ndarray:
        layout = layout_of(texts)
        both, _ = self.combined(self.pooled(layout)[layout.chunk_subs].max(1), layout)
        hidden = np.maximum(both @ self.p["hidden"] + self.p["hidden_bias"], 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.p["out"] + self.p["out_bias"], -40, 40).astype(np.float64)))

    def gradient(self, texts: Texts, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradient of the mean log loss. Max pooling passes it on to one window per chunk and filter."""
        p, layout = self.p, layout_of(texts)
        answers = self.windows(layout, layout.position) @ p["filters"]
        sub = np.maximum.reduceat(answers, layout.sub_starts)
        member = sub[layout.chunk_subs]
        best = member.argmax(1)
        chunk_raw = np.take_along_axis(member, best[:, None], 1)[:, 0] + p["filter_bias"]
        chunk = np.maximum(chunk_raw, 0)
        both, count = self.combined(chunk, layout)
        hidden = np.maximum(both @ p["hidden"] + p["hidden_bias"], 0)
        prob = 1 / (1 + np.exp(-(hidden @ p["out"] + p["out_bias"])))
        loss = -float(np.mean(np.where(y == 1, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))))
        g = {}
        top = ((prob - y) / len(y)).astype(np.float32)
        g["out"], g["out_bias"] = hidden.T @ top, top.sum(keepdims=True)
        back = np.outer(top, p["out"]) * (hidden > 0)
        g["hidden"], g["hidden_bias"] = both.T @ back, back.sum(0)
        back = back @ p["hidden"].T
        row = layout.chunk_row
        to_max = (chunk == both[row, :FILTERS]) & (chunk > 0)
        ties = np.maximum(1, np.add.reduceat(to_max, np.flatnonzero(np.append(True, row[1:] != row[:-1]))))
        to_chunk = to_max * (back[:, :FILTERS] / ties)[row] + (back[:, FILTERS:] / count)[row]
        to_chunk *= chunk_raw > 0
        g["filter_bias"] = to_chunk.sum(0)
        # The window that gave each chunk its maximum, for every filter.
        winner = np.take_along_axis(layout.chunk_subs, best, 1)
        bounds = np.append(layout.sub_starts, len(layout.position))
        f, at = np.nonzero(to_chunk.T)
        start, end = bounds[winner[at, f]], bounds[winner[at, f] + 1]
        span = np.minimum(start[:, None] + np.arange(SUB), end[:, None] - 1)
        place = span[np.arange(len(span)), answers[span, f[:, None]].argmax(1)]
        codes = layout.codes[layout.position[place][:, None] + np.arange(WIDTH)]
        window = p["embedding"][codes].reshape(len(place), -1)
        share = to_chunk[at, f][:, None].astype(np.float32)
        g["filters"] = np.zeros_like(p["filters"])
        runs = np.flatnonzero(np.append(True, f[1:] != f[:-1])) if len(f) else f
        if len(f):
            g["filters"][:, f[runs]] = np.add.reduceat(window * share, runs).T
        back = (p["filters"].T[f] * share).reshape(-1, EMBEDDING)
        flat = codes.ravel()
        g["embedding"] = np.stack([np.bincount(flat, back[:, k], 257) for k in range(EMBEDDING)], 1).astype(np.float32)
        return g, loss


def fit(texts: list[str], quality: list[int], epochs: int = 6, batch: int = 24, rate: float = 4e-3, seed: int = 7) -> Network | float:
    """Train on labelled texts; a constant where there are not both labels."""
    y = np.array(quality, np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    net, draw = Network(seed), np.random.default_rng(seed)
    net.p["out_bias"][:] = np.log(y.mean() / (1 - y.mean()))
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, steps = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for some in np.array_split(order, -(-len(y) // batch)):
            block = next(text_blocks(pa.array([texts[i] for i in some], pa.string()), 1 << 62))
            g, _ = net.gradient(block, y[some])
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * step / steps))
            for k, v in net.p.items():
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.002 * (g[k] ** 2 - second[k])
                v -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.998**step)) + 1e-7)
    return net


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 2600) -> Network | float:
    """Fit on the documents of at most ``max_rows`` labels, drawn by a hash of the id. Null labels are left out."""
    drawn = labels.where(F.col("quality").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # The drawn ids are at most ``max_rows`` rows, so they can be sent to the documents.
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").orderBy("doc_id").select("text", "quality").toArrow()
    return fit([t or "" for t in rows["text"].to_pylist()], [int(bool(x)) for x in rows["quality"].to_pylist()])


def score_quality(docs: DataFrame, model: Network | float) -> DataFrame:
    """``doc_id, score, predicted`` of every row; one pass without a shuffle."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for texts in text_blocks(batch.column(1), 1 << 20):
            score = np.full(texts.rows, model) if isinstance(model, float) else model.scores(texts)
            yield {
                "doc_id": batch.column(0).slice(texts.first, texts.rows),
                "score": score,
                "predicted": (score >= 0.5).astype(np.int32),
            }

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")
