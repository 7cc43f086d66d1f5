"""Helpers of the training-data operators: written tables and vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioscope.functions.memory import give_back, giving_back  # noqa: F401
from folioscope.session import bound_batches, dropping_shuffles, ensure_checkpoint_dir

BLOCK_BYTES = 1 << 20
#: Tables of powers grow by multiples of this.
STEP = 1 << 15
U = np.uint64


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of documents."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read again.

    It cuts the lineage and survives lost executors; unlike ``checkpoint()`` it computes the plan once.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with dropping_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket(divisor: int) -> object:
    """crc32 of the document's id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def in_arrow(df: DataFrame, function: object, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` whose batches are cast to ``schema``; ``function`` maps one batch to tables."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in function(batch):
                table = pa.table(piece) if isinstance(piece, dict) else piece
                if table.num_rows:
                    yield from table.select(arrow.names).cast(arrow).to_batches()

    return df.mapInArrow(giving_back(run), target)


def streamed(df: DataFrame, run: object, schema: str) -> DataFrame:
    """``mapInArrow`` for a function over a task's batches that yields columns, missing ones null."""
    target = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def all_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in run(batches):
            n = len(next(iter(piece.values())))
            full = {f.name: piece[f.name] if f.name in piece else pa.nulls(n, f.type) for f in arrow}
            yield from pa.table(full).cast(arrow).to_batches()

    return df.mapInArrow(giving_back(all_columns), target)


def likely_split(df: DataFrame, keys: DataFrame, column: str, bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``column`` (a long) may be among ``keys``' first column, and the others.

    The keys are folded into a bitmap of ``2**bits`` bits, a fixed size whatever their number, which is
    sent to the tasks before an exact join: it saves shuffling rows that find no partner, and a full
    bitmap only saves less. Null is never among the keys.
    """

    def cells(values: np.ndarray) -> np.ndarray:
        return mix(values.view(U)) >> U(64 - bits)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[cells(batch.column(0).drop_null().to_numpy()).astype(np.int64)] = True
        words = np.packbits(seen, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_pydict({"word": pa.array(at, pa.int64()), "bits": pa.array(words[at])})

    folded = keys.select(F.col(keys.columns[0]).cast("long")).mapInArrow(giving_back(fold), "word long, bits long")
    rows = folded.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    at = df.columns.index(column)

    def side(wanted: bool) -> DataFrame:
        def run(batch: pa.RecordBatch) -> Iterator[pa.Table]:
            ids = batch.column(at)
            cell = cells(ids.fill_null(0).to_numpy())
            hit = words.view(U)[(cell >> U(6)).astype(np.int64)] >> (cell & U(63)) & U(1) != 0
            hit &= ids.is_valid().to_numpy(zero_copy_only=False)
            yield pa.Table.from_batches([batch.filter(pa.array(hit == wanted))])

        return in_arrow(df, run, df.schema)

    return side(True), side(False)


@dataclass
class Texts:
    """Some consecutive rows: their texts as one array of bytes, cut by ``offsets``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Texts]:
    """Runs of rows of at most ``limit`` bytes (a longer text is a block of its own); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield Texts(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def smaller(texts: Texts, limit: int) -> Iterator[Texts]:
    """The rows of a block in runs of at most ``limit`` bytes (a longer text is a run of its own)."""
    at = 0
    while at < texts.rows:
        begin = texts.offsets[at]
        end = max(at + 1, int(np.searchsorted(texts.offsets, begin + limit, "right")) - 1)
        yield Texts(at, texts.data[begin : texts.offsets[end]], texts.offsets[at : end + 1] - begin)
        at = end


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (two multiply-xorshift rounds)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Roller:
    """Polynomial hashes of byte ranges modulo 2**64, from prefix sums; the base is odd, so it has an inverse."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.table = draw.integers(1, 2**64, 256, dtype=U) | U(1)
        self.base = U(int(draw.integers(1, 2**62)) * 4 + 3 & (2**64 - 1))
        self.inverse = U(pow(int(self.base), -1, 2**64))
        self.up = np.ones(1, U)
        self.down = np.ones(1, U)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = -(-(n + 1) // STEP) * STEP
            for name, base in (("up", self.base), ("down", self.inverse)):
                factors = np.full(size, base, U)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=U))

    def prefixes(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums over bytes (looked up in the table) or over 64-bit values as they are."""
        self.powers(len(values))
        out = np.zeros(len(values) + 1, U)
        np.multiply(self.table[values] if values.dtype == np.uint8 else values, self.up[: len(values)], out=out[1:])
        np.cumsum(out[1:], out=out[1:])
        return out

    def ranges(self, prefixes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefixes[end] - prefixes[start]) * self.down[start]


BYTES = Roller(11)
WORDS = Roller(12)
SECOND = Roller(13)


@dataclass
class Words:
    """The words of a block: byte ranges, hashes, and where each row's words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def words_of(texts: Texts, lower: bool, roller: Roller = BYTES) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text, with 64-bit hashes of their bytes."""
    data = texts.data
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U), np.zeros(texts.rows + 1, np.int64))
    solid = ~SPACE[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    cuts = texts.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    start[cuts] = solid[cuts]
    end[cuts - 1] = solid[cuts - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = roller.prefixes(LOWER[data] if lower else data)
    hashes = mix(roller.ranges(sums, s, e) + (e - s).astype(U))
    return Words(s, e, hashes, np.searchsorted(s, texts.offsets))


def words_in_runs(texts: Texts, lower: bool, limit: int) -> Words:
    """:func:`words_of` a block, whose sums over bytes are held for ``limit`` bytes at a time only."""
    found = [(run, words_of(run, lower)) for run in smaller(texts, limit)]
    if not found:
        return words_of(texts, lower)
    begin = np.array([texts.offsets[run.first] for run, _ in found])
    counts = np.concatenate([np.diff(words.offsets) for _, words in found])
    shift = np.repeat(begin, [len(words.hash) for _, words in found])
    start, end, hashes = (np.concatenate([getattr(words, c) for _, words in found]) for c in ("start", "end", "hash"))
    return Words(start + shift, end + shift, hashes, np.append(0, np.cumsum(counts)))


def window_hashes(words: Words, width: int, roller: Roller = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each word on, and whether they stay inside one row."""
    n = len(words.hash)
    if n < width:
        return np.zeros(0, U), np.zeros(0, bool)
    sums = roller.prefixes(words.hash)
    at = np.arange(n - width + 1)
    hashes = mix(roller.ranges(sums, at, at + width))
    row = words.rows()
    return hashes, row[: n - width + 1] == row[width - 1 :]


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` (minimum or maximum) over each run of ``width`` values, by doubling."""
    out, reach = values, 1
    while reach * 2 <= width:
        out = best(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return best(out[:-rest], out[rest:]) if rest else out


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

