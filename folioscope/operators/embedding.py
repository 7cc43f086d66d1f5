"""Embedding as a batch job: column builders, model hooks and checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.memory import give_back

HASH_DIM = 256
#: Texts that are embedded at once.
EMBED_ROWS = 256


def _slot_hash(pair: int) -> int:
    """First four MD5 bytes of a two-character string as an integer; -1 for two blanks."""
    text = chr(pair >> 21) + chr(pair & 0x1FFFFF)
    if not text.strip():
        return -1
    return int.from_bytes(md5(text.encode("utf-8", "surrogatepass")).digest()[:4], "little")


def _hash_vector(text: str, dim: int, known: dict[int, int]) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    vector = np.zeros(dim)
    if codes.size > 1:
        pairs, counts = np.unique((codes[:-1] << 21) | codes[1:], return_counts=True)
        hashes = np.empty(pairs.size, dtype=np.int64)
        for at, pair in enumerate(pairs.tolist()):
            value = known.get(pair)
            if value is None:
                value = known[pair] = _slot_hash(pair)
            hashes[at] = value
        real = hashes >= 0
        np.add.at(vector, hashes[real] % dim, counts[real])
    norm = np.sqrt(np.dot(vector, vector))
    if norm == 0:
        vector[0] = norm = 1.0
    return vector / norm


def hash_embed(text: Column | str, dim: int = HASH_DIM) -> Column:
    """Unit vector of hashed two-character windows over the whole lower-cased text."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[int, int] = {}
        for texts in batches:
            # A batch of the engine may hold many long texts; vectors are made and passed on in small pieces.
            for at in range(0, len(texts), EMBED_ROWS):
                if len(known) > 1 << 18:  # keep the memo small on texts with many scripts
                    known.clear()
                part = [_hash_vector(t or "", dim, known) for t in texts.slice(at, EMBED_ROWS).to_pylist()]
                starts = pa.array(np.arange(0, (len(part) + 1) * dim, dim, dtype=np.int32))
                yield pa.ListArray.from_arrays(starts, pa.array(np.concatenate(part)))
        known.clear()
        give_back()

    return encode(text)


def embed_column(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list]], prefix: str = "", output: str = "vector") -> DataFrame:
    """Run a user model over a text column; ``load`` is called once per Python worker.

    Questions and documents use the same function with different prefixes.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in model(texts.tolist())], index=texts.index)

    return df.withColumn(output, encode(F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))))


def embed_batches(df: DataFrame, key: str, text: str, call: Callable[[list[str]], list[tuple[int, list[float]]]], batch: int = 10) -> DataFrame:
    """Send fixed-size batches to ``call`` and put the answers back in order.

    ``call`` returns ``(index, vector)`` pairs in any order; a missing or surplus answer is an
    error, never a silent gap. Result: ``(key, vector)``.
    """
    size = max(1, int(batch))
    schema = T.StructType([df.schema[key], T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), size):
                part = frame.iloc[start : start + size]
                answers = dict(call(part[text].tolist()))
                if sorted(answers) != list(range(len(part))):
                    raise ValueError(f"asked for {len(part)} vectors, got {len(answers)}")
                yield pd.DataFrame({key: part[key].values, "vector": [answers[i] for i in range(len(part))]})

    return df.select(key, text).mapInPandas(run, schema)


@dataclass(frozen=True)
class Embedder:
    """A named embedder: two column builders and the signature of its vector space."""

    signature: str
    documents: Callable[[Column], Column]
    query: Callable[[Column], Column]


def _hashing(dim: int = HASH_DIM) -> Embedder:
    def build(text: Column) -> Column:
        return hash_embed(text, dim)

    return Embedder(f"hashing:bigram-{dim}", build, build)


_EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hashing": _hashing}


def register_embedder(name: str, factory: Callable[..., Embedder]) -> None:
    """Make a user embedder available by name."""
    _EMBEDDERS[name.lower()] = factory


def get_embedder(name: str, **options) -> Embedder:
    """Look an embedder up by provider name; an unknown name is an error."""
    try:
        return _EMBEDDERS[name.lower()](**options)
    except KeyError:
        raise ValueError(f"unknown embedder {name!r}, choose from {sorted(_EMBEDDERS)}") from None


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Add ``signature`` and ``vector`` to chunk rows, from heading plus body."""
    return chunks.withColumn("signature", F.lit(embedder.signature)).withColumn(
        "vector", embedder.documents(F.col("embed_text"))
    )


def vector_norm(vector: Column | str) -> Column:
    value = F.col(vector) if isinstance(vector, str) else vector
    return F.sqrt(F.aggregate(value, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def validate_vectors(df: DataFrame, vector: str = "vector", tolerance: float = 1e-3) -> DataFrame:
    """Rows and non-unit vectors per dimension; a healthy store gives one row with a real dimension."""
    return (
        df.select(F.size(F.col(vector)).alias("dim"), vector_norm(vector).alias("norm"))
        .groupBy(F.when(F.col("dim") > 0, F.col("dim").cast("long")).alias("dim"))
        .agg(
            F.count("*").alias("vectors"),
            F.count_if(F.abs(F.col("norm") - 1) > tolerance).alias("not_unit"),
        )
    )
