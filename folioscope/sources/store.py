"""The chunk table: upserts, replacement per document, deletes, scans, signatures.

The functions are plain DataFrame algebra. :class:`ChunkTable` keeps the result in versions whose
readers never see half a change, and holds vectors of one embedder and one size only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.operators.retrieval import send_small
from folioscope.session import materialise
from folioscope.sources.versions import BUCKETS, Change, Manifest, VersionedTable


def matches(where: dict[str, object]) -> Column:
    """All equalities of a map; NULL values match NULL."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in where.items()], F.lit(True))


def last_rows(incoming: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row per key: the last by ``order``, equal ones and a missing order settled by the rows' values."""
    row = F.struct(*incoming.columns)
    last = incoming.groupBy(key).agg(F.max_by(row, F.struct(*(order or []), row)).alias("_row"))
    return last.select("_row.*")


def upsert_chunks(existing: DataFrame, incoming: DataFrame, key: str = "chunk_id", order: list[str] | None = None) -> DataFrame:
    """Insert or replace by id; of incoming rows with one id the last by ``order`` stays.

    A table has no last row of its own, so without ``order`` the row with the largest values stays, which is
    the same one at every run.
    """
    incoming = last_rows(incoming, key, order)
    ids, _ = send_small(incoming.select(key))
    return existing.join(ids, key, "left_anti").unionByName(incoming.select(*existing.columns))


@dataclass(frozen=True)
class Space:
    """The vector space of some chunks: which embedder made them, and their size."""

    signature: str
    size: int


def vector_space(chunks: DataFrame) -> Space | None:
    """The one space all chunks share, None for no chunks; anything else is an error."""
    size = F.coalesce(F.size("vector"), F.lit(-1))
    found = chunks.agg(
        F.count("*").alias("n"), F.min(size).alias("low"), F.max(size).alias("high"),
        F.count("signature").alias("signed"), F.min("signature").alias("first"), F.max("signature").alias("last"),
    ).first()
    if not found["n"]:
        return None
    if found["low"] <= 0 or found["low"] != found["high"]:
        raise ValueError(f"vectors of sizes {found['low']} to {found['high']}; every chunk needs one of the same size")
    if found["signed"] != found["n"] or found["first"] != found["last"]:
        raise ValueError(f"vectors of {found['first']!r}, {found['last']!r} and {found['n'] - found['signed']} unsigned ones; a write needs one embedder")
    return Space(found["first"], found["low"])


def replace_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per document of ``incoming``: all old chunks go, the new ones come."""
    sources, _ = send_small(incoming.select("source").distinct())
    return existing.join(sources, "source", "left_anti").unionByName(incoming)


def delete_where(existing: DataFrame, where: dict[str, object]) -> tuple[DataFrame, int]:
    """The rows that stay and the number that went; an empty condition is refused."""
    if not where:
        raise ValueError("a delete needs at least one condition")
    gone = matches(where)
    return existing.where(~gone), existing.where(gone).count()


def scan_chunks(
    existing: DataFrame,
    where: dict[str, object] | None = None,
    ids: DataFrame | None = None,
    limit: int | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Rows under all equalities and an id table; only the named columns are read."""
    rows = existing.where(matches(where)) if where else existing
    if ids is not None:
        small, _ = send_small(ids.select("chunk_id").distinct())
        rows = rows.join(small, "chunk_id", "left_semi")
    if columns:
        rows = rows.select(*columns)
    return rows if limit is None else rows.limit(int(limit))


def count_chunks(existing: DataFrame, where: dict[str, object] | None = None) -> DataFrame:
    """One row with the exact number of rows under the equalities."""
    return scan_chunks(existing, where).agg(F.count("*").alias("chunks"))


def list_documents(existing: DataFrame) -> DataFrame:
    """Chunks per source; rows without a source are skipped."""
    return (
        existing.where(F.coalesce("source", F.lit("")) != "").groupBy("source").agg(F.count("*").alias("chunks"))
    )


def reindex_report(docs: DataFrame, chunks: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """``(source, chunks, status, error)`` for every document and every rejected file."""
    counts = list_documents(chunks)
    report = docs.select("source").join(counts, "source", "left").select(
        "source", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.lit("success").alias("status"), F.lit(None).cast("string").alias("error")
    )
    if rejects is not None:
        report = report.unionByName(
            rejects.select(
                "source", F.lit(0).cast("long").alias("chunks"), F.lit("error").alias("status"), F.col("reason").alias("error")
            )
        )
    return report


@dataclass(frozen=True)
class Written:
    """What a write did: the version it made, and whether vectors of another embedder went."""

    version: int
    reset: bool = False


class ChunkTable:
    """Stored chunks under a shared path, in versions.

    The first write fixes embedder and vector size. Chunks of another embedder end the old table: its rows
    cannot be compared with theirs, so they go in the same version that brings the new ones, and the writer is
    told. Another vector size under the same signature is an error.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark = spark
        self.versions = VersionedTable(spark, path, schemas.STORED_CHUNKS, "source", ("source", "chunk_index"), buckets)

    def read(self, version: int | None = None) -> DataFrame:
        """All chunks of a version, by default the last; an absent table is empty."""
        return self.versions.read(self.versions.manifest(version))

    def space(self) -> Space | None:
        """The space the table is bound to, None before the first write."""
        facts = self.versions.manifest().facts
        return Space(facts["signature"], facts["size"]) if facts.get("signature") is not None else None

    def check_signature(self, signature: str) -> bool:
        """True when the stored vectors belong to another embedder and were dropped."""
        dropped = [False]

        def build(base: Manifest) -> Change | None:
            dropped[0] = base.facts.get("signature") not in (None, signature)
            return Change(None, None, {}) if dropped[0] else None

        self.versions.change(build)
        return dropped[0]

    def _swap(self, incoming: DataFrame, merge: object) -> Written:
        """Publish ``merge(base, rows)``, a pair of rows and touched buckets, within one vector space."""
        fresh = materialise(incoming.select(*schemas.STORED_CHUNKS.names))
        space = vector_space(fresh)
        before = []

        def build(base: Manifest) -> Change | None:
            known = base.facts.get("signature")
            reset = bool(base.folders) and known != space.signature
            if not reset and base.folders and base.facts["size"] != space.size:
                raise ValueError(f"vectors of size {space.size}; the table holds vectors of size {base.facts['size']} by {known}")
            before[:] = [reset]
            rows, touched = (last_rows(fresh, "chunk_id"), None) if reset else merge(base, fresh)
            return Change(rows, touched, {"signature": space.signature, "size": space.size})

        if space is None:
            return Written(self.versions.manifest().version)
        return Written(self.versions.change(build).version, before[0])

    def replace_documents(self, incoming: DataFrame) -> Written:
        """Swap in the chunks of whole documents."""

        def merge(base: Manifest, fresh: DataFrame) -> tuple[DataFrame, set[int]]:
            touched = self.versions.buckets_with(base, fresh)
            return replace_documents(self.versions.read(base, touched), fresh), touched

        return self._swap(incoming, merge)

    def upsert(self, incoming: DataFrame) -> Written:
        """Insert or replace by chunk id, wherever the id was stored before."""

        def merge(base: Manifest, fresh: DataFrame) -> tuple[DataFrame, set[int]]:
            ids, _ = send_small(fresh.select("chunk_id").distinct())
            held = self.versions.read(base).select("chunk_id", "source").join(ids, "chunk_id", "left_semi")
            touched = self.versions.buckets_with(base, fresh.select("source").unionByName(held.select("source")))
            return upsert_chunks(self.versions.read(base, touched), fresh), touched

        return self._swap(incoming, merge)

    def rebuild(self, incoming: DataFrame) -> Written:
        """Put ``incoming`` in the place of everything."""
        return self._swap(incoming, lambda base, fresh: (last_rows(fresh, "chunk_id"), None))

    def delete_where(self, where: dict[str, object]) -> int:
        """Delete under all equalities, return how many rows went; no version is made for none."""
        if not where:
            raise ValueError("a delete needs at least one condition")
        deleted = [0]

        def build(base: Manifest) -> Change | None:
            touched = self.versions.buckets_with(base, self.versions.read(base).where(matches(where)))
            kept, deleted[0] = delete_where(self.versions.read(base, touched), where)
            return Change(kept, touched, base.facts) if touched else None

        self.versions.change(build)
        return deleted[0]
