"""Tables kept as immutable folders under a manifest that is replaced atomically.

``<path>/data/<folder>/bucket=<b>`` holds the rows of a bucket, ``<path>/manifests/<version>.json`` says
which folder holds which bucket. A change writes the buckets it touches into a new folder, then
publishes the next manifest by a rename that fails when another writer was first; the change is then
made again on what that writer left. A reader takes one manifest and sees exactly its rows. The rename
has to be atomic, as it is on HDFS and local disks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256
ATTEMPTS = 20


class ConcurrentChange(RuntimeError):
    """Other writers were first at every attempt."""


@dataclass(frozen=True)
class Manifest:
    """One version of a table: the folder of every bucket that has rows, and facts about the whole table."""

    version: int = 0
    buckets: int = BUCKETS
    folders: dict[int, str] = field(default_factory=dict)
    facts: dict[str, object] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "buckets": self.buckets, "folders": self.folders, "facts": self.facts})

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        raw = json.loads(text)
        return cls(raw["version"], raw["buckets"], {int(b): f for b, f in raw["folders"].items()}, raw["facts"])


@dataclass(frozen=True)
class Change:
    """New rows of the buckets ``touched`` (all of them when None), and the table's facts from then on."""

    rows: DataFrame | None
    touched: Iterable[int] | None
    facts: dict[str, object]


class VersionedTable:
    """Rows of ``schema`` in hash buckets of the column ``key``, sorted by ``order`` inside files."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order
        self._new = Manifest(buckets=buckets)

    # ------------------------------------------------------------ files

    def _path(self, *parts: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _files(self) -> object:
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        files, path = self._files(), self._path(*parts)
        return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []

    def versions(self) -> list[int]:
        """The published versions that are still kept, oldest first."""
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """A published version, the last one by default; a table never written is version 0 and empty."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return self._new
        stream = self._files().open(self._path("manifests", f"{version:012d}.json"))
        try:
            return Manifest.from_json(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: Manifest) -> bool:
        """Whether this writer was the first to publish the version."""
        jvm, files = self.spark._jvm, self._files()
        draft, final = self._path("manifests", f"draft-{uuid.uuid4().hex}"), self._path("manifests", f"{manifest.version:012d}.json")
        out = files.create(draft, False)
        out.write(bytearray(manifest.to_json().encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(final).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, options)
        except Exception:
            if not files.exists(final):
                raise
            files.delete(draft, False)
            return False
        return True

    # ------------------------------------------------------------ rows

    def bucket_of(self, manifest: Manifest) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(manifest.buckets)).cast("int")

    def read(self, manifest: Manifest | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a manifest (the last one by default), of some buckets or all."""
        manifest = manifest or self.manifest()
        wanted = manifest.folders if buckets is None else set(buckets) & set(manifest.folders)
        paths = sorted(f"{self.path}/data/{manifest.folders[b]}/bucket={b}" for b in wanted)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def buckets_with(self, manifest: Manifest, rows: DataFrame) -> set[int]:
        """The buckets that rows with a key belong to; no more than the table has."""
        return {r["b"] for r in rows.select(self.bucket_of(manifest).alias("b")).distinct().collect()}

    def _write(self, manifest: Manifest, rows: DataFrame) -> dict[int, str]:
        folder = uuid.uuid4().hex
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        placed = typed.withColumn("bucket", self.bucket_of(manifest))
        # A rebalanced shuffle cuts a bucket that is far larger than others into several files.
        dealt = placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.order)
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        found = [n for n in self._names("data", folder) if n.startswith("bucket=")]
        return {int(n.removeprefix("bucket=")): folder for n in found}

    def change(self, build: Callable[[Manifest], Change | None]) -> Manifest:
        """Publish what ``build`` makes of the last version; it is called anew when another writer was first.

        ``build`` returns None when nothing has to change.
        """
        for _ in range(ATTEMPTS):
            base = self.manifest()
            change = build(base)
            if change is None:
                return base
            touched = set(base.folders if change.touched is None else change.touched)
            folders = {b: f for b, f in base.folders.items() if b not in touched}
            if change.rows is not None:
                folders |= self._write(base, change.rows)
            fresh = replace(base, version=base.version + 1, folders=folders, facts=change.facts)
            if self._publish(fresh):
                return fresh
        raise ConcurrentChange(f"{self.path}: {ATTEMPTS} attempts met another writer's change")

    def vacuum(self, keep: int = 10, older_than_hours: float = 24.0) -> list[str]:
        """Delete manifests before the last ``keep`` and old folders that no kept one names.

        Folders younger than ``older_than_hours`` stay, as a writer may be about to publish them.
        """
        files, versions = self._files(), self.versions()
        used = {f for v in versions[-keep:] for f in self.manifest(v).folders.values()}
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        gone = []
        for name in sorted(set(self._names("data")) - used):
            path = self._path("data", name)
            if now - files.getFileStatus(path).getModificationTime() >= older_than_hours * 3_600_000:
                files.delete(path, True)
                gone.append(name)
        for version in versions[:-keep]:
            files.delete(self._path("manifests", f"{version:012d}.json"), False)
        return gone
