"""Versions of a table: pinned readers, writers that meet, signatures, and cleaning up."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.operators import embedding as E
from folioscope.plans.index import reindex
from folioscope.sources import versions as V
from folioscope.sources.store import ChunkTable, Space, upsert_chunks
from folioscope.streaming import flows

HASH8 = E.Embedder("s8", lambda c: E.hash_embed(c, 8), lambda c: E.hash_embed(c, 8))
HASH16 = E.Embedder("s16", lambda c: E.hash_embed(c, 16), lambda c: E.hash_embed(c, 16))


def chunk_rows(spark, names, signature="s", size=2, text="x", prefix="c"):
    rows = [(f"{prefix}{n}", n, 0, "", f"{text} {n}", "", signature, [0.5] * size) for n in names]
    return spark.createDataFrame(rows, schemas.STORED_CHUNKS)


def contents(df):
    return {r.chunk_id: (r.source, r.content) for r in df.collect()}


def test_a_reader_keeps_its_version(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), buckets=4)
    assert table.read().count() == 0 and table.space() is None and table.versions.versions() == []
    first = table.replace_documents(chunk_rows(spark, "abcdefgh"))
    old = table.read()
    assert (first.version, first.reset, table.space()) == (1, False, Space("s", 2))
    second = table.replace_documents(chunk_rows(spark, "ab", text="new"))
    assert table.delete_where({"source": "c"}) == 1 and table.delete_where({"source": "c"}) == 0
    assert second.version == 2 and table.versions.versions() == [1, 2, 3]
    assert contents(old) == contents(table.read(1)) == {f"c{n}": (n, f"x {n}") for n in "abcdefgh"}
    assert contents(table.read(2))["ca"] == ("a", "new a") and "cc" in contents(table.read(2)) and "cc" not in contents(table.read())


def test_the_second_of_two_writers_starts_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    mine, other = ChunkTable(spark, path, buckets=4), ChunkTable(spark, path, buckets=4)
    mine.replace_documents(chunk_rows(spark, "abc"))
    publish, seen = V.VersionedTable._publish, []

    def late(self, manifest):
        seen.append(manifest.version)
        if self is mine.versions and len(seen) == 1:
            other.replace_documents(chunk_rows(spark, "ad", text="other"))
        return publish(self, manifest)

    monkeypatch.setattr(V.VersionedTable, "_publish", late)
    assert mine.upsert(chunk_rows(spark, "b", text="mine")).version == 3 and seen == [2, 2, 3]
    assert {k: c for k, (_, c) in contents(mine.read()).items()} == {"ca": "other a", "cb": "mine b", "cc": "x c", "cd": "other d"}
    monkeypatch.setattr(V.VersionedTable, "_publish", lambda self, manifest: False)
    monkeypatch.setattr(V, "ATTEMPTS", 2)
    with pytest.raises(V.ConcurrentChange):
        mine.upsert(chunk_rows(spark, "b"))
    assert not [n for n in mine.versions._names("manifests") if n.startswith("draft")]


def test_every_writer_checks_the_space(spark, tmp_path):
    for write in ("replace_documents", "upsert", "rebuild"):
        table = ChunkTable(spark, str(tmp_path / write), buckets=2)
        assert getattr(table, write)(chunk_rows(spark, "")).version == 0
        getattr(table, write)(chunk_rows(spark, "ab"))
        with pytest.raises(ValueError, match="size 3"):
            getattr(table, write)(chunk_rows(spark, "a", size=3))
        with pytest.raises(ValueError, match="sizes 2 to 3"):
            getattr(table, write)(chunk_rows(spark, "a").unionByName(chunk_rows(spark, "b", size=3)))
        for bad in (chunk_rows(spark, "a").unionByName(chunk_rows(spark, "b", "other")), chunk_rows(spark, "ab").withColumn("signature", F.when(F.col("source") == "a", "s"))):
            with pytest.raises(ValueError, match="one embedder"):
                getattr(table, write)(bad)
        with pytest.raises(ValueError, match="sizes -1"):
            getattr(table, write)(chunk_rows(spark, "a").withColumn("vector", F.lit(None).cast("array<float>")))
        assert len(contents(table.read())) == 2
        # Another embedder, of whatever size, ends the old table and says so.
        told = getattr(table, write)(chunk_rows(spark, "z", "other", 3))
        assert told.reset and table.space() == Space("other", 3) and set(contents(table.read())) == {"cz"}


def test_signature_check_drops_foreign_vectors(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), buckets=2)
    assert not table.check_signature("s")
    table.upsert(chunk_rows(spark, "ab"))
    assert not table.check_signature("s") and table.check_signature("other") and not table.check_signature("other")
    assert table.read().count() == 0 and table.space() is None
    assert not table.upsert(chunk_rows(spark, "a", "other", 5)).reset and table.space() == Space("other", 5)


def test_upsert_finds_an_id_under_its_old_source(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), buckets=16)
    table.upsert(chunk_rows(spark, "abcdef"))
    table.upsert(chunk_rows(spark, "a").withColumn("source", F.lit("moved")))
    got = contents(table.read())
    assert len(got) == 6 and got["ca"][0] == "moved"


def test_rows_of_one_id_are_settled_by_an_order(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 3, "last"), ("a", 2, "mid"), ("b", 1, "x"), ("b", 1, "y")], "chunk_id string, at int, content string")
    none = rows.limit(0)
    for n in (1, 3, 5):
        got = {r.chunk_id: r.content for r in upsert_chunks(none, rows.repartition(n), order=["at"]).collect()}
        assert got == {"a": "last", "b": "y"}


def test_vacuum_keeps_what_a_version_names(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), buckets=2)
    for text in ("one", "two", "three"):
        table.rebuild(chunk_rows(spark, "abc", text=text))
    table.versions._write(table.versions.manifest(), chunk_rows(spark, "z"))  # a writer that never published
    assert table.versions.vacuum(keep=2) == []
    assert len(table.versions.vacuum(keep=2, older_than_hours=0)) == 2
    assert table.versions.versions() == [2, 3]
    assert contents(table.read(2))["ca"] == ("a", "two a") and contents(table.read())["ca"] == ("a", "three a")


def test_a_source_with_most_rows_is_cut_into_files(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), buckets=4)
    rows = spark.range(20000).select(
        F.concat(F.lit("c"), "id").alias("chunk_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("source"),
        F.col("id").cast("int").alias("chunk_index"), F.lit("").alias("heading"), F.sha2(F.col("id").cast("string"), 512).alias("content"),
        F.lit("").alias("embed_text"), F.lit("s").alias("signature"), F.array(F.rand(1).cast("float")).alias("vector"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128k")
    try:
        table.rebuild(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert table.read().count() == 20000
    hot = table.read().where("source = 'hot'").select(F.input_file_name()).distinct().count()
    assert hot > 1


def test_reindex_embeds_anew(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "# T\n\none"), ("b.md", "x" * 1200), ("empty.md", "")], schemas.DOCUMENTS)
    rejects = spark.createDataFrame([("bad.md", "not_utf8")], "source string, reason string")
    table = ChunkTable(spark, str(tmp_path / "t"), buckets=2)
    report, first = reindex(docs, table, HASH8, rejects)
    assert {r.source: (r.chunks, r.status, r.error) for r in report.collect()} == {"a.md": (1, "success", None), "b.md": (3, "success", None), "empty.md": (0, "success", None), "bad.md": (0, "error", "not_utf8")}
    _, again = reindex(docs.where("source = 'a.md'"), table, HASH16)
    assert (first.reset, again.reset) == (False, True)
    assert [(r.source, r.signature, len(r.vector)) for r in table.read().collect()] == [("a.md", "s16", 16)]


VOTES = "trace_id string, created_at timestamp, verdict string, reason string"


def test_votes_merge_into_one_row_per_trace(spark, tmp_path):
    """Late, equal, repeated and batch-crossing votes; a batch leaves other buckets' folders alone."""
    batches = [
        [("a", "2024-01-02", "up", None), ("a", "2024-01-01", "down", "x"), ("b", "2024-01-05", "down", "r"), ("c", "2024-01-01", "up", None)],
        [("a", "2024-01-03", "down", "late"), ("b", "2024-01-01", "up", None), ("c", "2024-01-01", "down", "tie"), (None, "2024-01-01", "up", None)],
        [("a", "2024-01-03", "down", "late"), ("c", "2024-01-01", "up", "tie")],
    ]
    for order in ((0, 1, 2), (2, 1, 0)):
        root = tmp_path / str(order)
        versions = []
        for at in order:
            rows = spark.createDataFrame(batches[at], VOTES.replace("timestamp", "string")).withColumn("created_at", F.col("created_at").cast("timestamp"))
            rows.coalesce(1).write.mode("append").parquet(str(root / "in"))
            stream = spark.readStream.schema(VOTES).parquet(str(root / "in"))
            table = flows.vote_table(stream, str(root / "votes"), buckets=64)
            flows.merge_votes(stream, table, str(root / "ck")).awaitTermination()
            versions.append(table.manifest())
        got = {r.trace_id: (str(r.created_at)[:10], r.verdict, r.reason) for r in table.read().collect()}
        assert got == {"a": ("2024-01-03", "down", "late"), "b": ("2024-01-05", "down", "r"), "c": ("2024-01-01", "up", "tie"), None: ("2024-01-01", "up", None)}
        assert table.read().count() == 4
    touched = table.buckets_with(versions[-1], spark.createDataFrame([("a",), ("b",), ("c",)], "trace_id string"))
    kept = {b for b, f in versions[-1].folders.items() if versions[-2].folders.get(b) == f}
    assert kept and not kept & touched
