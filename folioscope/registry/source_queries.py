"""Files written from the given tables and read back: no row, name, key or line may be lost."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.operators import embedding as E
from folioscope.plans import index
from folioscope.registry.chunk_queries import SECTIONS_SQL, chunks_sql
from folioscope.registry.derive import EVENTS_SQL, FEEDBACK_SQL, feedback_log, interactions, load, markdown
from folioscope.session import ensure_checkpoint_dir
from folioscope.sources import files
from folioscope.sources.store import ChunkTable
from folioscope.streaming import flows


def _written(spark: SparkSession, df: DataFrame) -> str:
    folder = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    files.write_jsonl(df, folder)
    return folder


def _table(spark: SparkSession) -> ChunkTable:
    return ChunkTable(spark, f"{ensure_checkpoint_dir(spark)}/chunks-{uuid.uuid4().hex}", buckets=16)


def _stored(spark: SparkSession, d: str, mark: str = "", signature: str = "first") -> DataFrame:
    """Every document as one stored chunk with a vector of two numbers."""
    text = F.concat(F.lit(mark), "text")
    return load(spark, d, "documents").select(
        F.concat(F.lit("c"), "doc_id").alias("chunk_id"), "source", F.col("doc_id").cast("int").alias("chunk_index"), F.col("lang").alias("heading"),
        text.alias("content"), text.alias("embed_text"), F.lit(signature).alias("signature"),
        F.array(F.lit(1.0), F.col("n_chars")).cast("array<float>").alias("vector"),
    ).select(*schemas.STORED_CHUNKS.names)


def chunk_versions(spark: SparkSession, d: str) -> DataFrame:
    """Every version of a chunk table after writes, an upsert, a replacement and a delete, per language."""
    table = _table(spark)
    table.replace_documents(_stored(spark, d))
    table.upsert(_stored(spark, d, "longer ").where("heading = 'fr'"))
    table.replace_documents(_stored(spark, d, "new ").where("source in ('src1', 'src2') and heading = 'en'"))
    table.delete_where({"heading": "de"})
    versions = [table.read(v).withColumn("version", F.lit(v).cast("long")) for v in table.versions.versions()]
    rows = reduce(DataFrame.unionByName, versions)
    return rows.groupBy("version", "heading").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).cast("long").alias("chars"))


def check_signature(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a second embedder end the table of the first; a check against a third empties it."""
    table = _table(spark)
    steps = []
    for signature, source in (("first", "src1"), ("first", "src2"), ("second", "src3"), ("second", "src1")):
        told = table.upsert(_stored(spark, d, signature=signature).where(F.col("source") == source))
        steps.append((told.version, told.reset))
    dropped = table.check_signature("third")
    steps.append((table.versions.manifest().version, dropped))
    told = spark.createDataFrame(steps, "version long, reset boolean")
    counts = [table.read(v).groupBy(F.lit(v).alias("version"), "signature").agg(F.count("*").alias("chunks")) for v, _ in steps]
    return told.join(reduce(DataFrame.unionByName, counts), "version", "left").select("version", "reset", "signature", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def reindex_store(spark: SparkSession, d: str) -> DataFrame:
    """A table indexed at one vector size, then all documents chunked and embedded anew at another."""
    table, docs = _table(spark), markdown(spark, d)
    index.reindex(docs.where("source like '%1.md'"), table, E.get_embedder("hashing", dim=16), size=250, overlap=0)
    report, written = index.reindex(docs, table, E.get_embedder("hashing", dim=32))
    sizes = table.read().groupBy("source").agg(F.min(F.size("vector")).cast("long").alias("dim"), F.min("signature").alias("signature"))
    return report.join(sizes, "source", "left").select("source", "chunks", "status", "dim", "signature", F.lit(written.reset).alias("reset"))


def read_questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as JSON questions; every third names a tool."""
    asked = load(spark, d, "benchmark").select(
        F.col("text").alias("question"), F.lit("fact").alias("type"),
        F.array(F.concat(F.lit("doc"), F.col("item_id"), F.lit(".md"))).alias("expected_sources"),
        F.when(F.col("item_id") % 3 == 0, "search_docs").alias("expected_tool"),
    )
    good, _ = files.read_questions(spark, _written(spark, asked))
    return good.select("question", "type", F.get("expected_sources", 0).alias("source"), "has_expected_tool", "expected_tool")


def read_request_log(spark: SparkSession, d: str) -> DataFrame:
    """Requests with the time of a stage and a key that no schema names."""
    log = interactions(spark, d).select(
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "trace_id", "route", "latency_ms",
        (F.col("k") * 2).alias("retrieve_ms"), F.concat(F.lit("t"), F.col("k")).alias("tag"),
    )
    rows = files.read_request_log(spark, _written(spark, log))
    return rows.select(
        "trace_id", "route", F.round("latency_ms", 4).alias("latency_ms"), F.unix_micros("ts").alias("ts"),
        F.col("stage_ms")["retrieve_ms"].alias("retrieve_ms"), F.col("extra")["tag"].alias("tag"),
    )


def read_scored(spark: SparkSession, d: str) -> DataFrame:
    """One score per labelled document."""
    scored = load(spark, d, "labels").select(
        F.lit("agent").alias("combo"), F.col("doc_id").cast("string").alias("user_input"), F.lit("judge").alias("judge"),
        F.create_map(F.lit("quality"), F.struct(F.col("quality").cast("double").alias("value"))).alias("scores"),
    )
    rows, _ = files.read_scored(spark, _written(spark, scored))
    return rows.select("judge", "combo", "user_input", "metric", "value")


def reconcile_feedback(spark: SparkSession, d: str) -> DataFrame:
    """All requests and last votes, matched or not."""
    rows = flows.reconcile_feedback(interactions(spark, d), feedback_log(spark, d))
    return rows.select("trace_id", "route", "verdict", F.col("asked_at").isNotNull().alias("logged"))


QUERIES = {f.__name__: f for f in (read_questions, read_request_log, read_scored, reconcile_feedback, chunk_versions, check_signature, reindex_store)}

ORACLES = {
    "read_questions": """SELECT text AS question, 'fact' AS type, 'doc' || item_id || '.md' AS source, item_id % 3 = 0 AS has_expected_tool,
        CASE WHEN item_id % 3 = 0 THEN 'search_docs' END AS expected_tool FROM benchmark""",
    "read_request_log": f"""WITH {EVENTS_SQL} SELECT trace_id, route, round(latency_ms, 4) AS latency_ms, epoch_us(created_at) AS ts,
        (k * 2)::DOUBLE AS retrieve_ms, 't' || k AS tag FROM interactions""",
    "read_scored": """SELECT 'judge' AS judge, 'agent' AS combo, CAST(doc_id AS VARCHAR) AS user_input, 'quality' AS metric,
        quality::DOUBLE AS value FROM labels""",
    "reconcile_feedback": f"""WITH {FEEDBACK_SQL}, l AS (SELECT trace_id, arg_max(verdict, created_at) AS verdict FROM votes GROUP BY trace_id)
      SELECT coalesce(i.trace_id, l.trace_id) AS trace_id, coalesce(route, 'unknown') AS route, verdict, i.trace_id IS NOT NULL AS logged
      FROM interactions i FULL JOIN l ON i.trace_id = l.trace_id""",
    "chunk_versions": """WITH v1 AS (SELECT doc_id, source, lang, length(text) AS n FROM documents),
      v2 AS (SELECT doc_id, source, lang, n + CASE WHEN lang = 'fr' THEN 7 ELSE 0 END AS n FROM v1),
      v3 AS (SELECT doc_id, source, lang, n + CASE WHEN source IN ('src1', 'src2') THEN 4 ELSE 0 END AS n FROM v2
        WHERE lang = 'en' OR source NOT IN (SELECT source FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en')),
      a AS (SELECT 1::BIGINT AS version, lang, n FROM v1 UNION ALL SELECT 2, lang, n FROM v2 UNION ALL SELECT 3, lang, n FROM v3
        UNION ALL SELECT 4, lang, n FROM v3 WHERE lang <> 'de')
      SELECT version, lang AS heading, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS chars FROM a GROUP BY version, lang""",
    "check_signature": """WITH n AS (SELECT count(*) FILTER (source = 'src1') AS a, count(*) FILTER (source = 'src2') AS b, count(*) FILTER (source = 'src3') AS c FROM documents)
      SELECT 1::BIGINT AS version, false AS reset, 'first' AS signature, a AS chunks FROM n UNION ALL SELECT 2, false, 'first', a + b FROM n
      UNION ALL SELECT 3, true, 'second', c FROM n UNION ALL SELECT 4, false, 'second', c + a FROM n UNION ALL SELECT 5, true, NULL, 0""",
    "reindex_store": f"""WITH RECURSIVE {SECTIONS_SQL}{chunks_sql("chunks", 500, 50)}
      SELECT m.source, count(c.chunk_id) AS chunks, 'success' AS status, CASE WHEN count(c.chunk_id) > 0 THEN 32::BIGINT END AS dim,
        CASE WHEN count(c.chunk_id) > 0 THEN 'hashing:bigram-32' END AS signature, true AS reset
      FROM md m LEFT JOIN chunks c USING (source) GROUP BY m.source""",
}
