"""Registered streaming queries: each runs a stream over a given table to its end.

Results are read back from files in the shared checkpoint folder. Windows, sessions and joins that a
stream still holds open at the end of its input are added by the closing passes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.embedding import get_embedder
from folioscope.registry.chunk_queries import CHUNKS_SQL
from folioscope.registry.derive import EVENTS_SQL, FEEDBACK_SQL, load, turns
from folioscope.session import ensure_checkpoint_dir
from folioscope.sources.store import ChunkTable, list_documents
from folioscope.streaming import flows, state


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A given table, one file or a folder of files, as a file stream."""
    schema = load(spark, d, table).schema
    # A stream over a plain path takes folders only; a pattern may name either.
    return spark.readStream.schema(schema).parquet(f"{d}/{table}.parque[t]")


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = _folder(spark)
    flows.write_files(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return _as_requests(_stream(spark, d, "events"))


def _in_batches(spark: SparkSession, df: DataFrame, files: int = 6, per_batch: int = 2) -> DataFrame:
    """A derived table as a stream of several batches."""
    folder = _folder(spark)
    df.repartition(files).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def _as_requests(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").cast("string").alias("trace_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.when(F.col("value") >= 20, "agent").otherwise("pipeline").alias("route"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("event_type") != "signup", 100 + k).alias("prompt_tokens"),
        F.when(F.col("event_type") != "click", k * 3).alias("completion_tokens"),
        F.when(F.col("event_type") != "view", k / 1000).alias("cost"),
        (F.col("value") * 100).alias("latency_ms"),
        "event_type",
    )


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """What a stream over the requests keeps as its raw copy."""
    return _as_requests(load(spark, d, "events"))


def windowed_metrics(spark: SparkSession, d: str) -> DataFrame:
    by = ("route", "status")
    rows = flows.close_windows(_run(spark, flows.window_metrics(_requests(spark, d))), _raw(spark, d), flows.window_metrics, "1 day", "1 hour", by)
    return rows.select(
        F.unix_micros("window_start").alias("window_start"), "route", "status", "requests", "prompt_tokens", "completion_tokens",
        F.round("cost", 4).alias("cost"), F.round("latency_ms", 4).alias("latency_ms"), F.round("max_latency_ms", 4).alias("max_latency_ms"),
    )


def sliding_metrics(spark: SparkSession, d: str) -> DataFrame:
    def build(requests: DataFrame) -> DataFrame:
        return flows.window_metrics(requests, width="2 hours", slide="1 hour", by=("route",))

    rows = flows.close_windows(_run(spark, build(_requests(spark, d))), _raw(spark, d), build, "2 hours", "1 hour", ("route",))
    return rows.select(F.unix_micros("window_start").alias("window_start"), "route", "requests")


def session_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = flows.close_sessions(_run(spark, flows.session_metrics(_requests(spark, d), gap="6 hours")), _raw(spark, d), gap="6 hours")
    return rows.select("session_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "requests", "errors")


def _calls(df: DataFrame) -> DataFrame:
    return df.select(
        F.when(F.col("user_id") % 2 == 0, "store").otherwise("embedder").alias("dependency"),
        F.col("event_id").alias("call_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (~F.col("event_type").isin("error", "view")).alias("ok"),
    )


def failure_rate(spark: SparkSession, d: str) -> DataFrame:
    def build(calls: DataFrame) -> DataFrame:
        return flows.failure_rate(calls, width="12 hours", slide="3 hours", min_calls=6, delay="1 hour")

    rows = _run(spark, build(_calls(_stream(spark, d, "events"))))
    rows = flows.close_windows(rows, _calls(load(spark, d, "events")), build, "12 hours", "1 hour", ("dependency",), "ts")
    return rows.select("dependency", F.unix_micros("window_start").alias("window_start"), "calls", "failures")


def failure_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = flows.failure_runs(_calls(load(spark, d, "events")), span="6 hours")
    return rows.select("dependency", "call_id", "run")


def stream_failure_runs(spark: SparkSession, d: str) -> DataFrame:
    """The calls in several batches of time, shuffled inside; files carry runs from batch to batch."""
    raw = _calls(load(spark, d, "events"))
    folder = _folder(spark)
    low, high = (x or 0 for x in raw.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first())
    share = F.least(F.lit(4), F.floor((F.unix_micros("ts") - low) * 5 / max(1, high - low)))
    for part in range(5):  # one batch after the other: a run of the stream takes all files that are new
        raw.where(share == part).repartition("call_id").write.mode("append").parquet(f"{folder}/in")
        calls = spark.readStream.schema(raw.schema).parquet(f"{folder}/in")
        flows.run_batches(calls, f"{folder}/runs", f"{folder}/checkpoint", delay="2 hours", span="6 hours").awaitTermination()
    return flows.read_runs(raw, f"{folder}/runs", span="6 hours").select("dependency", "call_id", "run")


def stream_feedback_join(spark: SparkSession, d: str) -> DataFrame:
    """Requests joined with votes made an hour later; some requests have no vote, some votes no request."""

    def votes(requests: DataFrame) -> DataFrame:
        return requests.where(F.col("event_type").isin("error", "purchase")).select(
            F.concat(F.when(F.col("event_type") == "purchase", "").otherwise(F.when(F.col("latency_ms") > 1500, "lost-").otherwise("")), "trace_id").alias("trace_id"),
            (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("created_at"),
            F.when(F.col("event_type") == "error", "down").otherwise("up").alias("verdict"),
            F.lit(None).cast("string").alias("reason"),
        )

    asked, raw = _requests(spark, d), _raw(spark, d)
    rows = _run(spark, flows.feedback_join(asked, votes(_requests(spark, d)), within="2 hours", delay="1 hour"))
    rows = flows.close_feedback(rows, raw, votes(raw))
    return rows.select("trace_id", "route", "verdict", F.unix_micros("asked_at").alias("asked_at"), F.unix_micros("rated_at").alias("rated_at"))


def stream_latest_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Votes of one user on one event type, in several batches; the last one counts."""
    votes = _as_requests(load(spark, d, "events")).select(
        F.concat_ws("-", "session_id", "event_type").alias("trace_id"), "created_at", F.when(F.col("latency_ms") > 1500, "down").otherwise("up").alias("verdict")
    )
    folder, votes = _folder(spark), _in_batches(spark, votes)
    table = flows.vote_table(votes, f"{folder}/votes", buckets=16)
    flows.merge_votes(votes, table, f"{folder}/checkpoint").awaitTermination()
    return table.read().select("trace_id", "verdict", F.unix_micros("created_at").alias("created_at"))


def stream_conversations(spark: SparkSession, d: str) -> DataFrame:
    rows = _run(spark, state.stream_conversations(_stream(spark, d, "conversations"), trigger=5, keep=3, idle_ms=None))
    parsed = F.from_json("messages", "array<struct<role:string,content:string>>")
    return rows.select(
        "conv_id", "total", "folded", F.array_join(F.transform(parsed, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("messages")
    )


def stream_answers(spark: SparkSession, d: str) -> DataFrame:
    last = turns(spark, d).groupBy(F.col("conv_id").alias("c")).agg(F.max("turn").alias("_last"))
    kind = F.when(F.col("role") == "system", "reset").otherwise("token")
    one = F.struct(F.col("turn").alias("seq"), kind.alias("type"), F.col("text").alias("content"))
    done = F.struct((F.col("turn") + 1).alias("seq"), F.lit("done").alias("type"), F.lit("").alias("content"))
    events = (
        _stream(spark, d, "conversations")
        .join(last, F.col("conv_id") == F.col("c"))
        .select(F.col("conv_id").alias("trace_id"), F.explode(F.when(F.col("turn") == F.col("_last"), F.array(one, done)).otherwise(F.array(one))).alias("e"))
        .select("trace_id", "e.*")
    )
    return _run(spark, state.stream_answers(events, idle_ms=None))


def stream_index(spark: SparkSession, d: str) -> DataFrame:
    """Documents streamed into a chunk table; the result is its list of documents."""
    folder = _folder(spark)
    table = ChunkTable(spark, f"{folder}/chunks", buckets=8)
    line = F.transform(
        F.split("text", "\n"), lambda x, i: F.concat(F.when(i == 0, "# ").when(i % 3 == 0, "## ").otherwise(""), x)
    )
    docs = _stream(spark, d, "documents").select(
        F.concat(F.lit("doc"), "doc_id", F.lit(".md")).alias("source"), F.array_join(line, "\n\n").alias("content")
    )
    flows.stream_index(docs, table, get_embedder("hashing"), f"{folder}/checkpoint").awaitTermination()
    return list_documents(table.read())


STREAM_SQL = EVENTS_SQL

QUERIES = {
    f.__name__: f
    for f in (
        windowed_metrics, sliding_metrics, session_metrics, failure_rate, failure_runs, stream_failure_runs, stream_feedback_join,
        stream_latest_feedback, stream_conversations, stream_answers, stream_index,
    )
}

_CALLS = """calls AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'store' ELSE 'embedder' END AS dependency, event_id AS call_id, ts,
  event_type NOT IN ('error', 'view') AS ok FROM events)"""

ORACLES = {
    "windowed_metrics": f"""WITH {STREAM_SQL}, g AS (SELECT date_trunc('day', created_at) AS s, * FROM interactions)
      SELECT epoch_us(s) AS window_start, route, status, count(*) AS requests, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens,
        CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion_tokens, round(sum(coalesce(cost, 0)), 4) AS cost,
        round(sum(latency_ms), 4) AS latency_ms, round(max(latency_ms), 4) AS max_latency_ms
      FROM g GROUP BY s, route, status""",
    "sliding_metrics": f"""WITH {STREAM_SQL}, g AS (SELECT route, date_trunc('hour', created_at) - o * INTERVAL 1 HOUR AS s FROM interactions, (SELECT unnest([0, 1]) AS o))
      SELECT epoch_us(s) AS window_start, route, count(*) AS requests FROM g GROUP BY s, route""",
    "session_metrics": f"""WITH {STREAM_SQL}, l AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
        FROM interactions WINDOW w AS (PARTITION BY session_id ORDER BY created_at)),
      n AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY created_at) AS s FROM l),
      t AS (SELECT session_id, s, min(created_at) AS a, max(created_at) + INTERVAL 6 HOUR AS b, count(*) AS requests, count(*) FILTER (status <> 'ok') AS errors FROM n GROUP BY ALL)
      SELECT session_id, epoch_us(a) AS started, epoch_us(b) AS ended, requests, errors FROM t""",
    "failure_rate": f"""WITH {STREAM_SQL}, {_CALLS}, g AS (SELECT dependency, ok, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - o * INTERVAL 3 HOUR AS s
        FROM calls, (SELECT unnest([0, 1, 2, 3]) AS o)),
      t AS (SELECT dependency, s, count(*) AS calls, count(*) FILTER (NOT ok) AS failures FROM g GROUP BY ALL)
      SELECT dependency, epoch_us(s) AS window_start, calls, failures FROM t WHERE calls >= 6 AND failures >= calls * 0.5""",
    "failure_runs": f"""WITH {_CALLS}, n AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY dependency ORDER BY ts, call_id) AS g FROM calls),
      r AS (SELECT *, row_number() OVER (PARTITION BY dependency, g, ok ORDER BY ts, call_id) AS run FROM n WHERE NOT ok)
      SELECT dependency, call_id, run FROM r WHERE run = 3""",
    "stream_failure_runs": f"""WITH {_CALLS}, n AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY dependency ORDER BY ts, call_id) AS g FROM calls),
      r AS (SELECT *, row_number() OVER (PARTITION BY dependency, g, ok ORDER BY ts, call_id) AS run FROM n WHERE NOT ok)
      SELECT dependency, call_id, run FROM r WHERE run = 3""",
    "stream_feedback_join": f"""WITH {EVENTS_SQL}, v AS (
        SELECT CASE WHEN event_type = 'error' AND latency_ms > 1500 THEN 'lost-' ELSE '' END || trace_id AS trace_id,
          created_at + INTERVAL 1 HOUR AS rated_at, CASE event_type WHEN 'error' THEN 'down' ELSE 'up' END AS verdict
        FROM interactions WHERE event_type IN ('error', 'purchase'))
      SELECT coalesce(i.trace_id, v.trace_id) AS trace_id, coalesce(route, 'unknown') AS route, verdict, epoch_us(created_at) AS asked_at, epoch_us(rated_at) AS rated_at
      FROM interactions i FULL JOIN v ON v.trace_id = i.trace_id""",
    "stream_latest_feedback": f"""WITH {EVENTS_SQL} SELECT session_id || '-' || event_type AS trace_id,
        arg_max(CASE WHEN latency_ms > 1500 THEN 'down' ELSE 'up' END, created_at) AS verdict, epoch_us(max(created_at)) AS created_at FROM interactions GROUP BY ALL""",
    "stream_conversations": """WITH t AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS total,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
      SELECT conv_id, total, total - count(*) AS folded, string_agg(role || ':' || text, '|' ORDER BY turn) AS messages
      FROM t WHERE total < 5 OR back <= 3 GROUP BY conv_id, total""",
    "stream_answers": """WITH r AS (SELECT conv_id, max(CASE WHEN role = 'system' THEN turn END) AS r FROM conversations GROUP BY conv_id)
      SELECT r.conv_id AS trace_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role <> 'system' AND (r IS NULL OR turn > r)), '') AS answer, 'done' AS status
      FROM r JOIN conversations c ON c.conv_id = r.conv_id GROUP BY r.conv_id""",
    "stream_index": f"WITH RECURSIVE {CHUNKS_SQL} SELECT source, count(*) AS chunks FROM chunks GROUP BY source",
}
