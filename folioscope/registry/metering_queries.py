"""Registered metering queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import evaluation as V
from folioscope.operators import feedback as B
from folioscope.operators import metering as M
from folioscope.registry.derive import EVENTS_SQL, FEEDBACK_SQL, feedback_log, interactions, load

# Prices per 1000 tokens used by the registered queries.
PRICES = [("m0", 0.8, 2.0), ("m1", 0.4, None), ("default", 0.1, 0.2)]


def _pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, prompt double, completion double")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return interactions(spark, d).withColumns(
        {
            "latency_s": F.col("latency_ms") / 1000,
            "first_token_s": F.col("first_token_ms") / 1000,
            "model_calls": F.col("k") % 4,
            "retrieval_skipped": F.col("k") < 5,
        }
    )


def resolve_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d).select(
        "trace_id",
        F.when(F.col("event_type") == "view", F.col("prompt_tokens")).alias("prompt_tokens"),
        F.when(F.col("event_type") == "view", F.lit(None)).when(F.col("event_type") == "click", F.lit(7)).cast("long").alias("completion_tokens"),
        F.when(F.col("event_type") != "error", F.array(F.col("question"), F.get("contexts", 1)["text"])).alias("prompt_texts"),
        "answer",
    )
    return M.resolve_usage(rows).select("trace_id", "prompt_tokens", "completion_tokens", "tokens_source")


def price_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = M.price(interactions(spark, d), _pricing(spark))
    return rows.select("trace_id", "model", F.round("cost", 6).alias("cost"))


def flatten_request(spark: SparkSession, d: str) -> DataFrame:
    rows = _requests(spark, d).withColumn(
        "stage_seconds",
        F.create_map(F.lit("retrieve"), F.col("k") / 64, F.lit("generate"), F.when(F.col("k") > 9, F.col("k") / 4)),
    )
    return M.flatten_request(rows, ["retrieve", "generate", "rerank"]).select(
        "trace_id", "total_tokens", "retrieve_ms", "generate_ms", "rerank_ms"
    )


def request_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = M.request_counters(_requests(spark, d))
    return rows.select("metric", "labels", F.round("value", 4).alias("value"))


def feedback_counter(spark: SparkSession, d: str) -> DataFrame:
    votes = B.feedback_route(feedback_log(spark, d), interactions(spark, d))
    return M.feedback_counter(votes)


def tool_counter(spark: SparkSession, d: str) -> DataFrame:
    calls = interactions(spark, d).select(
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("tool"), (F.col("status") == "ok").alias("ok")
    )
    return M.tool_counter(calls)


def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = M.latency_histogram(_requests(spark, d), "latency_s", ["route"])
    return rows.select("route", "le", "observations", "total", F.round("sum", 4).alias("sum"))


def first_token_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = M.latency_histogram(_requests(spark, d), "first_token_s", ["route"], M.FIRST_TOKEN_BUCKETS)
    return rows.select("route", "le", "observations", "total", F.round("sum", 4).alias("sum"))


def stage_seconds(spark: SparkSession, d: str) -> DataFrame:
    stages = interactions(spark, d).select(
        F.col("session_id").alias("trace_id"), F.col("event_type").alias("stage"), (F.col("k") - 20).alias("seconds")
    )
    return M.stage_seconds(stages)


def update_gaps(spark: SparkSession, d: str) -> DataFrame:
    updates = interactions(spark, d).select(
        F.concat_ws("-", "session_id", F.date_format("created_at", "yyyyMMdd")).alias("trace_id"),
        F.col("created_at").alias("ts"),
        F.col("event_type").alias("stage"),
    )
    return M.update_gaps(updates).select("trace_id", "stage", F.round(F.col("seconds") * 1e6).cast("long").alias("micros"))


def agent_usage(spark: SparkSession, d: str) -> DataFrame:
    calls = interactions(spark, d).select(
        F.col("session_id").alias("trace_id"),
        F.when(F.col("k") >= 3, F.col("prompt_tokens")).alias("prompt_tokens"),
        F.when(F.col("k") >= 3, F.col("completion_tokens")).alias("completion_tokens"),
    )
    return M.agent_usage(calls)


def tool_outcomes(spark: SparkSession, d: str) -> DataFrame:
    messages = interactions(spark, d).select(
        F.col("session_id").alias("trace_id"),
        F.col("trace_id").cast("long").alias("seq"),
        F.col("event_type").alias("tool"),
        F.when(F.col("k") < 50, F.col("status") == "ok").alias("ok"),
        F.concat(F.lit("["), "event_type", F.when(F.col("k") % 3 == 0, " 失败] x").otherwise("] y"), F.col("k"), F.lit("\nmore")).alias("content"),
    )
    return M.tool_outcomes(messages)


def valid_trace_id(spark: SparkSession, d: str) -> DataFrame:
    """Ids of page addresses: unsafe ones are replaced by fresh ids, of which only the length is shown."""
    name = F.regexp_replace("url", "^https?://", " ")
    rows = load(spark, d, "pages").select("page_id", name.alias("given"), M.valid_trace_id(name).alias("id"))
    host = F.substring_index("given", "/", 1)
    checked = load(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://([^/]*).*$", " $1 ").alias("given"))
    safe = checked.select("page_id", M.valid_trace_id("given").alias("trace_id"))
    return safe.join(rows.select("page_id", F.length("id").cast("long").alias("fresh_length"), F.length(host).alias("_h")), "page_id").drop("_h")


def nearest_rank_quantiles(spark: SparkSession, d: str) -> DataFrame:
    rows = V.nearest_rank_quantiles(interactions(spark, d), "latency_ms", ["route"])
    return rows.select("route", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "p50", "p95", "max")])


def trace_timeline(spark: SparkSession, d: str) -> DataFrame:
    logged = interactions(spark, d)
    tools = logged.where("event_type = 'error'").select("trace_id", F.col("created_at").alias("ts"), F.col("event_type").alias("tool"))
    votes = B.latest_feedback(feedback_log(spark, d))
    return M.trace_timeline(logged, votes, tools).select("trace_id", F.unix_micros("ts").alias("ts"), "kind", "detail")


def _histogram_sql(column: str, buckets: list[float]) -> str:
    les = ", ".join("'+Inf'" if b == float("inf") else f"'{b:g}'" for b in buckets)
    bounds = ", ".join("CAST('inf' AS DOUBLE)" if b == float("inf") else f"CAST({b} AS DOUBLE)" for b in buckets)
    return f"""WITH {EVENTS_SQL}, b AS (SELECT unnest([{les}]) AS le, unnest([{bounds}]) AS bound),
      v AS (SELECT route, {column} / 1000 AS s FROM interactions WHERE {column} IS NOT NULL)
      SELECT route, le, count(*) FILTER (s <= bound) AS observations, count(*) AS total, round(sum(s), 4) AS sum FROM v, b GROUP BY route, le"""


_EST = "(length({0}) + 3) // 4"

QUERIES = {
    "resolve_usage": resolve_usage,
    "price_requests": price_requests,
    "flatten_request": flatten_request,
    "request_counters": request_counters,
    "feedback_counter": feedback_counter,
    "tool_counter": tool_counter,
    "latency_histogram": latency_histogram,
    "first_token_histogram": first_token_histogram,
    "stage_seconds": stage_seconds,
    "update_gaps": update_gaps,
    "agent_usage": agent_usage,
    "tool_outcomes": tool_outcomes,
    "valid_trace_id": valid_trace_id,
    "nearest_rank_quantiles": nearest_rank_quantiles,
    "trace_timeline": trace_timeline,
}

ORACLES = {
    "resolve_usage": f"""WITH {EVENTS_SQL} SELECT trace_id,
        CASE event_type WHEN 'view' THEN prompt_tokens WHEN 'click' THEN 0 WHEN 'error' THEN 0
          ELSE {_EST.format('question')} + {_EST.format("('text of ' || event_type)")} END AS prompt_tokens,
        CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 7 WHEN 'error' THEN 0 ELSE {_EST.format('answer')} END AS completion_tokens,
        CASE event_type WHEN 'view' THEN 'usage' WHEN 'click' THEN 'usage' WHEN 'error' THEN 'none' ELSE 'estimated' END AS tokens_source FROM interactions""",
    "price_requests": f"""WITH {EVENTS_SQL} SELECT trace_id, model, round((coalesce(prompt_tokens, 0) * CASE model WHEN 'm0' THEN CAST(0.8 AS DOUBLE) WHEN 'm1' THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END
        + coalesce(completion_tokens, 0) * CASE model WHEN 'm0' THEN CAST(2.0 AS DOUBLE) WHEN 'm1' THEN CAST(0 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END) / 1000, 6) AS cost FROM interactions""",
    "flatten_request": f"""WITH {EVENTS_SQL} SELECT trace_id, prompt_tokens + completion_tokens AS total_tokens, round(k / 64 * 1000, 1) AS retrieve_ms,
        CASE WHEN k > 9 THEN round(k / 4 * 1000, 1) END AS generate_ms, CAST(NULL AS DOUBLE) AS rerank_ms FROM interactions""",
    "request_counters": f"""WITH {EVENTS_SQL}, p AS (
        SELECT 'requests_total' AS metric, route || ',' || status AS labels, 1.0::DOUBLE AS value FROM interactions
        UNION ALL SELECT 'tokens_total', route || ',prompt,usage', prompt_tokens FROM interactions WHERE prompt_tokens > 0
        UNION ALL SELECT 'tokens_total', route || ',completion,usage', completion_tokens FROM interactions WHERE completion_tokens > 0
        UNION ALL SELECT 'cost_total', route || ',' || model, cost FROM interactions WHERE cost > 0
        UNION ALL SELECT 'model_calls_total', route, CASE WHEN k % 4 = 0 THEN 1 ELSE k % 4 END FROM interactions
        UNION ALL SELECT 'retrieval_skipped_total', '', 1 FROM interactions WHERE k < 5)
      SELECT metric, labels, round(sum(value), 4) AS value FROM p GROUP BY ALL""",
    "feedback_counter": f"""WITH {FEEDBACK_SQL} SELECT coalesce(i.route, 'unknown') AS route, v.verdict, count(*) AS votes
      FROM votes v LEFT JOIN interactions i USING (trace_id) GROUP BY ALL""",
    "tool_counter": """SELECT CASE event_type WHEN 'view' THEN 'unknown' ELSE event_type END AS tool,
      CASE event_type WHEN 'error' THEN 'fail' ELSE 'ok' END AS status, count(*) AS calls FROM events GROUP BY ALL""",
    "latency_histogram": _histogram_sql("latency_ms", M.LATENCY_BUCKETS),
    "first_token_histogram": _histogram_sql("first_token_ms", M.FIRST_TOKEN_BUCKETS),
    "stage_seconds": f"""WITH {EVENTS_SQL} SELECT session_id AS trace_id, event_type AS stage, CAST(sum(k - 20) AS BIGINT) AS seconds
      FROM interactions WHERE k >= 20 GROUP BY ALL""",
    "update_gaps": f"""WITH {EVENTS_SQL}, u AS (SELECT session_id || '-' || strftime(created_at, '%Y%m%d') AS trace_id, event_type AS stage, created_at AS ts FROM interactions),
      g AS (SELECT trace_id, stage, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY trace_id ORDER BY ts)) / 1e6 AS s FROM u)
      SELECT trace_id, stage, CAST(round(sum(s) * 1e6) AS BIGINT) AS micros FROM g WHERE s >= 0 GROUP BY ALL""",
    "agent_usage": f"""WITH {EVENTS_SQL} SELECT session_id AS trace_id, count(*) AS model_calls,
        CAST(sum(CASE WHEN k >= 3 THEN coalesce(prompt_tokens, 0) ELSE 0 END) AS BIGINT) AS prompt_tokens,
        CAST(sum(CASE WHEN k >= 3 THEN coalesce(completion_tokens, 0) ELSE 0 END) AS BIGINT) AS completion_tokens, bool_and(k >= 3) AS exact
      FROM interactions GROUP BY session_id""",
    "tool_outcomes": f"""WITH {EVENTS_SQL} SELECT session_id AS trace_id, event_type AS tool, count(*) AS calls,
        count(*) FILTER (CASE WHEN k < 50 THEN status <> 'ok' ELSE k % 3 = 0 END) AS failures,
        arg_max('[' || event_type || CASE WHEN k % 3 = 0 THEN ' 失败] x' ELSE '] y' END || k, event_id) AS summary FROM interactions GROUP BY ALL""",
    "valid_trace_id": """SELECT page_id, left(regexp_replace(url, '^https?://([^/]*).*$', '\\1'), 64) AS trace_id, CAST(16 AS BIGINT) AS fresh_length FROM pages""",
    "nearest_rank_quantiles": f"""WITH {EVENTS_SQL}, r AS (SELECT route, latency_ms AS v, row_number() OVER (PARTITION BY route ORDER BY latency_ms) - 1 AS i,
        count(*) OVER (PARTITION BY route) AS n FROM interactions)
      SELECT route, count(*) AS n, round(avg(v), 4) AS mean, round(median(v), 4) AS median,
        round(max(v) FILTER (i = least(n - 1, CAST(floor(n * 0.5::DOUBLE) AS BIGINT))), 4) AS p50,
        round(max(v) FILTER (i = least(n - 1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT))), 4) AS p95, round(max(v), 4) AS max FROM r GROUP BY route""",
    "trace_timeline": f"""WITH {FEEDBACK_SQL} SELECT trace_id, epoch_us(created_at) AS ts, 'request' AS kind, route || ' ' || status AS detail FROM interactions
      UNION ALL SELECT trace_id, epoch_us(created_at), 'feedback', concat_ws(' ', verdict, reason) FROM feedback
      UNION ALL SELECT trace_id, epoch_us(created_at), 'tool', 'error' FROM interactions WHERE event_type = 'error'""",
}
