"""Registered feedback queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import feedback as B
from folioscope.registry.derive import EVENTS_SQL, FEEDBACK_SQL, feedback_log, interactions

CAP = 600


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return B.latest_feedback(B.accepted_feedback(feedback_log(spark, d)))


def _micros(column: str):
    return F.unix_micros(column).alias(column)


def upsert_interactions(spark: SparkSession, d: str) -> DataFrame:
    """Errors are logged a second time with another route."""
    logged = interactions(spark, d).select("trace_id", "created_at", "route", "status")
    again = logged.where("status = 'error'").select(
        "trace_id", (F.col("created_at") - F.expr("INTERVAL 5 MINUTES")).alias("created_at"), F.lit("retry").alias("route"), F.lit("ok").alias("status")
    )
    return B.upsert_interactions(logged, again).select("trace_id", _micros("created_at"), "route", "status")


def project_stages(spark: SparkSession, d: str) -> DataFrame:
    kept = interactions(spark, d).select("trace_id", F.explode(B.project_stages("stages")).alias("stage", "value"))
    return kept.groupBy("stage").agg(F.count("*").alias("entries"))


def validate_feedback(spark: SparkSession, d: str) -> DataFrame:
    submitted = interactions(spark, d).select(
        "trace_id",
        F.when(F.col("event_type") == "view", "meh").when(F.col("status") == "error", "down").otherwise("up").alias("verdict"),
        F.when(F.col("k") < 30, "slow").when(F.col("k") < 40, "").when(F.col("k") < 50, "boring").alias("reason"),
        F.when(F.col("k") < 60, F.concat(F.lit(" \n"), "question")).when(F.col("k") < 80, " ").alias("comment"),
    )
    return B.validate_feedback(submitted)


def latest_feedback(spark: SparkSession, d: str) -> DataFrame:
    return _votes(spark, d).select("trace_id", _micros("created_at"), "verdict", "reason", "comment")


def feedback_route(spark: SparkSession, d: str) -> DataFrame:
    return B.feedback_route(_votes(spark, d), interactions(spark, d)).groupBy("route", "verdict").agg(F.count("*").alias("votes"))


def prune_unrated(spark: SparkSession, d: str) -> DataFrame:
    return B.prune_unrated(interactions(spark, d), _votes(spark, d), CAP).select("trace_id", "route")


def satisfaction(spark: SparkSession, d: str) -> DataFrame:
    return B.satisfaction(_votes(spark, d)).select("up", "down", F.round("satisfaction", 4).alias("satisfaction"))


def down_reasons(spark: SparkSession, d: str) -> DataFrame:
    return B.down_reasons(_votes(spark, d))


def reason_report(spark: SparkSession, d: str) -> DataFrame:
    return B.reason_report(_votes(spark, d))


def route_costs(spark: SparkSession, d: str) -> DataFrame:
    rows = B.route_costs(interactions(spark, d))
    return rows.select("route", "requests", *[F.round(c, 4).alias(c) for c in rows.columns[2:]])


def badcases(spark: SparkSession, d: str) -> DataFrame:
    return B.badcases(interactions(spark, d), _votes(spark, d)).select(
        "trace_id", _micros("rated_at"), "question", "reason", "comment", F.get("contexts", 0)["source"].alias("first_source")
    )


def badcases_to_questions(spark: SparkSession, d: str) -> DataFrame:
    existing = interactions(spark, d).where("event_type = 'view' AND k < 20").select("question")
    rated = B.rated_interactions(interactions(spark, d), _votes(spark, d))
    rows = B.badcases_to_questions(rated, existing, route="agent")
    return rows.select(
        "question",
        "type",
        F.array_join("expected_sources", ",").alias("sources"),
        F.col("_badcase.trace_id").alias("trace_id"),
        F.col("_badcase.reason_label").alias("reason_label"),
        F.col("_badcase.total_tokens").alias("total_tokens"),
    )


_LABELS = "CASE reason " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in B.REASONS.items()) + " ELSE reason END"

QUERIES = {
    "upsert_interactions": upsert_interactions,
    "project_stages": project_stages,
    "validate_feedback": validate_feedback,
    "latest_feedback": latest_feedback,
    "feedback_route": feedback_route,
    "prune_unrated": prune_unrated,
    "satisfaction": satisfaction,
    "down_reasons": down_reasons,
    "reason_report": reason_report,
    "route_costs": route_costs,
    "badcases": badcases,
    "badcases_to_questions": badcases_to_questions,
}

ORACLES = {
    "upsert_interactions": f"""WITH {EVENTS_SQL} SELECT trace_id,
        epoch_us(CASE WHEN status = 'error' THEN created_at - INTERVAL 5 MINUTE ELSE created_at END) AS created_at,
        CASE WHEN status = 'error' THEN 'retry' ELSE route END AS route, 'ok' AS status FROM interactions""",
    "project_stages": """SELECT unnest(['retrieve_ms', 'agent_model_calls']) AS stage, count(*) AS entries FROM events""",
    "validate_feedback": f"""WITH {EVENTS_SQL}, s AS (SELECT trace_id, CASE WHEN event_type = 'view' THEN 'meh' WHEN status = 'error' THEN 'down' ELSE 'up' END AS verdict,
        CASE WHEN k < 30 THEN 'slow' WHEN k < 40 THEN '' WHEN k < 50 THEN 'boring' END AS reason, CASE WHEN k < 60 THEN question END AS comment FROM interactions)
      SELECT *, CASE WHEN verdict NOT IN ('up', 'down') THEN 'bad_verdict' WHEN reason = 'boring' THEN 'bad_reason' END AS problem FROM s""",
    "latest_feedback": f"WITH {FEEDBACK_SQL} SELECT trace_id, epoch_us(created_at) AS created_at, verdict, reason, comment FROM feedback",
    "feedback_route": f"""WITH {FEEDBACK_SQL} SELECT coalesce(route, 'unknown') AS route, verdict, count(*) AS votes
      FROM feedback LEFT JOIN interactions USING (trace_id) GROUP BY ALL""",
    "prune_unrated": f"""WITH {FEEDBACK_SQL}, u AS (SELECT trace_id, row_number() OVER (ORDER BY created_at, trace_id) AS place
        FROM interactions WHERE trace_id NOT IN (SELECT trace_id FROM feedback)),
      gone AS (SELECT trace_id FROM u WHERE place <= (SELECT count(*) - {CAP} FROM interactions))
      SELECT trace_id, route FROM interactions WHERE trace_id NOT IN (FROM gone)""",
    "satisfaction": f"""WITH {FEEDBACK_SQL} SELECT count(*) FILTER (verdict = 'up') AS up, count(*) FILTER (verdict = 'down') AS down,
      round(count(*) FILTER (verdict = 'up') / count(*), 4) AS satisfaction FROM feedback""",
    "down_reasons": f"WITH {FEEDBACK_SQL} SELECT reason, count(*) AS votes FROM feedback WHERE verdict = 'down' AND reason IS NOT NULL GROUP BY reason",
    "reason_report": f"""WITH {FEEDBACK_SQL} SELECT reason, count(*) AS votes, {_LABELS} AS label FROM feedback
      WHERE verdict = 'down' AND reason IS NOT NULL GROUP BY reason""",
    "route_costs": f"""WITH {EVENTS_SQL} SELECT route, count(*) AS requests, round(avg(latency_ms), 4) AS avg_latency_ms,
        round(avg(prompt_tokens + completion_tokens), 4) AS avg_tokens, round(avg(coalesce(cost, 0)), 4) AS avg_cost, round(sum(coalesce(cost, 0)), 4) AS total_cost
      FROM interactions WHERE status = 'ok' GROUP BY route""",
    "badcases": f"""WITH {FEEDBACK_SQL} SELECT f.trace_id, epoch_us(f.created_at) AS rated_at, question, reason, comment, 'doc' || k || '.md' AS first_source
      FROM feedback f JOIN interactions i USING (trace_id) WHERE verdict = 'down' ORDER BY f.created_at DESC, f.trace_id LIMIT 200""",
    "badcases_to_questions": f"""WITH {FEEDBACK_SQL}, r AS (SELECT question, trace_id, reason, f.created_at AS rated_at, k, event_type,
          coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) AS total_tokens,
          row_number() OVER (PARTITION BY question ORDER BY f.created_at DESC, reverse(trace_id) DESC) AS back
        FROM feedback f JOIN interactions i USING (trace_id) WHERE verdict = 'down' AND route = 'agent'
          AND question NOT IN (SELECT question FROM interactions WHERE event_type = 'view' AND k < 20))
      SELECT question, 'badcase:' || coalesce(reason, 'unspecified') AS type, 'doc' || k || '.md,' || event_type || '.md' AS sources, trace_id,
        coalesce({_LABELS}, 'unspecified') AS reason_label, total_tokens FROM r WHERE back = 1""",
}
