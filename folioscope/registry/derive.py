"""Inputs of the registered queries, derived by Spark from the given tables.

Every recipe reads whole tables; the SQL twins in this package state the same recipe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import bound_batches


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as stored. Time stamps carry no zone, so the session runs in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Inputs up to this size are dealt over all cores; the bound holds whatever the cluster's size.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a small input stored in few pieces; a table over ``SPREAD_BYTES`` is left where it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the whole text is the body, the collection is the heading."""
    return spread(load(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".md")).alias("source"),
        F.col("source").alias("heading"),
        F.col("text").alias("content"),
    )


CORPUS_SQL = """corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS chunk_id, 'doc' || doc_id || '.md' AS source, source AS heading, text AS content
  FROM documents)"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: the first line is a title, every third line after it a subtitle."""
    line = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.concat(F.when(i == 0, "# ").when(i % 3 == 0, "## ").otherwise(""), x),
    )
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".md")).alias("source"),
        F.array_join(line, "\n\n").alias("content"),
    )


MARKDOWN_SQL = """md AS (
  SELECT 'doc' || doc_id || '.md' AS source,
         array_to_string(list_transform(string_split(text, chr(10)),
           lambda x, i: CASE WHEN i = 1 THEN '# ' WHEN (i - 1) % 3 = 0 THEN '## ' ELSE '' END || x), chr(10) || chr(10)) AS content
  FROM documents)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions."""
    return load(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def judged_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with expectations: the item's own characters 21-80 are the keyword."""
    return questions(spark, sf_dir).select(
        "query_id",
        "question",
        F.array(F.substring("question", 21, 60)).alias("expected_keywords"),
        F.array(F.concat(F.lit("doc"), F.col("query_id"), F.lit(".md"))).alias("expected_sources"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged requests. Nothing is left out: every event is one request."""
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("trace_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.when(F.col("value") >= 20, "agent").otherwise("pipeline").alias("route"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("event_type") == "view", "m0").when(F.col("event_type") == "click", "m1").otherwise("m2").alias("model"),
        F.lit("local").alias("provider"),
        F.concat(F.lit("question "), k).alias("question"),
        F.concat(F.lit("answer of "), F.col("event_type")).alias("answer"),
        F.array(
            F.struct(
                F.concat(F.lit("text "), k).alias("text"),
                F.concat(F.lit("doc"), k, F.lit(".md")).alias("source"),
                F.lit("A").alias("heading"),
            ),
            F.struct(
                F.concat(F.lit("text of "), F.col("event_type")).alias("text"),
                F.concat(F.col("event_type"), F.lit(".md")).alias("source"),
                F.lit("").alias("heading"),
            ),
        ).alias("contexts"),
        F.create_map(
            F.lit("retrieve_ms"),
            F.round(F.col("value"), 1).cast("string"),
            F.lit("agent_model_calls"),
            (k % 4).cast("string"),
            F.lit("note"),
            F.col("event_type"),
        ).alias("stages"),
        F.when(F.col("event_type") != "signup", 100 + k).alias("prompt_tokens"),
        F.when(F.col("event_type") != "click", k * 3).alias("completion_tokens"),
        F.lit("usage").alias("tokens_source"),
        F.when(F.col("event_type") != "view", k / 1000).alias("cost"),
        F.lit("CNY").alias("currency"),
        (F.col("value") * 100).alias("latency_ms"),
        F.when(k >= 10, F.col("value") * 40).alias("first_token_ms"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("E"), k % 7, F.lit(": failed"))).alias("error"),
        k.alias("k"),
        F.col("event_type"),
    )


EVENTS_SQL = """ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
interactions AS (
  SELECT CAST(event_id AS VARCHAR) AS trace_id, ts AS created_at, event_id, event_type, k, value,
         CASE WHEN value >= 20 THEN 'agent' ELSE 'pipeline' END AS route,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
         CAST(user_id AS VARCHAR) AS session_id,
         CASE event_type WHEN 'view' THEN 'm0' WHEN 'click' THEN 'm1' ELSE 'm2' END AS model,
         'question ' || k AS question, 'answer of ' || event_type AS answer,
         CASE WHEN event_type <> 'signup' THEN 100 + k END AS prompt_tokens,
         CASE WHEN event_type <> 'click' THEN k * 3 END AS completion_tokens,
         CASE WHEN event_type <> 'view' THEN k / 1000 END AS cost,
         value * 100 AS latency_ms, CASE WHEN k >= 10 THEN value * 40 END AS first_token_ms,
         CASE WHEN event_type = 'error' THEN 'E' || (k % 7) || ': failed' END AS error
  FROM ev)"""

# The codes a down vote may carry, with their labels.
REASON_CODES = ["incomplete", "wrong", "no_answer", "bad_citation", "slow", "other"]


def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes as they were submitted: errors are rated down, purchases up, with re-votes.

    Sign-ups are rated under a trace that was never logged. A vote on an expensive request
    (``value`` over 30) is followed by the opposite vote two hours later.
    """
    base = interactions(spark, sf_dir)
    code = F.array(*[F.lit(c) for c in REASON_CODES], F.lit(None).cast("string"))
    hour = F.expr("INTERVAL 1 HOUR")
    first = base.where(F.col("event_type").isin("error", "purchase", "signup")).select(
        F.when(F.col("event_type") == "signup", F.concat(F.lit("early-"), "trace_id"))
        .otherwise(F.col("trace_id"))
        .alias("trace_id"),
        (F.col("created_at") + hour).alias("created_at"),
        F.when(F.col("event_type") == "error", "down").otherwise("up").alias("verdict"),
        F.when(F.col("event_type") == "error", F.get(code, (F.col("k") % 7).cast("int"))).alias("reason"),
        F.when(F.col("k") >= 50, F.concat(F.lit("  note "), "k")).alias("comment"),
        (F.col("latency_ms") > 3000).alias("_again"),
    )
    again = first.where("_again").select(
        "trace_id",
        (F.col("created_at") + F.expr("INTERVAL 2 HOURS")).alias("created_at"),
        F.when(F.col("verdict") == "down", "up").otherwise("down").alias("verdict"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(None).cast("string").alias("comment"),
    )
    return first.drop("_again").unionByName(again)


FEEDBACK_SQL = (
    EVENTS_SQL
    + """,
first_votes AS (
  SELECT CASE WHEN event_type = 'signup' THEN 'early-' || trace_id ELSE trace_id END AS trace_id,
         created_at + INTERVAL 1 HOUR AS created_at,
         CASE WHEN event_type = 'error' THEN 'down' ELSE 'up' END AS verdict,
         CASE WHEN event_type = 'error' THEN
           (['incomplete', 'wrong', 'no_answer', 'bad_citation', 'slow', 'other', NULL])[CAST(k % 7 AS INTEGER) + 1] END AS reason,
         CASE WHEN k >= 50 THEN '  note ' || k END AS comment, latency_ms > 3000 AS again
  FROM interactions WHERE event_type IN ('error', 'purchase', 'signup')),
votes AS (
  SELECT trace_id, created_at, verdict, reason, comment FROM first_votes
  UNION ALL
  SELECT trace_id, created_at + INTERVAL 2 HOUR, CASE verdict WHEN 'down' THEN 'up' ELSE 'down' END, NULL, NULL
  FROM first_votes WHERE again),
feedback AS (
  SELECT trace_id, max(created_at) AS created_at, arg_max(verdict, created_at) AS verdict,
         arg_max(struct_pack(r := reason), created_at).r AS reason,
         nullif(left(trim(arg_max(struct_pack(c := comment), created_at).c), 2000), '') AS comment
  FROM votes GROUP BY trace_id)"""
)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
