"""Registered conversation queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import dialogue as D
from folioscope.registry.chunk_queries import WS
from folioscope.registry.derive import load, turns

PATTERNS = "^L, que "


def sanitize_history(spark: SparkSession, d: str) -> DataFrame:
    return D.sanitize_turns(turns(spark, d), 4).select("conv_id", "turn", "role")


def format_history(spark: SparkSession, d: str) -> DataFrame:
    rows = D.collect_history(turns(spark, d), 6)
    return rows.select("conv_id", D.format_history("history").alias("formatted"))


def _dialogues(spark: SparkSession, d: str) -> DataFrame:
    """The last turn of each conversation as the question, the turns before it as history."""
    last = turns(spark, d).groupBy("conv_id").agg(
        F.max("turn").alias("_last"), F.max_by("text", "turn").alias("question")
    )
    earlier = turns(spark, d).join(last.select("conv_id", "_last"), "conv_id").where("turn < _last")
    past = D.collect_history(earlier, 6)
    return last.join(past, "conv_id", "left").select(F.col("conv_id").alias("query_id"), "question", "history")


def needs_rewrite(spark: SparkSession, d: str) -> DataFrame:
    rows = _dialogues(spark, d)
    return rows.select(
        "query_id",
        D.needs_rewrite("question", "history").alias("by_default"),
        D.needs_rewrite("question", "history", mode="always").alias("always"),
        D.needs_rewrite("question", "history", mode="off").alias("off"),
        D.needs_rewrite("question", "history", patterns=PATTERNS).alias("by_pattern"),
        D.needs_rewrite("question", "history", max_len=80).alias("by_length"),
    )


def _raw_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """What a model might return: quoted, labelled or blank, by role."""
    return turns(spark, d).select(
        "conv_id",
        "turn",
        "text",
        F.when(F.col("role") == "user", F.concat(F.lit(' "'), "text", F.lit('"\n')))
        .when(F.col("role") == "assistant", F.concat(F.lit("改写后的问题： 问题:"), F.col("text")))
        .otherwise("「」 ")
        .alias("raw"),
    )


def normalize_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return _raw_rewrites(spark, d).select("conv_id", "turn", D.normalize_rewrite("raw", "text").alias("rewritten"))


def resolve_search_query(spark: SparkSession, d: str) -> DataFrame:
    rewrites = _raw_rewrites(spark, d).groupBy(F.col("conv_id").alias("query_id")).agg(F.max_by("raw", "turn").alias("rewritten"))
    return D.resolve_search_query(_dialogues(spark, d), rewrites, max_len=200)


def compaction_plan(spark: SparkSession, d: str) -> DataFrame:
    tools = turns(spark, d).withColumn("role", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")))
    return D.compaction_plan(tools, trigger=4, keep=2)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select(
        F.col("conv_id").alias("trace_id"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "system", "reset").otherwise("token").alias("type"),
        F.col("text").alias("content"),
    )


def assemble_answer(spark: SparkSession, d: str) -> DataFrame:
    return D.assemble_answer(_events(spark, d))


def split_reasoning(spark: SparkSession, d: str) -> DataFrame:
    """User turns open a reasoning block with a tag cut in two, assistant turns close it."""
    pieces = turns(spark, d).select(
        F.col("conv_id").alias("trace_id"),
        F.col("role"),
        F.col("turn"),
        F.posexplode(
            F.when(F.col("role") == "user", F.array(F.concat("text", F.lit("<thi")), F.lit("nk>why")))
            .when(F.col("role") == "assistant", F.array(F.lit("so</th"), F.concat(F.lit("ink>"), "text")))
            .otherwise(F.array(F.col("text"), F.lit("")))
        ).alias("_at", "content"),
    )
    fragments = pieces.select(
        "trace_id",
        (F.col("turn") * 2 + F.col("_at")).alias("seq"),
        F.when(F.col("role") == "system", "reasoning").otherwise("token").alias("type"),
        "content",
    )
    return D.split_reasoning(fragments)


def is_refusal(spark: SparkSession, d: str) -> DataFrame:
    """Answers with a refusal at the front, behind a reasoning block, or late in the text."""
    answer = (
        F.when(F.col("role") == "user", F.concat(F.lit("<think>没有找到</think>"), F.col("text")))
        .when(F.col("role") == "system", F.concat(F.lit("资料中没有相关内容 "), F.col("text")))
        .otherwise(F.concat(F.col("text"), F.lit(" 未找到")))
    )
    rows = turns(spark, d).select("conv_id", "turn", answer.alias("answer"))
    return rows.select(
        "conv_id", "turn", D.is_refusal("answer").alias("refused"), D.has_refusal_marker("answer").alias("marked")
    )


def parse_yes_no(spark: SparkSession, d: str) -> DataFrame:
    reply = (
        F.when(F.col("role") == "user", F.concat(F.lit("<think>否</think> 是，"), F.col("text")))
        .when(F.col("role") == "system", F.lit("不是/否"))
        .otherwise(F.col("text"))
    )
    rows = turns(spark, d).select("conv_id", "turn", reply.alias("reply"))
    return rows.select("conv_id", "turn", D.parse_yes_no("reply").alias("verdict"))


def conversation_state(spark: SparkSession, d: str) -> DataFrame:
    state = D.conversation_state(turns(spark, d), trigger=5, keep=3)
    return state.select(
        "conv_id",
        "total",
        "folded",
        F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("messages"),
    )


DIALOGUES_SQL = f"""c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
q AS (SELECT conv_id AS query_id, text AS question FROM c WHERE back = 1),
h AS (SELECT conv_id, bool_or(back = 2 AND role IN ('user', 'assistant') AND text <> '') AS present FROM c GROUP BY conv_id),
dialogues AS (SELECT q.*, coalesce(h.present, false) AS present, trim(question, {WS}) AS asked FROM q JOIN h ON h.conv_id = q.query_id)"""

REFERRING = "|".join(D.REFERRING_PATTERNS)
RAW_SQL = """raw AS (SELECT conv_id, turn, text, role, CASE role WHEN 'user' THEN ' "' || text || '"' || chr(10)
   WHEN 'assistant' THEN '改写后的问题： 问题:' || text ELSE '「」 ' END AS raw FROM conversations)"""
_CLEAN = f"""CASE role WHEN 'user' THEN coalesce(nullif(trim(text, {WS}), ''), text)
   WHEN 'assistant' THEN coalesce(nullif(trim(text, {WS}), ''), text) ELSE '「」' END"""

QUERIES = {
    "sanitize_history": sanitize_history,
    "format_history": format_history,
    "needs_rewrite": needs_rewrite,
    "normalize_rewrite": normalize_rewrite,
    "resolve_search_query": resolve_search_query,
    "compaction_plan": compaction_plan,
    "assemble_answer": assemble_answer,
    "split_reasoning": split_reasoning,
    "is_refusal": is_refusal,
    "parse_yes_no": parse_yes_no,
    "conversation_state": conversation_state,
}

ORACLES = {
    "sanitize_history": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
      SELECT conv_id, turn, role FROM t WHERE back <= 4 AND role IN ('user', 'assistant') AND text <> ''""",
    "format_history": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
      SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '用户：' ELSE '助手：' END || text, chr(10) ORDER BY turn) AS formatted
      FROM t WHERE back <= 6 AND role IN ('user', 'assistant') AND text <> '' GROUP BY conv_id""",
    "needs_rewrite": f"""WITH {DIALOGUES_SQL} SELECT query_id,
        present AND (length(asked) <= 12 OR regexp_matches(asked, '{REFERRING}')) AS by_default, present AS always, false AS off,
        present AND regexp_matches(asked, '^L|que') AS by_pattern,
        present AND (length(asked) <= 80 OR regexp_matches(asked, '{REFERRING}')) AS by_length FROM dialogues""",
    "normalize_rewrite": f"WITH {RAW_SQL} SELECT conv_id, turn, {_CLEAN} AS rewritten FROM raw",
    "resolve_search_query": f"""WITH {DIALOGUES_SQL}, {RAW_SQL}, r AS (SELECT conv_id, arg_max({_CLEAN}, turn) AS rewritten FROM raw GROUP BY conv_id),
      n AS (SELECT *, present AND (length(asked) <= 200 OR regexp_matches(asked, '{REFERRING}')) AS needed FROM dialogues)
      SELECT query_id, asked AS original_question, CASE WHEN needed THEN rewritten ELSE asked END AS search_query, needed AS rewrite_applied,
        CASE WHEN NOT needed THEN CASE WHEN present THEN 'heuristic_not_matched' ELSE 'no_history' END END AS rewrite_skipped_reason
      FROM n JOIN r ON r.conv_id = n.query_id""",
    "compaction_plan": """WITH t AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'tool' ELSE role END AS role,
        count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
      u AS (SELECT *, min(CASE WHEN back <= 2 AND role <> 'tool' THEN turn END) OVER (PARTITION BY conv_id) AS cut FROM t)
      SELECT conv_id, turn, role, n >= 4 AND (cut IS NULL OR turn < cut) AS folded FROM u""",
    "assemble_answer": """WITH r AS (SELECT conv_id, max(CASE WHEN role = 'system' THEN turn END) AS r FROM conversations GROUP BY conv_id)
      SELECT r.conv_id AS trace_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role <> 'system' AND (r IS NULL OR turn > r)), '') AS answer
      FROM r JOIN conversations c ON c.conv_id = r.conv_id GROUP BY r.conv_id""",
    "split_reasoning": """WITH t AS (SELECT conv_id,
          coalesce(string_agg(CASE role WHEN 'user' THEN text || '<think>why' WHEN 'assistant' THEN 'so</think>' || text END, '' ORDER BY turn), '') AS t,
          coalesce(string_agg(CASE role WHEN 'system' THEN text END, '' ORDER BY turn), '') AS f FROM conversations GROUP BY conv_id)
      SELECT conv_id AS trace_id, regexp_replace(t, '(?s)<think>(.*?)(?:</think>|\\z)', '', 'g') AS answer,
        f || array_to_string(regexp_extract_all(t, '(?s)<think>(.*?)(?:</think>|\\z)', 1), '') AS reasoning FROM t""",
    "is_refusal": f"""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN '<think>没有找到</think>' || text
          WHEN 'system' THEN '资料中没有相关内容 ' || text ELSE text || ' 未找到' END AS a FROM conversations)
      SELECT conv_id, turn, regexp_matches(left(trim(regexp_replace(a, '(?s)<think>.*?</think>', '', 'g'), {WS}), 150), '{D.REFUSAL_PATTERN}') AS refused,
        {" OR ".join(f"contains(a, '{m}')" for m in D.REFUSAL_MARKERS)} AS marked FROM t""",
    "parse_yes_no": """SELECT conv_id, turn, CASE role WHEN 'user' THEN true WHEN 'system' THEN false END AS verdict FROM conversations""",
    "conversation_state": """WITH t AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS total,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
      SELECT conv_id, total, total - count(*) AS folded, string_agg(role || ':' || text, '|' ORDER BY turn) AS messages
      FROM t WHERE total < 5 OR back <= 3 GROUP BY conv_id, total""",
}
