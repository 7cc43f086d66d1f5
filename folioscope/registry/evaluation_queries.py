"""Registered evaluation queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import evaluation as V
from folioscope.registry.derive import CORPUS_SQL, EVENTS_SQL, corpus, interactions, load
from folioscope.registry.retrieval_queries import LEGS_SQL, _judged_ablation

TOOLS = ["search_docs", "expand_section", "find_literal"]


# ---------------------------------------------------------------- derived inputs


def question_set(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as a labelled question set with some deliberate mistakes."""
    size = F.length("text")
    return load(spark, d, "benchmark").select(
        F.col("item_id").alias("question_id"),
        F.col("text").alias("question"),
        F.when(size > 260, "unanswerable").when(size > 200, "multi-hop").when(size > 120, "single-hop").alias("type"),
        F.when(size >= 150, F.substring("text", 1, 40)).alias("ground_truth"),
        F.array(F.substring("text", 21, 60), F.get(F.split("text", " "), 1)).alias("expected_keywords"),
        F.array(
            F.concat(F.lit("doc"), "item_id", F.lit(".md")), F.concat(F.when(size > 180, "ghost").otherwise("doc"), "item_id", F.lit(".md"))
        ).alias("expected_sources"),
    )


QUESTION_SQL = """qs AS (SELECT item_id AS question_id, text AS question,
  CASE WHEN length(text) > 260 THEN 'unanswerable' WHEN length(text) > 200 THEN 'multi-hop' WHEN length(text) > 120 THEN 'single-hop' END AS type,
  CASE WHEN length(text) >= 150 THEN substr(text, 1, 40) END AS ground_truth,
  [substr(text, 21, 60), string_split(text, ' ')[2]] AS kws,
  ['doc' || item_id || '.md', CASE WHEN length(text) > 180 THEN 'ghost' ELSE 'doc' END || item_id || '.md'] AS srcs FROM benchmark)"""


def tool_runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as assistant runs with expectations."""
    e = interactions(spark, d)
    kind, k = F.col("event_type"), F.col("k")
    none = F.array().cast("array<string>")
    tools = (
        F.when(kind == "view", F.array(F.lit(TOOLS[0])))
        .when(kind == "click", F.array(F.lit(TOOLS[0]), F.lit(TOOLS[1])))
        .when(kind == "purchase", F.array(F.lit(TOOLS[2])))
        .when(kind == "error", F.array(F.lit(TOOLS[0])))
        .otherwise(none)
    )
    wanted = F.get(F.array(*[F.lit(t) for t in TOOLS]), (k % 3).cast("int"))
    has_context = (kind != "signup") & (F.col("latency_ms") >= 500)
    return e.select(
        F.col("trace_id").alias("question_id"),
        "question",
        kind.alias("type"),
        (k >= 20).alias("has_expected_tool"),
        F.when(k >= 40, wanted).alias("expected_tool"),
        F.when(k >= 10, F.array(F.concat(F.lit("doc"), k % 9, F.lit(".md")))).otherwise(none).alias("expected_sources"),
        F.when(k < 90, F.array(F.lit("answer"), k.cast("string"), F.lit("5"))).otherwise(none).alias("expected_keywords"),
        F.concat(F.lit("answer "), k * 3, F.when(F.col("latency_ms") < 200, " 未找到").otherwise("")).alias("answer"),
        F.when(
            has_context,
            F.array(
                F.struct(
                    F.concat(F.lit("text "), k).alias("text"),
                    F.concat(F.lit("doc"), F.col("session_id").cast("long") % 9, F.lit(".md")).alias("source"),
                    F.lit("").alias("heading"),
                )
            ),
        )
        .otherwise(F.array().cast("array<struct<text:string,source:string,heading:string>>"))
        .alias("contexts"),
        tools.alias("tools_called"),
        (F.size(tools) + 1).alias("model_calls"),
        F.when(kind == "error", 1).otherwise(0).alias("tool_failures"),
        (F.size(tools) == 0).alias("retrieval_skipped"),
        F.when((kind == "error") & (F.col("latency_ms") > 3000), "Timeout: slow").alias("error"),
        (F.col("latency_ms") / 100).alias("total_s"),
        F.when(k >= 10, F.col("latency_ms") / 400).alias("first_token_s"),
        F.when(k >= 50, F.col("question")).alias("ground_truth"),
        k,
    )


RUNS_SQL = (
    EVENTS_SQL
    + """,
runs AS (SELECT trace_id AS question_id, event_type AS type, k, k >= 20 AS has_tool,
  CASE WHEN k >= 40 THEN (['search_docs', 'expand_section', 'find_literal'])[CAST(k % 3 AS INTEGER) + 1] END AS expected_tool,
  CASE WHEN k >= 10 THEN ['doc' || (k % 9) || '.md'] ELSE [] END AS expected_sources,
  CASE WHEN k < 90 THEN ['answer', CAST(k AS VARCHAR), '5'] ELSE [] END AS kws,
  'answer ' || (k * 3) || CASE WHEN latency_ms < 200 THEN ' 未找到' ELSE '' END AS answer,
  CASE WHEN event_type <> 'signup' AND latency_ms >= 500 THEN ['doc' || (CAST(session_id AS BIGINT) % 9) || '.md'] ELSE [] END AS ctx,
  CASE event_type WHEN 'view' THEN ['search_docs'] WHEN 'click' THEN ['search_docs', 'expand_section'] WHEN 'purchase' THEN ['find_literal']
    WHEN 'error' THEN ['search_docs'] ELSE [] END AS tools,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS tool_failures,
  CASE WHEN event_type = 'error' AND latency_ms > 3000 THEN 'Timeout: slow' END AS error,
  latency_ms / 100 AS total_s, CASE WHEN k >= 10 THEN latency_ms / 400 END AS first_token_s,
  question, CASE WHEN k >= 50 THEN question END AS ground_truth FROM interactions),
judged AS (SELECT *,
  CASE WHEN has_tool THEN CASE WHEN expected_tool IS NULL THEN len(tools) = 0 ELSE list_contains(tools, expected_tool) END END AS tool_ok,
  CASE WHEN len(expected_sources) > 0 THEN list_has_any(ctx, expected_sources) END AS source_ok,
  CASE WHEN len(kws) > 0 THEN len(list_filter(kws, lambda w: contains(answer, w))) / len(kws) END AS keyword_ratio,
  CASE WHEN len(ctx) = 0 AND len(tools) > 0 THEN NOT contains(answer, '未找到') END AS answered_empty_handed FROM runs),
good AS (SELECT * FROM judged WHERE error IS NULL)"""
)


def judge_scores(spark: SparkSession, d: str, judge: str) -> DataFrame:
    """Two judges over labelled documents; each leaves out some cells, fails on some, skips some."""
    rows = load(spark, d, "labels").join(load(spark, d, "documents"), "doc_id")
    n, i = F.col("n_chars"), F.col("doc_id")
    if judge == "a":
        value, missing, failed = (n % 11) / 8, n % 13 == 0, n % 17 == 0
        metrics = ["faithfulness", "context_recall", "only_a"]
    else:
        value, missing, failed = (n % 11 + i % 3) / 8, i % 13 == 0, i % 17 == 0
        metrics = ["faithfulness", "context_recall"]
    cells = rows.select(
        F.col("source").alias("combo"),
        i.cast("string").alias("user_input"),
        "n_chars",
        "doc_id",
        F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"),
    )
    shift = F.when(F.col("metric") == "faithfulness", 0.0).otherwise(0.25)
    return cells.where(~((F.col("metric") == "context_recall") & missing)).select(
        "combo",
        "user_input",
        "metric",
        F.when(~failed, value + shift).alias("value"),
        F.when(failed, F.concat(F.when(n % 2 == 0, "Timeout").otherwise("ValueError"), F.lit(": reply "), i)).alias("error"),
    )


def _scores_sql(name: str, value: str, missing: str, failed: str, metrics: str) -> str:
    return f"""{name} AS (SELECT source AS combo, CAST(doc_id AS VARCHAR) AS user_input, metric,
    CASE WHEN NOT ({failed}) THEN {value} + CASE WHEN metric = 'faithfulness' THEN 0 ELSE 0.25 END END AS value,
    CASE WHEN {failed} THEN CASE WHEN n_chars % 2 = 0 THEN 'Timeout' ELSE 'ValueError' END || ': reply ' || doc_id END AS error
  FROM (SELECT d.*, unnest({metrics}) AS metric FROM labels l JOIN documents d USING (doc_id))
  WHERE NOT (metric = 'context_recall' AND {missing}))"""


SCORES_SQL = (
    _scores_sql("ja", "(n_chars % 11) / 8", "n_chars % 13 = 0", "n_chars % 17 = 0", "['faithfulness', 'context_recall', 'only_a']")
    + ", "
    + _scores_sql("jb", "(n_chars % 11 + doc_id % 3) / 8", "doc_id % 13 = 0", "doc_id % 17 = 0", "['faithfulness', 'context_recall']")
    + """,
shared AS (SELECT combo, user_input FROM ja INTERSECT SELECT combo, user_input FROM jb),
pr AS (SELECT coalesce(a.combo, b.combo) AS combo, coalesce(a.user_input, b.user_input) AS user_input, coalesce(a.metric, b.metric) AS metric, a.value AS a, b.value AS b
  FROM ja a FULL JOIN jb b ON a.combo = b.combo AND a.user_input = b.user_input AND a.metric = b.metric),
pairs AS (SELECT pr.* FROM pr JOIN shared s ON s.combo = pr.combo AND s.user_input = pr.user_input)"""
)


def labelled_documents(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "labels").join(load(spark, d, "documents"), "doc_id").select(
        "doc_id", "lang", "n_chars", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")
    )


LABELLED_SQL = "ld AS (SELECT doc_id, lang, n_chars, quality = 1 AS good, toxic = 1 AS toxic FROM labels JOIN documents USING (doc_id))"


def decision_records(spark: SparkSession, d: str) -> DataFrame:
    """Events as gate decisions with times and tokens."""
    k, kind = F.col("k"), F.col("event_type")
    return interactions(spark, d).select(
        kind.alias("type"),
        kind.isin("view", "click", "error").alias("answerable"),
        (k / 100).alias("decision_p"),
        ((kind == "signup") | (k < 10)).alias("model_refused"),
        F.when(k >= 5, k >= 40).alias("model_judge"),
        (F.col("latency_ms") / 1000).alias("retrieve_s"),
        (k * 2).alias("decision_ms"),
        (F.col("latency_ms") / 500).alias("gen_s"),
        (k + 10).alias("prompt_tokens"),
        k.alias("completion_tokens"),
        (k % 3 == 0).alias("agent_correct"),
        (k % 2 == 0).alias("decision_correct"),
        (F.col("latency_ms") / 100).alias("agent_total_s"),
        F.when(k >= 5, k % 4).alias("agent_model_calls"),
        (k % 2).alias("agent_tool_calls"),
        F.when(kind == "error", "x").alias("agent_error"),
        F.when(k >= 3, k / 100).alias("confidence"),
        (k % 3 == 0).alias("correct"),
    )


RECORDS_SQL = (
    EVENTS_SQL
    + """,
rec AS (SELECT event_type AS type, event_type IN ('view', 'click', 'error') AS answerable, k / 100 AS p, event_type = 'signup' OR k < 10 AS refused,
  CASE WHEN k >= 5 THEN k >= 40 END AS judge, latency_ms / 1000 AS retrieve_s, k * 2 AS decision_ms, latency_ms / 500 AS gen_s, 2 * k + 10 AS tokens, k, latency_ms FROM interactions)"""
)


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(*keys, *[F.round(c, 4).alias(c) if c in doubles else F.col(c) for c in df.columns if c not in keys])


# ---------------------------------------------------------------- queries


def validate_questions(spark: SparkSession, d: str) -> DataFrame:
    return V.validate_questions(question_set(spark, d), corpus(spark, d))


def question_types(spark: SparkSession, d: str) -> DataFrame:
    return V.question_types(question_set(spark, d))


def make_negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = V.make_negatives(question_set(spark, d), "question_id")
    return rows.select(
        "question_id",
        F.get("history", 0)["content"].alias("previous_question"),
        F.get("history", 1)["content"].alias("previous_answer"),
        "label",
    )


def judge_routing(spark: SparkSession, d: str) -> DataFrame:
    return V.judge_routing(tool_runs(spark, d)).select(
        "question_id", "tool_ok", "source_ok", F.round("keyword_ratio", 4).alias("keyword_ratio"), "answered_empty_handed"
    )


def routing_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.routing_summary(V.judge_routing(tool_runs(spark, d))), [])


def routing_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.routing_by_type(V.judge_routing(tool_runs(spark, d))), ["type"])


def cost_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.cost_summary(tool_runs(spark, d)), [])


def cost_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.cost_by_type(tool_runs(spark, d)), ["type"])


def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    judged = V.judge_routing(tool_runs(spark, d))
    rows = V.compare_runs(V.routing_summary(judged), V.routing_summary(judged.where("k >= 50")))
    return _rounded(rows, ["metric"])


def _digest(texts: str) -> Column:
    """One digest for a list of texts, NULL for none."""
    return F.md5(F.array_join(texts, "\n").cast("binary"))


def export_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every sample, its texts as digests."""
    return V.export_samples(tool_runs(spark, d)).select(
        "combo",
        F.md5(F.col("user_input").cast("binary")).alias("asked"),
        F.md5(F.col("response").cast("binary")).alias("answered"),
        _digest("retrieved_contexts").alias("contexts"),
        F.array_join("citations", "|").alias("citations"),
        F.md5(F.col("reference").cast("binary")).alias("reference"),
    )


def score_plan(spark: SparkSession, d: str) -> DataFrame:
    """Every cell with what its metric may see, as digests."""
    plan = V.score_plan(V.export_samples(tool_runs(spark, d)))
    return plan.select(
        "combo",
        F.md5(F.col("user_input").cast("binary")).alias("asked"),
        "metric",
        "skipped",
        F.md5(F.col("response").cast("binary")).alias("answered"),
        _digest("retrieved_contexts").alias("contexts"),
        F.md5(F.col("reference").cast("binary")).alias("reference"),
    )


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.score_summary(judge_scores(spark, d, "a")), ["combo", "metric"])


def failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    return V.failure_reasons(judge_scores(spark, d, "a"))


def judge_overlap(spark: SparkSession, d: str) -> DataFrame:
    return V.judge_overlap(judge_scores(spark, d, "a"), judge_scores(spark, d, "b"))


def compare_judges(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.compare_judges(judge_scores(spark, d, "a"), judge_scores(spark, d, "b")), ["metric"])


def spearman(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_documents(spark, d).withColumn("rest", F.col("n_chars") % 97)
    return _rounded(V.spearman(rows, "n_chars", "rest", ["lang"]), ["lang"])


def top_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.top_disagreements(judge_scores(spark, d, "a"), judge_scores(spark, d, "b"), 15), ["metric"])


def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_documents(spark, d).withColumn("pred", F.col("n_chars") >= 1000)
    return _rounded(V.binary_metrics(rows, "good", "pred", ["lang"]), ["lang"])


def refusal_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_documents(spark, d).withColumn("pred", F.col("n_chars") >= 500)
    return _rounded(V.refusal_rates(V.binary_metrics(rows, "good", "pred")), [])


def auroc(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.auroc(labelled_documents(spark, d), "n_chars", "good"), [])


def auroc_by_language(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.auroc(labelled_documents(spark, d), "n_chars", "toxic", ["lang"]), ["lang"])


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_documents(spark, d).withColumn("score", F.when(~F.col("toxic"), F.col("n_chars").cast("double")))
    return _rounded(V.threshold_sweep(rows, "score", "good", [200, 800, 3000]), ["gate"])


def label_by_retrieval(spark: SparkSession, d: str) -> DataFrame:
    hits, asked = _judged_ablation(spark, d)
    kinds = question_set(spark, d).select(F.col("question_id").alias("query_id"), "type")
    return V.label_by_retrieval(asked.join(kinds, "query_id"), hits.where("combo = 'hybrid+rerank'"))


def choice_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.choice_accuracy(decision_records(spark, d)), ["threshold"])


def choice_accuracy_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.choice_accuracy_by_type(decision_records(spark, d)), ["type"])


def strategy_comparison(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.strategy_comparison(decision_records(spark, d)), ["strategy"])


def strategy_costs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.strategy_costs(decision_records(spark, d)), ["scheme"])


def tool_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(V.tool_run_summary(decision_records(spark, d)), ["type"])


def parse_judge_json(spark: SparkSession, d: str) -> DataFrame:
    """Judge replies around the event properties; error events were cut off in mid-object."""
    reply = F.when(F.col("event_type") == "error", F.concat(F.lit("so {"), F.substring("props", 2, 4))).otherwise(
        F.concat(F.lit('I say "{" first: {"why": "a } b", "in": '), "props", F.lit("} and {} after"))
    )
    rows = load(spark, d, "events").select("event_id", reply.alias("reply"))
    parsed = V.parse_judge_json(rows, "reply", "why string, in struct<k:long>")
    return parsed.select("event_id", "json", F.col("parsed.why").alias("why"), F.col("parsed.in.k").alias("k"), "failed")


def judge_cost(spark: SparkSession, d: str) -> DataFrame:
    calls = interactions(spark, d).select(
        F.col("model").alias("judge"), (F.col("status") == "ok").alias("ok"), F.col("latency_ms").alias("ms"), "prompt_tokens", "completion_tokens"
    )
    return _rounded(V.judge_cost(calls), ["judge"])


# ---------------------------------------------------------------- SQL twins


def metrics_sql(label: str, pred: str) -> str:
    """Counts of a confusion table as a select list."""
    return f"""count(*) FILTER ({label} AND {pred}) AS tp, count(*) FILTER (NOT {label} AND {pred}) AS fp,
      count(*) FILTER ({label} AND NOT {pred}) AS fn, count(*) FILTER (NOT {label} AND NOT {pred}) AS tn"""


RATES = """round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 4) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 4) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1"""
REFUSALS = """round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END, 4) AS refusal_recall, round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) END, 4) AS false_refusal,
  round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 4) AS false_trigger"""


def auroc_sql(label: str, key: str) -> str:
    """Pair counting over distinct scores."""
    return f"""WITH {LABELLED_SQL}, s AS (SELECT {key} AS g, n_chars, count(*) FILTER ({label}) AS p, count(*) FILTER (NOT {label}) AS n FROM ld GROUP BY ALL),
      c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
      SELECT g AS lang, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives,
        round(CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN CAST(sum(p * (below + n / 2)) AS DOUBLE) / (sum(p) * sum(n)) END, 4) AS auroc FROM c GROUP BY g"""


def spearman_sql(source: str, x: str, y: str, key: str) -> str:
    return f"""r AS (SELECT {key}, rank() OVER (PARTITION BY {key} ORDER BY {x}) + (count(*) OVER (PARTITION BY {key}, {x}) - 1) / 2 AS rx,
        rank() OVER (PARTITION BY {key} ORDER BY {y}) + (count(*) OVER (PARTITION BY {key}, {y}) - 1) / 2 AS ry FROM {source}),
      rho AS (SELECT {key}, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM r GROUP BY {key})"""


def nearest_sql(p: float) -> str:
    return f"max(v) FILTER (i = least(n - 1, CAST(floor(n * CAST({p} AS DOUBLE)) AS BIGINT)))"


_SUMMARY = """count(*) FILTER (error IS NULL) AS n, count(*) FILTER (error IS NOT NULL) AS failed,
  count(*) FILTER (error IS NULL AND tool_ok) AS tool_ok_pass, count(tool_ok) FILTER (error IS NULL) AS tool_ok_total,
  count(*) FILTER (error IS NULL AND source_ok) AS source_ok_pass, count(source_ok) FILTER (error IS NULL) AS source_ok_total,
  count(*) FILTER (error IS NULL AND answered_empty_handed) AS answered_empty_handed_pass,
  count(answered_empty_handed) FILTER (error IS NULL) AS answered_empty_handed_total,
  round(avg(keyword_ratio) FILTER (error IS NULL), 4) AS keyword_coverage,
  round(avg(CAST(len(tools) = 0 AS INTEGER)) FILTER (error IS NULL), 4) AS no_retrieval_ratio,
  round(avg(len(tools) + 1) FILTER (error IS NULL), 4) AS avg_model_calls, round(avg(len(ctx)) FILTER (error IS NULL), 4) AS avg_contexts,
  count(*) FILTER (error IS NULL AND len(ctx) = 0) AS zero_context_runs, CAST(coalesce(sum(tool_failures) FILTER (error IS NULL), 0) AS BIGINT) AS tool_failures"""

#: The same without rounding.
_EXACT_SUMMARY = _SUMMARY.replace("round(", "(").replace(", 4)", ")")

QUERIES = {
    f.__name__: f
    for f in (
        validate_questions, question_types, make_negatives, judge_routing, routing_summary, routing_by_type, cost_summary,
        cost_by_type, compare_runs, export_samples, score_plan, score_summary, failure_reasons, judge_overlap,
        compare_judges, spearman, top_disagreements, binary_metrics, refusal_rates, auroc, auroc_by_language,
        threshold_sweep, label_by_retrieval, choice_accuracy, choice_accuracy_by_type, strategy_comparison,
        strategy_costs, tool_run_summary, parse_judge_json, judge_cost,
    )
}

ORACLES = {
    "validate_questions": f"""WITH {CORPUS_SQL}, {QUESTION_SQL}, a AS (SELECT * FROM qs WHERE coalesce(type, '') <> 'unanswerable')
      SELECT question_id, 'unanswerable_with_truth' AS problem, NULL::VARCHAR AS detail FROM qs WHERE type = 'unanswerable'
      UNION ALL SELECT question_id, 'missing_truth', NULL FROM a WHERE ground_truth IS NULL
      UNION ALL SELECT question_id, 'keyword_not_in_corpus', w FROM (SELECT question_id, unnest(kws) AS w FROM a)
        WHERE w <> '' AND NOT EXISTS (SELECT 1 FROM corpus WHERE contains(content, w))
      UNION ALL SELECT question_id, 'unknown_source', s FROM (SELECT question_id, unnest(srcs) AS s FROM a) WHERE s NOT IN (SELECT source FROM corpus)""",
    "question_types": f"WITH {QUESTION_SQL} SELECT coalesce(type, 'untyped') AS type, count(*) AS questions FROM qs GROUP BY ALL",
    "make_negatives": f"""WITH {QUESTION_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY question_id) AS i, count(*) OVER () AS n FROM qs)
      SELECT o.question_id, p.question AS previous_question, coalesce(p.ground_truth, '文档中未找到相关内容。') AS previous_answer, false AS label
      FROM o JOIN o p ON p.i % p.n + 1 = o.i""",
    "judge_routing": f"WITH {RUNS_SQL} SELECT question_id, tool_ok, source_ok, round(keyword_ratio, 4) AS keyword_ratio, answered_empty_handed FROM judged",
    "routing_summary": f"WITH {RUNS_SQL} SELECT {_SUMMARY} FROM judged",
    "routing_by_type": f"WITH {RUNS_SQL} SELECT type, count(*) AS n, round(avg(CAST(tool_ok AS INTEGER)), 4) AS tool_accuracy FROM good GROUP BY type",
    "cost_summary": f"""WITH {RUNS_SQL} SELECT count(*) AS n, count(expected_tool) AS tool_choice_judged,
        count(*) FILTER (list_contains(tools, expected_tool)) AS tool_choice_correct, round(avg(len(tools) + 1), 4) AS avg_model_calls,
        max(len(tools) + 1) AS max_model_calls, round(avg(len(tools)), 4) AS avg_tool_calls, CAST(sum(tool_failures) AS BIGINT) AS tool_failures,
        round(avg(CAST(len(tools) = 0 AS INTEGER)), 4) AS no_retrieval_ratio, (SELECT count(error) FROM judged) AS failed,
        round(median(total_s), 4) AS median_total_s, round(max(total_s), 4) AS max_total_s,
        round(median(first_token_s), 4) AS median_first_token_s, round(max(first_token_s), 4) AS max_first_token_s FROM good""",
    "cost_by_type": f"""WITH {RUNS_SQL} SELECT type, count(*) AS n, round(avg(len(tools) + 1), 4) AS avg_model_calls, round(median(total_s), 4) AS median_total_s,
        round(max(total_s), 4) AS max_total_s FROM good GROUP BY type""",
    "compare_runs": f"""WITH {RUNS_SQL}, s AS (SELECT false AS old, {_EXACT_SUMMARY} FROM judged UNION ALL SELECT true, {_EXACT_SUMMARY} FROM judged WHERE k >= 50),
      d AS (SELECT old, COLUMNS(* EXCLUDE old)::DOUBLE FROM s),
      u AS (FROM d UNPIVOT INCLUDE NULLS (v FOR metric IN (COLUMNS(* EXCLUDE (old)))))
      SELECT metric, round(max(v) FILTER (NOT old), 4) AS value, round(max(v) FILTER (old), 4) AS baseline,
        round(max(v) FILTER (NOT old) - max(v) FILTER (old), 4) AS delta FROM u GROUP BY metric""",
    "export_samples": f"""WITH {RUNS_SQL} SELECT 'agent' AS combo, md5(question) AS asked, md5(answer) AS answered, md5(CASE WHEN len(ctx) > 0 THEN 'text ' || k ELSE '' END) AS contexts,
        coalesce(array_to_string([x || ' › （无标题正文）' FOR x IN ctx], '|'), '') AS citations, md5(nullif(ground_truth, '')) AS reference FROM good""",
    "score_plan": f"""WITH {RUNS_SQL}, m AS (SELECT unnest(['context_precision', 'context_recall', 'faithfulness', 'answer_relevancy']) AS metric,
        unnest([true, true, false, false]) AS ref, unnest([false, false, true, true]) AS ans, unnest([true, true, true, false]) AS ctxs)
      SELECT 'agent' AS combo, md5(question) AS asked, metric, CASE WHEN ref AND ground_truth IS NULL THEN '缺少 ground_truth' END AS skipped,
        CASE WHEN ans THEN md5(answer) END AS answered, CASE WHEN ctxs THEN md5(CASE WHEN len(ctx) > 0 THEN 'text ' || k ELSE '' END) END AS contexts,
        CASE WHEN ref THEN md5(ground_truth) END AS reference FROM good, m""",
    "score_summary": f"WITH {SCORES_SQL} SELECT combo, metric, round(avg(value), 4) AS mean, count(value) AS valid, count(*) AS rows FROM ja GROUP BY ALL",
    "failure_reasons": f"WITH {SCORES_SQL} SELECT split_part(error, ':', 1) AS reason, count(*) AS cells FROM ja WHERE error IS NOT NULL GROUP BY ALL",
    "judge_overlap": f"""WITH {SCORES_SQL}, a AS (SELECT DISTINCT combo, user_input FROM ja), b AS (SELECT DISTINCT combo, user_input FROM jb)
      SELECT (SELECT count(*) FROM shared) AS paired, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_a, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_b""",
    "compare_judges": f"""WITH {SCORES_SQL}, v AS (SELECT * FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL), {spearman_sql('v', 'a', 'b', 'metric')}
      SELECT p.metric, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n, round(avg(a) FILTER (b IS NOT NULL), 4) AS mean_a, round(avg(b) FILTER (a IS NOT NULL), 4) AS mean_b,
        round(avg(b - a), 4) AS mean_diff, round(avg(abs(b - a)), 4) AS mean_abs_diff, round(any_value(rho.rho), 4) AS rho
      FROM pairs p LEFT JOIN rho ON rho.metric = p.metric GROUP BY p.metric""",
    "spearman": f"""WITH {LABELLED_SQL}, s AS (SELECT *, n_chars % 97 AS rest FROM ld), {spearman_sql('s', 'n_chars', 'rest', 'lang')}
      SELECT lang, n, round(rho, 4) AS rho FROM rho""",
    "top_disagreements": f"""WITH {SCORES_SQL} SELECT metric, combo, user_input, round(a, 4) AS a, round(b, 4) AS b, round(abs(b - a), 4) AS diff FROM pairs
      WHERE abs(b - a) > 0 ORDER BY abs(b - a) DESC, metric DESC, combo DESC, user_input DESC LIMIT 15""",
    "binary_metrics": f"WITH {LABELLED_SQL}, c AS (SELECT lang, {metrics_sql('good', '(n_chars >= 1000)')} FROM ld GROUP BY lang) SELECT lang, tp, fp, fn, tn, {RATES} FROM c",
    "refusal_rates": f"WITH {LABELLED_SQL}, c AS (SELECT {metrics_sql('good', '(n_chars >= 500)')} FROM ld) SELECT tp, fp, fn, tn, {RATES}, {REFUSALS} FROM c",
    "auroc": "SELECT * EXCLUDE (lang) FROM (" + auroc_sql("good", "1") + ")",
    "auroc_by_language": auroc_sql("toxic", "lang"),
    "threshold_sweep": f"""WITH {LABELLED_SQL}, t AS (SELECT unnest(['no_gate', '>=200', '>=800', '>=3000']) AS gate, unnest([NULL, 200.0, 800.0, 3000.0])::DOUBLE AS threshold),
      s AS (SELECT good, CASE WHEN toxic THEN -99 ELSE n_chars END AS score FROM ld),
      c AS (SELECT gate, threshold, {metrics_sql('good', '(threshold IS NULL OR score >= threshold)')} FROM s, t GROUP BY ALL)
      SELECT gate, threshold, tp, fp, fn, tn, {RATES} FROM c""",
    "label_by_retrieval": f"""WITH {LEGS_SQL}, {QUESTION_SQL} SELECT query_id, coalesce(type, '') <> 'unanswerable' AS answerable,
        coalesce(type, '') <> 'unanswerable' AND hit AS answer_in_passages FROM scored JOIN qs ON question_id = query_id WHERE combo = 'hybrid+rerank'""",
    "choice_accuracy": f"""WITH {RECORDS_SQL}, t AS (SELECT unnest([0.0, 0.3, 0.5, 0.7])::DOUBLE AS threshold), r AS (SELECT CASE WHEN k >= 3 THEN p ELSE 0 END AS c, k % 3 = 0 AS correct FROM rec)
      SELECT threshold, round(count(*) FILTER (c >= threshold) / count(*), 4) AS coverage,
        round(count(*) FILTER (c >= threshold AND correct) / count(*) FILTER (c >= threshold), 4) AS accuracy FROM r, t GROUP BY threshold""",
    "choice_accuracy_by_type": f"WITH {RECORDS_SQL} SELECT type, count(*) AS n, round(avg(CAST(k % 3 = 0 AS INTEGER)), 4) AS accuracy FROM rec GROUP BY type",
    "strategy_comparison": f"""WITH {RECORDS_SQL}, c AS (
        SELECT 'answer_directly' AS strategy, {metrics_sql('answerable', '(NOT refused)')} FROM rec
        UNION ALL SELECT 'model_judge', {metrics_sql('answerable', '(coalesce(judge, true))')} FROM rec
        UNION ALL SELECT 'decision_gate', {metrics_sql('answerable', '(p >= 0.3)')} FROM rec
        UNION ALL SELECT 'decision_gate_and_refusal', {metrics_sql('answerable', '(p >= 0.3 AND NOT refused)')} FROM rec)
      SELECT strategy, tp, fp, fn, tn, {RATES}, {REFUSALS} FROM c""",
    "strategy_costs": f"""WITH {RECORDS_SQL}, s AS (SELECT 'answer_directly' AS scheme, answerable, retrieve_s + gen_s AS v, 1 AS call, tokens FROM rec
        UNION ALL SELECT 'decision_gate', answerable, retrieve_s + decision_ms / 1000 + CASE WHEN p >= 0.3 THEN gen_s ELSE 0 END,
          CASE WHEN p >= 0.3 THEN 1 ELSE 0 END, CASE WHEN p >= 0.3 THEN tokens ELSE 0 END FROM rec),
      o AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY scheme) AS n FROM s)
      SELECT scheme, CAST(sum(call) AS BIGINT) AS model_calls, CAST(sum(tokens) AS BIGINT) AS model_tokens,
        round(avg(v) FILTER (NOT answerable), 4) AS unanswerable_mean_s, round(median(v), 4) AS p50_s, round({nearest_sql(0.95)}, 4) AS p95_s FROM o GROUP BY scheme""",
    "tool_run_summary": f"""WITH {RECORDS_SQL} SELECT type, count(*) AS n, round(avg(CAST(k % 3 = 0 AS INTEGER)), 4) AS agent_accuracy,
        round(avg(CAST(k % 2 = 0 AS INTEGER)), 4) AS decision_accuracy, round(avg(latency_ms / 100), 4) AS agent_total_s_mean,
        round(avg(CASE WHEN k >= 5 THEN k % 4 END), 4) AS agent_model_calls_mean, round(avg(k % 2), 4) AS agent_tool_calls_mean,
        count(*) FILTER (type = 'error') AS agent_errors FROM rec GROUP BY GROUPING SETS ((type), ())""",
    "parse_judge_json": f"""WITH {EVENTS_SQL} SELECT event_id, CASE WHEN event_type <> 'error' THEN '{{"why": "a }} b", "in": ' || props || '}}' END AS json,
        CASE WHEN event_type <> 'error' THEN 'a }} b' END AS why, CASE WHEN event_type <> 'error' THEN k END AS k, event_type = 'error' AS failed FROM ev""",
    "judge_cost": f"""WITH {EVENTS_SQL}, g AS (SELECT model, latency_ms AS v, row_number() OVER (PARTITION BY model ORDER BY latency_ms) - 1 AS i,
          count(*) OVER (PARTITION BY model) AS n FROM interactions WHERE status = 'ok'),
        q AS (SELECT model, {nearest_sql(0.5)} AS p50, {nearest_sql(0.95)} AS p95, max(v) AS mx FROM g GROUP BY model)
      SELECT model AS judge, count(*) AS calls, count(*) FILTER (status <> 'ok') AS failed,
        CAST(coalesce(sum(prompt_tokens) FILTER (status = 'ok'), 0) AS BIGINT) AS prompt_tokens,
        CAST(coalesce(sum(completion_tokens) FILTER (status = 'ok'), 0) AS BIGINT) AS completion_tokens,
        round(any_value(p50), 4) AS ms_p50, round(any_value(p95), 4) AS ms_p95, round(any_value(mx), 4) AS ms_max
      FROM interactions JOIN q USING (model) GROUP BY model""",
}
