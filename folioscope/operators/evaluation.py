"""Offline evaluation: retrieval, routing, judges, decision gates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.literals import match_literals
from folioscope.functions.order import row_positions, value_positions
from folioscope.functions.text import contains_any

# Answers with one of these say that nothing was found.
REFUSAL_MARKERS = ["没有相关", "未找到", "找不到", "知识库中没有", "没有提到", "无法回答", "没有查到", "不包含"]
# The metrics with what they need (reference text, generated answer, contexts).
METRICS = [
    ("context_precision", True, False, True),
    ("context_recall", True, False, True),
    ("faithfulness", False, True, True),
    ("answer_relevancy", False, True, False),
]
SKIPPED_NO_REFERENCE = "缺少 ground_truth"
SKIPPED_NO_ANSWER = "未生成答案"
UNTYPED = "untyped"
UNANSWERABLE = "unanswerable"
MISSING_SCORE = -99.0


def _present(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")) != ""


def _ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _as_number(flag: Column) -> Column:
    return flag.cast("int").cast("double")


# ---------------------------------------------------------------- question sets


def validate_questions(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """Problem rows ``(question_id, problem, detail)`` of a question set against ``docs(source, content)``."""
    q = questions.withColumn("_kind", F.coalesce("type", F.lit(UNTYPED)))
    keywords = F.coalesce("expected_keywords", F.array().cast("array<string>"))
    labelled = _present("ground_truth") | (F.size(keywords) > 0)
    answerable = q.where(F.col("_kind") != UNANSWERABLE)
    none = F.lit(None).cast("string").alias("detail")
    surplus = q.where((F.col("_kind") == UNANSWERABLE) & labelled).select(
        "question_id", F.lit("unanswerable_with_truth").alias("problem"), none
    )
    untold = answerable.where(~_present("ground_truth")).select(
        "question_id", F.lit("missing_truth").alias("problem"), none
    )
    wanted = answerable.select("question_id", F.explode("expected_keywords").alias("pattern"))
    seen = match_literals(docs.select("content"), "content", wanted).select("pattern").distinct()
    unseen = wanted.join(seen, "pattern", "left_anti").where("pattern <> ''").select(
        "question_id", F.lit("keyword_not_in_corpus").alias("problem"), F.col("pattern").alias("detail")
    )
    listed = answerable.select("question_id", F.explode("expected_sources").alias("source"))
    lost = listed.join(docs.select("source"), "source", "left_anti").select(
        "question_id", F.lit("unknown_source").alias("problem"), F.col("source").alias("detail")
    )
    return surplus.unionByName(untold).unionByName(unseen).unionByName(lost)


def question_types(questions: DataFrame) -> DataFrame:
    """Questions per type."""
    return questions.groupBy(F.coalesce("type", F.lit(UNTYPED)).alias("type")).agg(F.count("*").alias("questions"))


def make_negatives(questions: DataFrame, order: str, fallback: str = "文档中未找到相关内容。") -> DataFrame:
    """Pair every question with the one before it as unrelated history; the first takes the last."""
    numbered = row_positions(questions, [F.col(order)])
    total = numbered.count()
    previous = numbered.select(
        (F.col("position") % total + 1).alias("position"),
        F.col("question").alias("_asked"),
        F.coalesce(F.nullif("ground_truth", F.lit("")), F.lit(fallback)).alias("_answer"),
    )

    def message(role: str, text: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))

    return (
        numbered.join(previous, "position")
        .withColumn("history", F.array(message("user", "_asked"), message("assistant", "_answer")))
        .withColumn("label", F.lit(False))
        .drop("position", "_asked", "_answer")
    )


# ---------------------------------------------------------------- retrieval quality


def _grid(questions: DataFrame, combos: list[str] | None) -> DataFrame:
    if combos is None:
        return questions
    return questions.withColumn("combo", F.explode(F.array(*[F.lit(c) for c in combos])))


def score_retrieval(hits: DataFrame, questions: DataFrame, combos: list[str] | None = None) -> DataFrame:
    """Relevant ranks, hit, reciprocal rank and precision over what was returned.

    A hit is relevant when it contains any expected keyword. Questions without keywords are not
    judged (NULL). With ``combos`` every question counts under every setting, hits or not.
    """
    keys = ["query_id"] if combos is None else ["combo", "query_id"]
    judged = F.size(F.coalesce("expected_keywords", F.array().cast("array<string>"))) > 0
    good = F.exists("expected_keywords", lambda k: F.contains(F.col("content"), k))
    per_question = (
        hits.join(questions.select("query_id", "expected_keywords"), "query_id")
        .select(*keys, "rank", good.alias("_good"))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("returned"),
            F.array_sort(F.collect_list(F.when(F.col("_good"), F.col("rank")))).alias("relevant_ranks"),
        )
    )
    returned = F.coalesce("returned", F.lit(0))
    ranks = F.coalesce("relevant_ranks", F.array().cast("array<int>"))
    first = F.try_element_at(ranks, F.lit(1))
    return (
        _grid(questions.select("query_id", judged.alias("_judged")), combos)
        .join(per_question, keys, "left")
        .select(
            *keys,
            returned.alias("returned"),
            F.when(F.col("_judged"), ranks).alias("relevant_ranks"),
            F.when(F.col("_judged"), F.size(ranks) > 0).alias("hit"),
            F.when(F.col("_judged"), F.coalesce(1.0 / first, F.lit(0.0))).alias("reciprocal_rank"),
            F.when(
                F.col("_judged"), F.when(returned > 0, F.size(ranks) / returned).otherwise(F.lit(0.0))
            ).alias("precision_at_k"),
        )
    )


def source_hit(hits: DataFrame, questions: DataFrame, combos: list[str] | None = None) -> DataFrame:
    """Whether any returned source is an expected one; questions without expectations are left out."""
    keys = ["query_id"] if combos is None else ["combo", "query_id"]
    wanted = questions.where(F.size("expected_sources") > 0).select("query_id", "expected_sources")
    found = hits.groupBy(*keys).agg(F.collect_set("source").alias("_sources"))
    overlap = F.arrays_overlap("_sources", "expected_sources")
    return _grid(wanted, combos).join(found, keys, "left").select(
        *keys, F.coalesce(overlap, F.lit(False)).alias("source_hit")
    )


def sweep_summary(scored: DataFrame, base: str = "baseline") -> DataFrame:
    """Per setting: questions, contexts, hit rate, MRR, precision, first-place rate, change against ``base``."""
    top1 = F.when(F.col("hit").isNotNull(), _as_number(F.coalesce(F.get("relevant_ranks", 0), F.lit(0)) == 1))
    table = scored.groupBy("combo").agg(
        F.count("*").alias("questions"),
        F.avg("returned").alias("avg_contexts"),
        F.avg(_as_number(F.col("hit"))).alias("hit_rate"),
        F.avg("reciprocal_rank").alias("mrr"),
        F.avg("precision_at_k").alias("precision_at_k"),
        F.avg(top1).alias("top1_rate"),
    )
    everything = Window.partitionBy(F.lit(1))  # one row per setting
    reference = F.nullif(F.max(F.when(F.col("combo") == base, F.col("mrr"))).over(everything), F.lit(0.0))
    other = F.col("combo") != base
    return (
        table.withColumn("_base", reference)
        .withColumn("mrr_delta", F.when(other, F.col("mrr") - F.col("_base")))
        .withColumn("mrr_delta_pct", F.when(other, (F.col("mrr") - F.col("_base")) / F.col("_base") * 100))
        .drop("_base")
    )


# ---------------------------------------------------------------- routing


def judge_routing(runs: DataFrame) -> DataFrame:
    """Add the verdicts of a run; NULL means that the run is not judged on that point.

    An absent ``expected_tool`` is not judged, a NULL one claims that no tool is needed.
    """
    tools = F.coalesce("tools_called", F.array().cast("array<string>"))
    keywords = F.coalesce("expected_keywords", F.array().cast("array<string>"))
    sources = F.coalesce("expected_sources", F.array().cast("array<string>"))
    found = F.size(F.filter(keywords, lambda k: F.contains(F.col("answer"), k)))
    empty_handed = (F.size("contexts") == 0) & (F.size(tools) > 0)
    return runs.withColumns(
        {
            "tool_ok": F.when(
                F.col("has_expected_tool"),
                F.when(F.col("expected_tool").isNull(), F.size(tools) == 0).otherwise(
                    F.array_contains(tools, F.col("expected_tool"))
                ),
            ),
            "source_ok": F.when(
                F.size(sources) > 0, F.exists("contexts", lambda c: F.array_contains(sources, c["source"]))
            ),
            "keyword_ratio": F.when(F.size(keywords) > 0, found / F.size(keywords)),
            "answered_empty_handed": F.when(empty_handed, ~contains_any("answer", REFUSAL_MARKERS)),
        }
    )


def routing_summary(judged: DataFrame) -> DataFrame:
    """One row of totals over the runs without an error; failed runs are counted apart."""
    ok = F.coalesce("error", F.lit("")) == ""

    def passed(name: str) -> list[Column]:
        return [
            F.count_if(ok & F.col(name)).alias(f"{name}_pass"),
            F.count_if(ok & F.col(name).isNotNull()).alias(f"{name}_total"),
        ]

    def mean(value: Column) -> Column:
        return F.avg(F.when(ok, value.cast("double")))

    return judged.agg(
        F.count_if(ok).alias("n"),
        F.count_if(~ok).alias("failed"),
        *passed("tool_ok"),
        *passed("source_ok"),
        *passed("answered_empty_handed"),
        mean(F.col("keyword_ratio")).alias("keyword_coverage"),
        mean(_as_number(F.col("retrieval_skipped"))).alias("no_retrieval_ratio"),
        mean(F.coalesce("model_calls", F.lit(0))).alias("avg_model_calls"),
        mean(F.size("contexts")).alias("avg_contexts"),
        F.count_if(ok & (F.size("contexts") == 0)).alias("zero_context_runs"),
        F.sum(F.when(ok, F.coalesce("tool_failures", F.lit(0))).otherwise(0)).alias("tool_failures"),
    )


def routing_by_type(judged: DataFrame) -> DataFrame:
    """Runs and tool accuracy per question type."""
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit("(未分类)"))
    return (
        judged.where(F.coalesce("error", F.lit("")) == "")
        .groupBy(kind.alias("type"))
        .agg(F.count("*").alias("n"), F.avg(_as_number(F.col("tool_ok"))).alias("tool_accuracy"))
    )


def cost_summary(runs: DataFrame) -> DataFrame:
    """One row: time, calls and tool choice over the runs without an error.

    Here an absent and a NULL ``expected_tool`` are both left out of the tool choice.
    """
    ok = runs.where(F.coalesce("error", F.lit("")) == "")
    wanted = F.col("expected_tool").isNotNull()
    right = F.array_contains(F.coalesce("tools_called", F.array().cast("array<string>")), F.col("expected_tool"))
    totals = ok.agg(
        F.count("*").alias("n"),
        F.count_if(wanted).alias("tool_choice_judged"),
        F.count_if(wanted & right).alias("tool_choice_correct"),
        F.avg(F.coalesce("model_calls", F.lit(0)).cast("double")).alias("avg_model_calls"),
        F.max(F.coalesce("model_calls", F.lit(0))).cast("long").alias("max_model_calls"),
        F.avg(F.size("tools_called").cast("double")).alias("avg_tool_calls"),
        F.sum(F.coalesce("tool_failures", F.lit(0))).alias("tool_failures"),
        F.avg(_as_number(F.col("retrieval_skipped"))).alias("no_retrieval_ratio"),
        F.lit("all").alias("_key"),
    )
    failed = runs.agg(
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed"), F.lit("all").alias("_key")
    )

    def spread_of(value: str, name: str) -> DataFrame:
        return nearest_rank_quantiles(ok, value).select(
            F.col("median").alias(f"median_{name}"), F.col("max").alias(f"max_{name}"), F.lit("all").alias("_key")
        )

    return (
        totals.join(failed, "_key")
        .join(spread_of("total_s", "total_s"), "_key", "left")
        .join(spread_of("first_token_s", "first_token_s"), "_key", "left")
        .drop("_key")
    )


def cost_by_type(runs: DataFrame) -> DataFrame:
    """Runs, median and longest time, model calls per question type."""
    ok = runs.where(F.coalesce("error", F.lit("")) == "").withColumn(
        "type", F.coalesce(F.nullif("type", F.lit("")), F.lit("(未分类)"))
    )
    times = nearest_rank_quantiles(ok, "total_s", ["type"]).select(
        "type", F.col("median").alias("median_total_s"), F.col("max").alias("max_total_s")
    )
    calls = ok.groupBy("type").agg(
        F.count("*").alias("n"), F.avg(F.coalesce("model_calls", F.lit(0)).cast("double")).alias("avg_model_calls")
    )
    return calls.join(times, "type", "left")


def unpivot_metrics(summary: DataFrame) -> DataFrame:
    """A one-row summary as ``(metric, value)`` rows of doubles; text columns are skipped."""
    numeric = [f.name for f in summary.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in numeric])
    return summary.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")


def compare_runs(now: DataFrame, before: DataFrame) -> DataFrame:
    """Metric by metric: value, baseline, change."""
    old = unpivot_metrics(before).withColumnRenamed("value", "baseline")
    return (
        unpivot_metrics(now)
        .join(old, "metric", "left")
        .select("metric", "value", "baseline", (F.col("value") - F.col("baseline")).alias("delta"))
    )


def export_samples(runs: DataFrame, combo: str = "agent") -> DataFrame:
    """Runs without an error as samples for scoring; contexts become plain texts."""
    head = F.lit("（无标题正文）")
    return runs.where(F.coalesce("error", F.lit("")) == "").select(
        F.lit(combo).alias("combo"),
        F.col("question").alias("user_input"),
        F.col("answer").alias("response"),
        F.transform("contexts", lambda c: c["text"]).alias("retrieved_contexts"),
        F.transform(
            "contexts",
            lambda c: F.concat(
                F.coalesce(c["source"], F.lit("")),
                F.lit(" › "),
                F.coalesce(F.nullif(c["heading"], F.lit("")), head),
            ),
        ).alias("citations"),
        F.nullif("ground_truth", F.lit("")).alias("reference"),
    )


# ---------------------------------------------------------------- judge scores


def score_plan(samples: DataFrame, metrics: list[tuple[str, bool, bool, bool]] = METRICS) -> DataFrame:
    """Sample x metric cells with the reason a cell is skipped and the inputs it needs."""
    specs = F.array(
        *[
            F.struct(
                F.lit(n).alias("metric"), F.lit(r).alias("ref"), F.lit(a).alias("ans"), F.lit(c).alias("ctx")
            )
            for n, r, a, c in metrics
        ]
    )
    cells = samples.withColumn("_m", F.explode(specs))
    reason = F.when(F.col("_m.ref") & ~_present("reference"), SKIPPED_NO_REFERENCE).when(
        F.col("_m.ans") & ~_present("response"), SKIPPED_NO_ANSWER
    )
    return cells.select(
        "combo",
        "user_input",
        F.col("_m.metric").alias("metric"),
        reason.alias("skipped"),
        F.when(F.col("_m.ans"), F.col("response")).alias("response"),
        F.when(F.col("_m.ctx"), F.col("retrieved_contexts")).alias("retrieved_contexts"),
        F.when(F.col("_m.ref"), F.col("reference")).alias("reference"),
    )


def score_cells(plan: DataFrame, scorer) -> DataFrame:
    """Run a user scorer over the cells that are not skipped; a failure stays in its cell.

    ``scorer(dict) -> float`` is called once per cell inside Arrow batches.
    """

    @F.pandas_udf("value double, error string")
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        values, errors = [], []
        for cell in cells.to_dict("records"):
            value = error = None
            if cell["skipped"] is None:
                try:
                    value = float(scorer(cell))
                except Exception as exc:  # one bad reply must not lose the run
                    error = f"{type(exc).__name__}: {exc}"
            values.append(value)
            errors.append(error)
        return pd.DataFrame({"value": pd.Series(values, dtype="float64"), "error": pd.Series(errors, dtype="object")})

    columns = ["metric", "skipped", "user_input", "response", "retrieved_contexts", "reference"]
    return plan.withColumn("_s", run(F.struct(*columns))).select(
        "combo", "user_input", "metric", "skipped", F.col("_s.value").alias("value"), F.col("_s.error").alias("error")
    )


def score_summary(scores: DataFrame) -> DataFrame:
    """Mean and valid cells per setting and metric, next to the number of rows."""
    return scores.groupBy("combo", "metric").agg(
        F.avg("value").alias("mean"), F.count("value").alias("valid"), F.count("*").alias("rows")
    )


def failure_reasons(scores: DataFrame) -> DataFrame:
    """Failed cells per error name, the text before the first colon."""
    return (
        scores.where(F.coalesce("error", F.lit("")) != "")
        .groupBy(F.substring_index("error", ":", 1).alias("reason"))
        .agg(F.count("*").alias("cells"))
    )


def judge_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many samples both judges scored and how many only one did."""
    key = ["combo", "user_input"]
    both = (
        left.select(*key).distinct().withColumn("_a", F.lit(1))
        .join(right.select(*key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    )
    return both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("paired"),
        F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNull()).alias("only_b"),
    )


def judge_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(combo, user_input, metric, a, b)`` over the samples both judges hold; a side may be NULL."""
    key = ["combo", "user_input"]
    shared = left.select(*key).intersect(right.select(*key))
    a = left.select(*key, "metric", F.col("value").alias("a"))
    b = right.select(*key, "metric", F.col("value").alias("b"))
    return a.join(b, [*key, "metric"], "full_outer").join(shared, key, "left_semi")


def compare_judges(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per metric: valid pairs, means, mean difference, mean absolute difference, rank correlation."""
    pairs = judge_pairs(left, right)
    valid = F.col("a").isNotNull() & F.col("b").isNotNull()
    table = pairs.groupBy("metric").agg(
        F.count_if(valid).alias("n"),
        F.avg(F.when(valid, F.col("a"))).alias("mean_a"),
        F.avg(F.when(valid, F.col("b"))).alias("mean_b"),
        F.avg(F.col("b") - F.col("a")).alias("mean_diff"),
        F.avg(F.abs(F.col("b") - F.col("a"))).alias("mean_abs_diff"),
    )
    rho = spearman(pairs.where(valid), "a", "b", ["metric"]).select("metric", "rho")
    return table.join(rho, "metric", "left")


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Rank correlation with average ranks for ties; NULL under three rows or for a constant side.

    Equal pairs are counted first and ranks are attached to distinct values, so no step works on
    all rows of a group at once.
    """
    keys = list(by or [])
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("_w"))

    def ranks(side: str, name: str) -> DataFrame:
        positions = value_positions(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), side, keys)
        return positions.select(
            *keys, side, (F.col("before") + (F.col("n") + 1) / 2 - (F.col("total") + 1) / 2).alias(name)
        )

    def attach(rows: DataFrame, side: str, name: str) -> DataFrame:
        other = ranks(side, name)
        match = F.col(f"l.{side}") == F.col(f"r.{side}")
        for key in keys:
            match = match & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
        return rows.alias("l").join(other.alias("r"), match).select("l.*", f"r.{name}")

    ranked = attach(attach(pairs, x, "_rx"), y, "_ry")
    w, rx, ry = F.col("_w"), F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy(*keys).agg(
        F.sum("_w").alias("n"),
        F.sum(w * rx * ry).alias("_xy"),
        F.sum(w * rx * rx).alias("_xx"),
        F.sum(w * ry * ry).alias("_yy"),
    )
    defined = (F.col("n") >= 3) & (F.col("_xx") > 0) & (F.col("_yy") > 0)
    return sums.select(
        *keys, "n", F.when(defined, F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))).alias("rho")
    )


def top_disagreements(left: DataFrame, right: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest non-zero differences between two judges."""
    rows = judge_pairs(left, right).withColumn("diff", F.abs(F.col("b") - F.col("a"))).where("diff > 0")
    return rows.orderBy(F.desc("diff"), F.desc("metric"), F.desc("combo"), F.desc("user_input")).limit(int(n))


_JSON_MARK = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|[{}]', re.S)


def _first_object(text: str | None) -> str | None:
    """The first balanced object of a text; braces inside quoted strings do not count."""
    depth, start = 0, -1
    for mark in _JSON_MARK.finditer(text or ""):
        if mark.group() == "{":
            depth += 1
            if depth == 1:
                start = mark.start()
        elif mark.group() == "}" and depth:
            depth -= 1
            if depth == 0:
                return text[start : mark.end()]
    return None


def parse_judge_json(replies: DataFrame, reply: str, schema: str) -> DataFrame:
    """Add ``json`` (first balanced object), ``parsed`` (by ``schema``) and ``failed``."""

    @F.pandas_udf(T.StringType())
    def extract(texts: pd.Series) -> pd.Series:
        return texts.map(_first_object)

    return (
        replies.withColumn("json", extract(reply))
        .withColumn("parsed", F.from_json("json", schema))
        .withColumn("failed", F.col("json").isNull())
    )


def judge_cost(calls: DataFrame) -> DataFrame:
    """Per judge: calls, failures, time quantiles over good calls, tokens."""
    good = calls.where("ok")
    counts = calls.groupBy("judge").agg(
        F.count("*").alias("calls"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("prompt_tokens"))), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("completion_tokens"))), F.lit(0)).alias("completion_tokens"),
    )
    times = nearest_rank_quantiles(good, "ms", ["judge"]).select(
        "judge", F.col("p50").alias("ms_p50"), F.col("p95").alias("ms_p95"), F.col("max").alias("ms_max")
    )
    return counts.join(times, "judge", "left")


# ---------------------------------------------------------------- decisions


def _counts(label: Column, pred: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if(label & pred),
        "fp": F.count_if(~label & pred),
        "fn": F.count_if(label & ~pred),
        "tn": F.count_if(~label & ~pred),
    }


def with_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and refusal rates from tp, fp, fn, tn; NULL when undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    both = (F.coalesce(precision, F.lit(0.0)) > 0) & (F.coalesce(recall, F.lit(0.0)) > 0)
    return counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
            "precision": precision,
            "recall": recall,
            "f1": F.when(both, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0)),
        }
    )


def binary_metrics(df: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and rates of a boolean prediction."""
    counts = _counts(F.col(label), F.col(pred))
    return with_rates(df.groupBy(*(by or [])).agg(*[c.alias(n) for n, c in counts.items()]))


def refusal_rates(metrics: DataFrame) -> DataFrame:
    """Refusal recall, false refusal and false trigger rates over the counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return metrics.withColumns(
        {
            "refusal_recall": _ratio(tn, tn + fp),
            "false_refusal": _ratio(fn, fn + tp),
            "false_trigger": _ratio(fp, fp + tn),
        }
    )


def auroc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Chance that a positive outranks a negative, ties half; NULL when a class is empty.

    From counts below each distinct score, so neither pairs nor all rows are ever gathered.
    """
    keys = list(by or [])
    flag = F.col(label).cast("boolean")
    places = value_positions(
        df, score, keys, {"pos": flag.cast("long"), "neg": (~flag).cast("long")}
    )
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    sums = places.groupBy(*keys).agg(won.alias("_won"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return sums.select(
        *keys,
        "positives",
        "negatives",
        _ratio(F.col("_won"), F.col("positives") * F.col("negatives")).alias("auroc"),
    )


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """Counts and rates at every threshold plus a row without a gate, in one pass.

    A missing score counts as -99.
    """
    value = F.coalesce(F.col(score), F.lit(MISSING_SCORE))
    flag = F.col(label).cast("boolean")
    gates = [("no_gate", None, F.lit(True))] + [(f">={t:g}", float(t), value >= t) for t in thresholds]
    aggregates = [
        F.struct(
            F.lit(name).alias("gate"),
            F.lit(t).cast("double").alias("threshold"),
            *[c.alias(n) for n, c in _counts(flag, pred).items()],
        ).alias(f"g{i}")
        for i, (name, t, pred) in enumerate(gates)
    ]
    one = df.agg(*aggregates)
    rows = one.select(F.explode(F.array(*[F.col(f"g{i}") for i in range(len(gates))])).alias("g")).select("g.*")
    return with_rates(rows)


def label_by_retrieval(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """``answerable``, and ``answer_in_passages``: answerable with a keyword in what was retrieved."""
    keywords = F.coalesce("expected_keywords", F.array().cast("array<string>"))
    found = (
        hits.join(questions.select("query_id", "expected_keywords"), "query_id")
        .where(F.exists("expected_keywords", lambda k: F.contains(F.col("content"), k)))
        .select("query_id")
        .distinct()
        .withColumn("_found", F.lit(True))
    )
    answerable = F.coalesce("type", F.lit("")) != UNANSWERABLE
    return questions.join(found, "query_id", "left").select(
        "query_id",
        answerable.alias("answerable"),
        (answerable & ((F.size(keywords) == 0) | F.coalesce("_found", F.lit(False)))).alias("answer_in_passages"),
    )


def choice_accuracy(choices: DataFrame, thresholds: list[float] = (0.0, 0.3, 0.5, 0.7)) -> DataFrame:
    """Coverage and accuracy of the choices made with at least a given confidence."""
    sure = F.coalesce("confidence", F.lit(0.0))
    cells = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            _ratio(F.count_if(sure >= t), F.count("*")).alias("coverage"),
            _ratio(F.count_if((sure >= t) & F.col("correct")), F.count_if(sure >= t)).alias("accuracy"),
        ).alias(f"t{i}")
        for i, t in enumerate(thresholds)
    ]
    one = choices.agg(*cells)
    return one.select(F.explode(F.array(*[F.col(f"t{i}") for i in range(len(cells))])).alias("c")).select("c.*")


def choice_accuracy_by_type(choices: DataFrame) -> DataFrame:
    """Choices and accuracy per question type."""
    return choices.groupBy("type").agg(F.count("*").alias("n"), F.avg(_as_number(F.col("correct"))).alias("accuracy"))


GATE_THRESHOLD = 0.3


def strategy_comparison(records: DataFrame, gate: float = GATE_THRESHOLD) -> DataFrame:
    """Confusion counts and rates of the four ways to decide whether to answer."""
    open_gate = F.col("decision_p") >= gate
    answered = ~F.col("model_refused")
    ways = {
        "answer_directly": answered,
        "model_judge": ~F.coalesce(F.col("model_judge") == F.lit(False), F.lit(False)),
        "decision_gate": open_gate,
        "decision_gate_and_refusal": open_gate & answered,
    }
    label = F.col("answerable")
    one = records.agg(
        *[
            F.struct(F.lit(n).alias("strategy"), *[c.alias(k) for k, c in _counts(label, p).items()]).alias(n)
            for n, p in ways.items()
        ]
    )
    rows = one.select(F.explode(F.array(*[F.col(n) for n in ways])).alias("s")).select("s.*")
    return refusal_rates(with_rates(rows))


def strategy_costs(records: DataFrame, gate: float = GATE_THRESHOLD) -> DataFrame:
    """Per scheme: time quantiles, mean time on unanswerable questions, model calls and tokens."""
    open_gate = F.col("decision_p") >= gate
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    gated = F.col("retrieve_s") + F.col("decision_ms") / 1000 + F.when(open_gate, F.col("gen_s")).otherwise(0.0)
    schemes = F.array(
        F.struct(
            F.lit("answer_directly").alias("scheme"),
            (F.col("retrieve_s") + F.col("gen_s")).alias("seconds"),
            F.lit(1).alias("call"),
            tokens.alias("tokens"),
        ),
        F.struct(
            F.lit("decision_gate").alias("scheme"),
            gated.alias("seconds"),
            open_gate.cast("int").alias("call"),
            F.when(open_gate, tokens).otherwise(0).alias("tokens"),
        ),
    )
    rows = records.select("answerable", F.explode(schemes).alias("s")).select("answerable", "s.*")
    totals = rows.groupBy("scheme").agg(
        F.sum("call").alias("model_calls"),
        F.sum("tokens").alias("model_tokens"),
        F.avg(F.when(~F.col("answerable"), F.col("seconds"))).alias("unanswerable_mean_s"),
    )
    times = nearest_rank_quantiles(rows, "seconds", ["scheme"]).select(
        "scheme", F.col("median").alias("p50_s"), F.col("p95").alias("p95_s")
    )
    return totals.join(times, "scheme")


def tool_run_summary(records: DataFrame) -> DataFrame:
    """Accuracy of two routers, mean seconds and calls, errors: per type and in total (type NULL)."""

    def aggregates() -> list[Column]:
        return [
            F.count("*").alias("n"),
            F.avg(_as_number(F.col("agent_correct"))).alias("agent_accuracy"),
            F.avg(_as_number(F.col("decision_correct"))).alias("decision_accuracy"),
            F.avg("agent_total_s").alias("agent_total_s_mean"),
            F.avg("agent_model_calls").alias("agent_model_calls_mean"),
            F.avg("agent_tool_calls").alias("agent_tool_calls_mean"),
            F.count_if(F.coalesce("agent_error", F.lit("")) != "").alias("agent_errors"),
        ]

    return records.groupingSets([[F.col("type")], []], F.col("type")).agg(*aggregates())


def nearest_rank_quantiles(df: DataFrame, value: str, by: list[str] | None = None, levels: dict[str, float] | None = None) -> DataFrame:
    """Per group: n, mean, median, the element at ``min(n-1, int(p*n))`` per level, and the maximum."""
    keys = list(by or [])
    levels = levels or {"p50": 0.5, "p95": 0.95}
    places = value_positions(df, value, keys)
    total = F.col("total")

    def at(index: Column) -> Column:
        holds = (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
        return F.max(F.when(holds, F.col(value)))

    return places.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"),
        ((at(F.floor((total - 1) / 2)) + at(F.floor(total / 2))) / 2).alias("median"),
        *[at(F.least(total - 1, F.floor(total * F.lit(p)))).alias(name) for name, p in levels.items()],
        F.max(value).alias("max"),
    )
