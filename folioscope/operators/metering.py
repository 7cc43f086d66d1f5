"""Tokens, cost, latency and counters over request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import estimate_tokens, strip

# Histogram bounds in seconds, the fallback price name, limits.
LATENCY_BUCKETS = [0.25, 0.5, 1, 2, 3, 5, 8, 12, 20, 30, 45, 60, 90, 120, float("inf")]
FIRST_TOKEN_BUCKETS = [0.25, 0.5, 1, 1.5, 2, 3, 5, 10, 20, 30, 45, 60, float("inf")]
DEFAULT_PRICE = "default"
TRACE_PATTERN = "^[A-Za-z0-9._-]+$"
TRACE_LENGTH = 64
SUMMARY_LENGTH = 300
UNKNOWN_TOOL = "(未知工具)"
FAILURE_MARK = " 失败]"


def resolve_usage(requests: DataFrame) -> DataFrame:
    """Reported tokens win; else an estimate from the prompt texts and the answer; else none.

    Columns used: ``prompt_tokens``, ``completion_tokens``, ``prompt_texts`` (array, NULL when
    nothing was assembled) and ``answer``.
    """
    reported = F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull()
    estimable = F.col("prompt_texts").isNotNull()
    prompt = F.aggregate("prompt_texts", F.lit(0).cast("long"), lambda acc, t: acc + estimate_tokens(t))
    zero = F.lit(0).cast("long")
    return requests.withColumns(
        {
            "prompt_tokens": F.when(reported, F.coalesce("prompt_tokens", zero))
            .when(estimable, prompt)
            .otherwise(zero),
            "completion_tokens": F.when(reported, F.coalesce("completion_tokens", zero))
            .when(estimable, estimate_tokens("answer"))
            .otherwise(zero),
            "tokens_source": F.when(reported, "usage").when(estimable, "estimated").otherwise("none"),
        }
    )


def price(requests: DataFrame, pricing: DataFrame) -> DataFrame:
    """Add ``cost``: the model's price per 1000 tokens, else the default price, else 0.

    ``pricing(model, prompt, completion)`` is a small dimension; adaptive execution broadcasts it.
    """
    own = pricing.select("model", F.col("prompt").alias("_p"), F.col("completion").alias("_c"))
    fallback = pricing.where(F.col("model") == DEFAULT_PRICE).agg(
        F.max("prompt").alias("p"), F.max("completion").alias("c")
    ).first()  # one row of two numbers
    tokens_in, tokens_out = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    known = F.col("_known")
    prompt = F.when(known, F.coalesce("_p", F.lit(0.0))).otherwise(F.lit(fallback["p"] or 0.0))
    completion = F.when(known, F.coalesce("_c", F.lit(0.0))).otherwise(F.lit(fallback["c"] or 0.0))
    return (
        requests.drop("cost")
        .join(own.withColumn("_known", F.lit(True)), "model", "left")
        .withColumn("_known", F.coalesce("_known", F.lit(False)))
        .withColumn("cost", (tokens_in * prompt + tokens_out * completion) / 1000)
        .drop("_p", "_c", "_known")
    )


def flatten_request(requests: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """Flat log rows: times in ms with one decimal, cost with six, stage times as columns.

    ``stages`` names the stage columns wanted; without it stage times stay in a map.
    """
    seconds = F.col("stage_seconds")
    base = requests.select(
        "trace_id",
        "route",
        "status",
        "model",
        F.round(F.col("latency_s") * 1000, 1).alias("latency_ms"),
        F.round(F.col("first_token_s") * 1000, 1).alias("first_token_ms"),
        "prompt_tokens",
        "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.round("cost", 6).alias("cost"),
        *(
            [F.round(F.try_element_at(seconds, F.lit(s)) * 1000, 1).alias(f"{s}_ms") for s in stages]
            if stages
            else [F.transform_values(seconds, lambda _, v: F.round(v * 1000, 1)).alias("stage_ms")]
        ),
    )
    return base


def request_counters(requests: DataFrame) -> DataFrame:
    """Counters in long form ``(metric, labels, value)`` from one pass over the requests.

    Labels are joined by commas. Zero costs and zero tokens are not counted, requests without a
    known token source neither; a request without a number of model calls counts one.
    """
    route = F.coalesce("route", F.lit(""))
    source = F.coalesce("tokens_source", F.lit("none"))

    def point(metric: str, value: Column, *labels: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"), F.concat_ws(",", *labels).alias("labels"), value.cast("double").alias("value")
        )

    def positive(value: Column, entry: Column) -> Column:
        return F.when(F.coalesce(value, F.lit(0)) > 0, entry)

    counted = source != "none"
    points = F.array(
        point("requests_total", F.lit(1), route, F.col("status")),
        F.when(
            counted,
            positive(F.col("prompt_tokens"), point("tokens_total", F.col("prompt_tokens"), route, F.lit("prompt"), source)),
        ),
        F.when(
            counted,
            positive(
                F.col("completion_tokens"),
                point("tokens_total", F.col("completion_tokens"), route, F.lit("completion"), source),
            ),
        ),
        positive(
            F.col("cost"),
            point(
                "cost_total", F.col("cost"), route, F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown"))
            ),
        ),
        point("model_calls_total", F.coalesce(F.nullif("model_calls", F.lit(0)), F.lit(1)), route),
        F.when(F.coalesce("retrieval_skipped", F.lit(False)), point("retrieval_skipped_total", F.lit(1), F.lit(""))),
    )
    # Pre-aggregated per task before the shuffle; the result has one row per label set.
    return (
        requests.select(F.explode(F.array_compact(points)).alias("p"))
        .groupBy("p.metric", "p.labels")
        .agg(F.sum("p.value").alias("value"))
    )


def feedback_counter(votes: DataFrame) -> DataFrame:
    """Votes per route and verdict."""
    return votes.groupBy(F.coalesce("route", F.lit("unknown")).alias("route"), "verdict").agg(F.count("*").alias("votes"))


def tool_counter(calls: DataFrame) -> DataFrame:
    """Calls per tool and state."""
    return calls.groupBy(
        F.coalesce(F.nullif("tool", F.lit("")), F.lit("unknown")).alias("tool"),
        F.when(F.col("ok"), "ok").otherwise("fail").alias("status"),
    ).agg(F.count("*").alias("calls"))


def latency_histogram(requests: DataFrame, seconds: str, by: list[str], buckets: list[float] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative histogram rows ``(by, le, observations, total, sum)``; NULLs are not observed."""
    value = F.col(seconds)
    seen = requests.where(value.isNotNull())
    one = seen.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.sum(value).alias("sum"),
        *[F.count_if(value <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(buckets)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit("+Inf" if b == float("inf") else f"{b:g}").alias("le"), F.col(f"_b{i}").alias("observations")
            )
            for i, b in enumerate(buckets)
        ]
    )
    return one.select(*by, "total", "sum", F.explode(rows).alias("r")).select(*by, "r.le", "r.observations", "total", "sum")


def stage_seconds(stages: DataFrame) -> DataFrame:
    """Seconds per trace and stage; missing and negative measurements are ignored."""
    return (
        stages.where(F.col("seconds") >= 0).groupBy("trace_id", "stage").agg(F.sum("seconds").alias("seconds"))
    )


def update_gaps(updates: DataFrame) -> DataFrame:
    """Stage seconds from consecutive update times: each update is charged with the gap before it.

    ``updates(trace_id, ts, stage)``; the updates of one trace are one request's steps.
    """
    order = Window.partitionBy("trace_id").orderBy("ts")
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order)) / 1e6
    return stage_seconds(updates.select("trace_id", "stage", gap.alias("seconds")))


def agent_usage(calls: DataFrame) -> DataFrame:
    """Tokens per trace over its model calls; ``exact`` when every call reported."""
    silent = F.col("prompt_tokens").isNull() & F.col("completion_tokens").isNull()
    return calls.groupBy("trace_id").agg(
        F.count("*").alias("model_calls"),
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"),
        F.bool_and(~silent).alias("exact"),
    )


def tool_outcomes(messages: DataFrame) -> DataFrame:
    """Calls and failures per trace and tool, with the summary line of the last call.

    ``messages(trace_id, seq, tool, ok, content)``; when ``ok`` is NULL a first line starting
    with the failure mark of that tool tells.
    """
    tool = F.coalesce(F.nullif("tool", F.lit("")), F.lit(UNKNOWN_TOOL))
    first = F.substring_index("content", "\n", 1)
    marked = F.startswith(first, F.concat(F.lit("["), tool, F.lit(FAILURE_MARK)))
    return (
        messages.withColumn("_tool", tool)
        .withColumn("_ok", F.coalesce("ok", ~F.coalesce(marked, F.lit(False))))
        .withColumn("_line", F.left(F.coalesce(first, F.lit("")), F.lit(SUMMARY_LENGTH)))
        .groupBy("trace_id", F.col("_tool").alias("tool"))
        .agg(
            F.count("*").alias("calls"),
            F.count_if(~F.col("_ok")).alias("failures"),
            F.max_by("_line", "seq").alias("summary"),
        )
    )


def valid_trace_id(value: Column | str) -> Column:
    """A caller's id when it is safe to log (at most 64 characters of it), else a fresh one."""
    trimmed = strip(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")))
    fresh = F.left(F.md5(F.uuid().cast("binary")), F.lit(16))
    return F.when(trimmed.rlike(TRACE_PATTERN), F.left(trimmed, F.lit(TRACE_LENGTH))).otherwise(fresh)


def trace_timeline(requests: DataFrame, feedback: DataFrame, tools: DataFrame) -> DataFrame:
    """Everything known per trace as rows ``(trace_id, ts, kind, detail)``.

    Write it partitioned or sorted by ``trace_id, ts``; the order is not forced here.
    """
    parts = [
        requests.select(
            "trace_id", F.col("created_at").alias("ts"), F.lit("request").alias("kind"),
            F.concat_ws(" ", "route", "status").alias("detail"),
        ),
        feedback.select(
            "trace_id", F.col("created_at").alias("ts"), F.lit("feedback").alias("kind"),
            F.concat_ws(" ", "verdict", "reason").alias("detail"),
        ),
        tools.select("trace_id", "ts", F.lit("tool").alias("kind"), F.col("tool").alias("detail")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
