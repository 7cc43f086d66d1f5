"""Interaction log and user feedback: upserts, late joins, pruning, reports, regression questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.order import value_positions
from folioscope.functions.text import strip

# Verdicts, reason codes with their labels, limits.
VERDICTS = ["up", "down"]
REASONS = {
    "incomplete": "答案不全（漏了内容）",
    "wrong": "答案错误",
    "no_answer": "明明有资料却说查不到",
    "bad_citation": "引用来源不对",
    "slow": "太慢",
    "other": "其他",
}
COMMENT_LIMIT = 2000
UNKNOWN_ROUTE = "unknown"
UNSPECIFIED = "unspecified"


def last_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest whole row per key; rows are reduced per task before they are shuffled."""
    row = F.struct(*df.columns)
    latest = df.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return latest.select("_row.*")


def upsert_interactions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace by ``trace_id``: the incoming row wins, the newest among several incoming ones."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)))
    return last_by(both, "trace_id", ["_batch", "created_at"]).drop("_batch")


def project_stages(stages: Column | str) -> Column:
    """Keep the entries that describe agent steps or times."""
    value = F.col(stages) if isinstance(stages, str) else stages
    return F.map_filter(value, lambda k, _: k.startswith("agent_") | k.endswith("_ms"))


def reason_labels(df: DataFrame, column: str = "reason") -> Column:
    """The label of a reason code; an unknown code is its own label."""
    labels = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, F.col(column)), F.col(column))


def validate_feedback(submitted: DataFrame) -> DataFrame:
    """Add ``problem`` (NULL when valid) and clean the comment: trimmed, 2000 characters, blank to NULL."""
    comment = F.nullif(F.left(strip(F.coalesce("comment", F.lit(""))), F.lit(COMMENT_LIMIT)), F.lit(""))
    bad_verdict = ~F.coalesce(F.col("verdict").isin(VERDICTS), F.lit(False))
    bad_reason = (F.coalesce("reason", F.lit("")) != "") & ~F.col("reason").isin(list(REASONS))
    return submitted.withColumn("comment", comment).withColumn(
        "problem", F.when(bad_verdict, "bad_verdict").when(bad_reason, "bad_reason")
    )


def accepted_feedback(submitted: DataFrame) -> DataFrame:
    """Valid votes only, without the ``problem`` column."""
    return validate_feedback(submitted).where("problem is null").drop("problem")


def latest_feedback(votes: DataFrame) -> DataFrame:
    """One row per trace, the last vote wins."""
    return last_by(votes, "trace_id", ["created_at"])


def feedback_route(feedback: DataFrame, interactions: DataFrame) -> DataFrame:
    """Votes with the route of their trace; ``unknown`` when it was not logged (yet)."""
    return feedback.join(interactions.select("trace_id", "route"), "trace_id", "left").withColumn(
        "route", F.coalesce(F.nullif("route", F.lit("")), F.lit(UNKNOWN_ROUTE))
    )


def prune_unrated(interactions: DataFrame, feedback: DataFrame, cap: int) -> DataFrame:
    """Delete the oldest unrated rows beyond ``cap``; rated rows always stay.

    All rows count towards the cap but only unrated ones are deleted, so it is a soft cap. The
    cut-off time comes from counts per time stamp; only rows at that very time are ranked.
    """
    if cap <= 0:
        return interactions
    excess = interactions.count() - cap
    if excess <= 0:
        return interactions
    unrated = interactions.join(feedback.select("trace_id"), "trace_id", "left_anti").select("trace_id", "created_at")
    micros = unrated.select("trace_id", F.unix_micros("created_at").alias("_at"))
    places = value_positions(micros, "_at")
    edge = places.where((F.col("before") < excess) & (F.col("before") + F.col("n") >= excess)).select("_at", "before")
    cut = edge.first()
    if cut is None:  # fewer unrated rows than the excess: all of them go
        return interactions.join(micros.select("trace_id"), "trace_id", "left_anti")
    older = micros.where(F.col("_at") < cut["_at"]).select("trace_id")
    # Ties at the cut-off fall by id; a limit over an order keeps only that many rows per task.
    tied = micros.where(F.col("_at") == cut["_at"]).orderBy("trace_id").limit(int(excess - cut["before"]))
    return interactions.join(older.unionByName(tied.select("trace_id")), "trace_id", "left_anti")


def satisfaction(feedback: DataFrame) -> DataFrame:
    """One row: up, down and the share of up votes, NULL without votes."""
    up, down = F.count_if(F.col("verdict") == "up"), F.count_if(F.col("verdict") == "down")
    return feedback.agg(
        up.alias("up"), down.alias("down"), F.try_divide(up.cast("double"), (up + down).cast("double")).alias("satisfaction")
    )


def down_reasons(feedback: DataFrame) -> DataFrame:
    """Down votes per reason, votes without a reason left out."""
    return (
        feedback.where((F.col("verdict") == "down") & F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count("*").alias("votes"))
    )


def reason_report(feedback: DataFrame) -> DataFrame:
    """Reasons with labels, most frequent first."""
    counts = down_reasons(feedback)
    return counts.withColumn("label", reason_labels(counts)).orderBy(F.desc("votes"), F.asc("reason"))


def route_costs(interactions: DataFrame) -> DataFrame:
    """Per route over good requests: count, mean latency, tokens and cost, total cost.

    A missing cost is 0; a request with an unknown token side does not enter the token mean.
    """
    cost = F.coalesce("cost", F.lit(0.0))
    return (
        interactions.where(F.col("status") == "ok")
        .groupBy("route")
        .agg(
            F.count("*").alias("requests"),
            F.avg("latency_ms").alias("avg_latency_ms"),
            F.avg(F.col("prompt_tokens") + F.col("completion_tokens")).alias("avg_tokens"),
            F.avg(cost).alias("avg_cost"),
            F.sum(cost).alias("total_cost"),
        )
    )


def rated_interactions(interactions: DataFrame, feedback: DataFrame, verdict: str = "down") -> DataFrame:
    """Interactions with their vote of one verdict."""
    votes = feedback.where(F.col("verdict") == verdict).select(
        "trace_id", "verdict", "reason", "comment", F.col("created_at").alias("rated_at")
    )
    return interactions.join(votes, "trace_id")


def badcases(interactions: DataFrame, feedback: DataFrame, verdict: str = "down", limit: int = 200) -> DataFrame:
    """The newest rated interactions; a top-``limit`` report."""
    rated = rated_interactions(interactions, feedback, verdict)
    return rated.orderBy(F.desc("rated_at"), F.asc("trace_id")).limit(int(limit))


def badcases_to_questions(
    rated: DataFrame, existing: DataFrame | None = None, reason: str | None = None, route: str | None = None
) -> DataFrame:
    """Regression questions from rated interactions.

    One row per trimmed question, from its newest vote; blank questions and questions of
    ``existing(question)`` are skipped. ``expected_sources`` are the sources that were read then,
    a guess to be checked by hand.
    """
    rows = rated.withColumn("question", strip("question")).where(F.coalesce("question", F.lit("")) != "")
    if reason is not None:
        rows = rows.where(F.col("reason") == reason)
    if route is not None:
        rows = rows.where(F.col("route") == route)
    if existing is not None:
        known = existing.select(strip("question").alias("question")).distinct()
        rows = rows.join(known, "question", "left_anti")
    newest = last_by(
        rows.withColumn("_tie", F.reverse("trace_id")), "question", ["rated_at", "_tie"]
    )
    code = F.coalesce("reason", F.lit(UNSPECIFIED))
    sources = F.array_distinct(
        F.filter(F.transform("contexts", lambda c: c["source"]), lambda s: F.coalesce(s, F.lit("")) != "")
    )
    label = reason_labels(newest)
    total = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return newest.select(
        "question",
        F.concat(F.lit("badcase:"), code).alias("type"),
        sources.alias("expected_sources"),
        F.struct(
            "trace_id",
            "created_at",
            "route",
            "model",
            "verdict",
            code.alias("reason"),
            F.coalesce(label, code).alias("reason_label"),
            "comment",
            "answer",
            "latency_ms",
            total.alias("total_tokens"),
            "tokens_source",
            "stages",
            F.col("contexts").alias("contexts_used"),
        ).alias("_badcase"),
    )
