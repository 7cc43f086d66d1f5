"""Structured Streaming forms of indexing, metrics, feedback and sessions.

Every function takes streaming DataFrames and returns one, or starts a query with a given
checkpoint folder. Nothing is collected: results go to files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from folioscope.operators.chunking import chunk_documents
from folioscope.operators.embedding import Embedder, embed_chunks
from folioscope.operators.feedback import last_by
from folioscope.session import materialise
from folioscope.sources.store import ChunkTable
from folioscope.sources.versions import BUCKETS, Change, Manifest, VersionedTable

# When a dependency counts as unhealthy.
FAILURE_WINDOW = "60 seconds"
FAILURE_SLIDE = "10 seconds"
FAILURE_CALLS = 10
FAILURE_RATE = 0.5
FAILURE_RUN = 3


def write_files(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to Parquet files."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


# ---------------------------------------------------------------- indexing


def stream_index(docs: DataFrame, table: ChunkTable, embedder: Embedder, checkpoint: str, size: int = 500, overlap: int = 50) -> StreamingQuery:
    """Chunk and embed new or changed documents and swap them in per source.

    When a source comes twice in one batch its last row by ``version`` wins, if there is such a
    column. Running a batch again gives the same table.
    """

    def swap(batch: DataFrame, _: int) -> None:
        if "version" in batch.columns:
            batch = last_by(batch, "source", ["version"])
        if not batch.isEmpty():
            table.replace_documents(embed_chunks(chunk_documents(batch, size, overlap), embedder))

    return (
        docs.writeStream.foreachBatch(swap).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# ---------------------------------------------------------------- metrics


def window_metrics(requests: DataFrame, time: str = "created_at", width: str = "1 day", slide: str | None = None, delay: str | None = "1 hour", by: tuple[str, ...] = ("route", "status")) -> DataFrame:
    """Requests, tokens, cost and latency per time window; the same for batch and stream."""
    source = requests.withWatermark(time, delay) if requests.isStreaming and delay else requests
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return (
        source.groupBy(span.alias("w"), *by)
        .agg(
            F.count("*").alias("requests"),
            F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
            F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"),
            F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"),
            F.sum("latency_ms").alias("latency_ms"),
            F.max("latency_ms").alias("max_latency_ms"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by,
                "requests", "prompt_tokens", "completion_tokens", "cost", "latency_ms", "max_latency_ms")
    )


def session_metrics(requests: DataFrame, time: str = "created_at", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Requests and errors per session and stretch of activity."""
    source = requests.withWatermark(time, delay) if requests.isStreaming else requests
    return (
        source.groupBy(F.session_window(time, gap).alias("w"), "session_id")
        .agg(F.count("*").alias("requests"), F.count_if(F.col("status") != "ok").alias("errors"))
        .select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "requests", "errors")
    )


def failure_rate(
    calls: DataFrame,
    time: str = "ts",
    width: str = FAILURE_WINDOW,
    slide: str = FAILURE_SLIDE,
    min_calls: int = FAILURE_CALLS,
    rate: float = FAILURE_RATE,
    delay: str = "1 minute",
) -> DataFrame:
    """Windows in which a dependency had enough calls and failed too often."""
    source = calls.withWatermark(time, delay) if calls.isStreaming else calls
    return (
        source.groupBy(F.window(time, width, slide).alias("w"), "dependency")
        .agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"))
        .where((F.col("calls") >= min_calls) & (F.col("failures") >= F.col("calls") * rate))
        .select("dependency", F.col("w.start").alias("window_start"), "calls", "failures")
    )


def _watermark(raw: DataFrame, time: str, delay: str) -> Column | None:
    """Where a stream over ``raw`` stood at its end; None for no rows."""
    last = raw.agg(F.max(time).alias("last")).first()["last"]
    return None if last is None else F.lit(last) - F.expr(f"INTERVAL {delay}")


def close_windows(emitted: DataFrame, raw: DataFrame, build: Callable[[DataFrame], DataFrame], width: str, delay: str, by: tuple[str, ...], time: str = "created_at") -> DataFrame:
    """All windows of a stream that has ended: those it emitted, and those it still held open.

    ``raw`` is the stream's copy of its rows, of which only those that can lie in an open window are read;
    ``build`` makes windows of them as it did in the stream. Emitted windows stay as they are.
    """
    mark = _watermark(raw, time, delay)
    if mark is None:
        return emitted
    span = F.expr(f"INTERVAL {width}")
    held = build(raw.where(F.col(time) > mark - span)).where(F.col("window_start") + span > mark)
    keys = ["window_start", *by]
    return emitted.unionByName(held.join(emitted.select(*keys), keys, "left_anti").select(*emitted.columns))


def close_sessions(emitted: DataFrame, raw: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", time: str = "created_at") -> DataFrame:
    """All sessions of a stream that has ended: emitted ones, and open ones made of all their rows."""
    mark = _watermark(raw, time, delay)
    if mark is None:
        return emitted
    late = raw.where(F.col(time) + F.expr(f"INTERVAL {gap}") > mark).select("session_id").distinct()
    # Stored before it is filtered: a condition on a session's end would be pushed down to single rows.
    held = materialise(session_metrics(raw.join(late, "session_id", "left_semi"), time, gap)).where(F.col("ended") > mark)
    keys = ["session_id", "started"]
    return emitted.unionByName(held.join(emitted.select(*keys), keys, "left_anti").select(*emitted.columns))


def _runs(calls: DataFrame, time: str, span: str, carry: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``calls`` with the length of the run each belongs to, and ``(dependency, run)`` at their end.

    A dependency may own a third of all calls, so runs are counted inside time spans and carried
    over from span to span on one row per span. ``carry(dependency, run)`` are the runs open before.
    """
    order = ["dependency", "_span"]
    rows = calls.withColumn("_span", F.window(time, span)["start"])
    inside = Window.partitionBy(*order).orderBy(time, "call_id")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_wins", F.sum(F.col("ok").cast("int")).over(upto))
    streak = Window.partitionBy(*order, "_wins").orderBy(time, "call_id")
    # The first stretch of a span has no success before it and continues the last span's run.
    rows = rows.withColumn("_run", F.row_number().over(streak) - F.when(F.col("_wins") > 0, 1).otherwise(0))
    spans = rows.groupBy(*order).agg(
        F.max("_wins").alias("_won"),
        F.max_by("_run", F.struct(F.col(time), F.col("call_id"))).alias("_tail"),
    )
    if carry is None:
        spans = spans.withColumn("_before", F.lit(0).cast("long"))
    else:
        spans = materialise(spans).join(carry.select("dependency", F.col("run").alias("_before")), "dependency", "left")
    # One row per span: group the spans behind each one that saw a success and sum their tails.
    by_span = Window.partitionBy("dependency").orderBy("_span")
    spans = spans.withColumn("_group", F.sum((F.col("_won") > 0).cast("int")).over(by_span))
    stretch = Window.partitionBy("dependency", "_group").orderBy("_span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.coalesce("_before", F.lit(0))
    spans = spans.withColumn("_end", F.sum("_tail").over(stretch) + F.when(F.coalesce("_group", F.lit(0)) == 0, before).otherwise(0))
    opened = spans.select(*order, F.coalesce(F.lag("_end").over(by_span), before).alias("_carry"))
    total = F.when(F.col("ok"), 0).otherwise(F.col("_run") + F.when(F.col("_wins") == 0, F.col("_carry")).otherwise(0))
    ends = spans.groupBy("dependency").agg(F.max_by("_end", "_span").cast("long").alias("run"))
    return rows.join(opened, order).withColumn("run", total.cast("long")), ends


def failure_runs(calls: DataFrame, time: str = "ts", threshold: int = FAILURE_RUN, span: str = "1 hour", carry: DataFrame | None = None) -> DataFrame:
    """Calls that complete a run of ``threshold`` consecutive failures of a dependency (batch)."""
    rows, _ = _runs(calls, time, span, carry)
    return rows.where(F.col("run") == threshold).select("dependency", "call_id", F.col(time), "run")


def run_batches(calls: DataFrame, path: str, checkpoint: str, time: str = "ts", threshold: int = FAILURE_RUN, delay: str = "1 minute", span: str = "1 hour") -> StreamingQuery:
    """:func:`failure_runs` over a stream, batch by batch, each spread over time spans; read by :func:`read_runs`.

    A call is judged once the stream is ``delay`` past it. What goes from batch to batch is a row per dependency
    and the calls that still wait, in a folder per batch that a repeated batch replaces. A call that comes
    later than that would change runs that were reported: it is left to :func:`failure_runs`.
    """
    spark = calls.sparkSession
    fields = ["dependency", "call_id", time, "ok"]

    def judge(batch: DataFrame, batch_id: int) -> None:
        fresh, last = batch.select(*fields), batch.agg(F.max(time).alias("last"))
        carry = None
        if batch_id:
            old = spark.read.parquet(_part(path, "last", batch_id - 1))
            mark = old.first()["last"]
            if mark is not None:
                fresh = fresh.where(F.col(time) > F.lit(mark) - F.expr(f"INTERVAL {delay}"))
            held, carry = _waiting(calls, path, batch_id - 1, fields)
            fresh, last = fresh.unionByName(held), last.unionByName(old).agg(F.max("last").alias("last"))
        last.write.mode("overwrite").parquet(_part(path, "last", batch_id))
        mark = spark.read.parquet(_part(path, "last", batch_id)).first()["last"]
        passed = F.lit(False) if mark is None else F.col(time) <= F.lit(mark) - F.expr(f"INTERVAL {delay}")
        fresh.where(~passed).write.mode("overwrite").parquet(_part(path, "held", batch_id))
        rows, ends = _runs(fresh.where(passed), time, span, carry)
        found = rows.where(F.col("run") == threshold).select("dependency", "call_id", time, "run")
        found.write.mode("overwrite").parquet(_part(path, "out", batch_id))
        if carry is not None:
            ends = ends.unionByName(carry.join(ends.select("dependency"), "dependency", "left_anti"))
        ends.write.mode("overwrite").parquet(_part(path, "carry", batch_id))

    return calls.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _part(path: str, what: str, batch_id: int) -> str:
    return f"{path}/{what}/batch={batch_id}"


def _waiting(calls: DataFrame, path: str, batch_id: int, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The calls that wait after a batch, and the runs that are open before them."""
    kept = calls.select(*fields).schema
    runs = StructType([kept["dependency"], StructField("run", LongType())])
    read = calls.sparkSession.read
    return read.schema(kept).parquet(_part(path, "held", batch_id)), read.schema(runs).parquet(_part(path, "carry", batch_id))


def read_runs(calls: DataFrame, path: str, time: str = "ts", threshold: int = FAILURE_RUN, span: str = "1 hour") -> DataFrame:
    """All runs of a :func:`run_batches` that has ended: reported ones, and those that waiting calls complete."""
    spark = calls.sparkSession
    last = spark.read.parquet(f"{path}/last").agg(F.max("batch")).first()[0]
    held, carry = _waiting(calls, path, last, ["dependency", "call_id", time, "ok"])
    late = failure_runs(held, time, threshold, span, carry)
    return spark.read.schema(late.schema).parquet(f"{path}/out").select(*late.columns).unionByName(late)


# ---------------------------------------------------------------- feedback


def feedback_join(interactions: DataFrame, votes: DataFrame, within: str = "7 days", delay: str = "1 day", how: str = "full_outer") -> DataFrame:
    """Requests and votes matched by trace within a time bound, in whichever order they come.

    Votes without a logged request keep the route ``unknown``; later ones belong to
    :func:`append_votes`.
    """
    left = interactions.select("trace_id", F.col("created_at").alias("asked_at"), "route").withWatermark("asked_at", delay)
    right = votes.select(
        F.col("trace_id").alias("rated_trace"), F.col("created_at").alias("rated_at"), "verdict", "reason"
    ).withWatermark("rated_at", delay)
    bound = F.expr(f"INTERVAL {within}")
    match = (
        (F.col("trace_id") == F.col("rated_trace"))
        & (F.col("rated_at") >= F.col("asked_at") - bound)
        & (F.col("rated_at") <= F.col("asked_at") + bound)
    )
    return left.join(right, match, how).select(
        F.coalesce("trace_id", "rated_trace").alias("trace_id"),
        "asked_at",
        "rated_at",
        F.coalesce(F.nullif("route", F.lit("")), F.lit("unknown")).alias("route"),
        "verdict",
        "reason",
    )


def reconcile_feedback(interactions: DataFrame, votes: DataFrame) -> DataFrame:
    """The join of :func:`feedback_join` over all kept rows, without a time bound: the last vote per trace.

    A closing pass for votes that came later than a stream waits; unmatched rows of both sides stay.
    """
    last = last_by(votes.select(F.col("trace_id").alias("rated_trace"), "created_at", "verdict", "reason"), "rated_trace", ["created_at"])
    left = interactions.select("trace_id", F.col("created_at").alias("asked_at"), "route")
    right = last.withColumnRenamed("created_at", "rated_at")
    return left.join(right, F.col("trace_id") == F.col("rated_trace"), "full_outer").select(
        F.coalesce("trace_id", "rated_trace").alias("trace_id"),
        "asked_at",
        "rated_at",
        F.coalesce(F.nullif("route", F.lit("")), F.lit("unknown")).alias("route"),
        "verdict",
        "reason",
    )


def close_feedback(joined: DataFrame, interactions: DataFrame, votes: DataFrame) -> DataFrame:
    """All rows of a :func:`feedback_join` that has ended: emitted ones, and requests and votes it still held.

    A row that never found a partner in time is emitted or held once; what came later than the stream waits is
    told apart by :func:`reconcile_feedback`.
    """
    asked = joined.where("asked_at is not null").select("trace_id", "asked_at")
    rated = joined.where("rated_at is not null").select("trace_id", "rated_at", "verdict")
    lone = interactions.select("trace_id", F.col("created_at").alias("asked_at"), "route").join(asked, ["trace_id", "asked_at"], "left_anti")
    lost = votes.select("trace_id", F.col("created_at").alias("rated_at"), "verdict", "reason").join(rated, ["trace_id", "rated_at", "verdict"], "left_anti")
    named = lone.withColumn("route", F.coalesce(F.nullif("route", F.lit("")), F.lit("unknown")))
    return joined.unionByName(named, allowMissingColumns=True).unionByName(lost.withColumn("route", F.lit("unknown")), allowMissingColumns=True)


def append_votes(votes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep every vote, one folder per batch; a repeated batch replaces its own folder."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return votes.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest_votes(votes: DataFrame) -> DataFrame:
    """The last vote per trace of the kept votes."""
    return last_by(votes, "trace_id", ["created_at"])


def vote_table(votes: DataFrame, path: str, buckets: int = BUCKETS) -> VersionedTable:
    """Where :func:`merge_votes` keeps one vote per trace."""
    return VersionedTable(votes.sparkSession, path, votes.schema, "trace_id", ("trace_id",), buckets)


def merge_votes(votes: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Keep the last vote per trace: a batch rewrites the buckets of its own traces and no others.

    A read of the table costs as many rows as there are traces, however often they were voted on. Of votes
    with one time that with the largest values counts, so neither the order of batches nor a repeated
    batch changes the table. Readers keep the version they began with.
    """
    order = ["created_at", *(c for c in votes.columns if c not in ("trace_id", "created_at"))]

    def merge(batch: DataFrame, _: int) -> None:
        # A batch may be cut anywhere, so it is reduced to its own last votes once.
        fresh = materialise(last_by(batch, "trace_id", order))

        def build(base: Manifest) -> Change | None:
            touched = table.buckets_with(base, fresh)
            return Change(last_by(table.read(base, touched).unionByName(fresh), "trace_id", order), touched, base.facts) if touched else None

        table.change(build)

    return votes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metrics_with_raw_copy(requests: DataFrame, metrics_path: str, raw_path: str, checkpoint: str, **options: str) -> list[StreamingQuery]:
    """Late rows are dropped from the windows but never from the raw copy."""
    return [
        write_files(window_metrics(requests, **options), metrics_path, f"{checkpoint}/metrics"),
        write_files(requests, raw_path, f"{checkpoint}/raw"),
    ]
