"""Global order without a single-task window.

A window without ``partitionBy`` moves the whole table into one task. The helpers here get the
same answers from range-partitioned data: rows are cut into ordered ranges, every range is
summarised to one row, the short list of summaries is accumulated, and the offsets are joined
back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import materialise


def _range_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def row_positions(df: DataFrame, order: list[Column], position: str = "position") -> DataFrame:
    """Number rows from 1 in a total order.

    One range shuffle and one checkpoint, so that the ranges used for counting and the ranges
    used for numbering are the same files even when an executor is lost in between.
    """
    ranged = materialise(
        df.repartitionByRange(_range_count(df), *order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_slot", 33))
    )
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row per range: at most spark.sql.shuffle.partitions rows.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(position, (F.col("_before") + local + 1).cast("long"))
        .drop("_slot", "_range", "_before")
    )


def value_positions(df: DataFrame, value: str, by: list[str] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct value (and group) with counts before it.

    Columns: the group columns, ``value``, ``n`` rows holding it, ``before`` rows with a smaller
    value, ``total`` rows of the group, and for every entry of ``sums`` a column with its sum
    plus ``before_<name>`` and ``total_<name>``. Equal values are pre-aggregated first, so a
    value that holds a third of all rows is a single row here.
    """
    keys = list(by or [])
    sums = sums or {}
    measures = ["n", *sums]
    distinct = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("n"), *[F.sum(expr).alias(name) for name, expr in sums.items()])
    )
    # The distinct values are computed once, dealt by ranges as many as there are shuffle partitions.
    ranged = distinct.repartitionByRange(_range_count(df), value).withColumn("_range", F.spark_partition_id())
    distinct = materialise(ranged)
    per_range = distinct.groupBy(*keys, "_range").agg(*[F.sum(m).alias(m) for m in measures])
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_before_{m}") for m in measures],
        *[F.sum(m).over(over).alias(f"_total_{m}") for m in measures],
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = distinct.select(
        "*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_local_{m}") for m in measures]
    )

    def named(prefix: str, measure: str) -> str:
        return prefix if measure == "n" else f"{prefix}_{measure}"

    left, right = local.alias("l"), offsets.alias("r")
    match = F.col("l._range") == F.col("r._range")
    for key in keys:  # groups may be NULL
        match = match & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    return left.join(right, match).select(
        *[F.col(f"l.{key}") for key in keys],
        value,
        *measures,
        *[(F.col(f"_before_{m}") + F.col(f"_local_{m}")).alias(named("before", m)) for m in measures],
        *[F.col(f"_total_{m}").alias(named("total", m)) for m in measures],
    )


def ordered_concat(df: DataFrame, keys: list[str], order: str, text: str, separator: str = "", span: int = 1024) -> DataFrame:
    """Join texts per key in the order of an integer column.

    Two levels: first within spans of the order column, then over the spans, so the rows of a
    hot key are spread over tasks and only their joined pieces meet.
    """
    pieces = (
        df.withColumn("_span", F.floor(F.col(order) / span))
        .groupBy(*keys, "_span")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("rows"))
        .select(*keys, "_span", F.array_join(F.col("rows")["t"], separator).alias("piece"))
    )
    return (
        pieces.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_span", "piece"))).alias("rows"))
        .select(*keys, F.array_join(F.col("rows")["piece"], separator).alias(text))
    )
