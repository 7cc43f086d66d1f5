"""Shards of nearly equal bytes whose groups of equal texts stay whole, by Karmarkar-Karp differencing.

Texts are hashed into a fixed number of bundles, so equal texts always share one. Only the bundles'
sizes are differenced: ``BUNDLES`` numbers, whatever the input holds. Rows never move with their
texts; slots are numbered in blocks of rows, so that no shard or text is ever one window.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import written

#: Bundles that are differenced; several hundred for each of 40 shards, and far more rows than bundles on a cluster.
BUNDLES = 1 << 14
ROW_OVERHEAD = 16
BLOCK_BITS = 16


def differencing(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The part (0 to ``ways`` - 1) of every size, by multi-way Karmarkar-Karp differencing.

    Every size starts as a partial partition with one filled part. The two partials with the largest
    spread are combined, the fullest part of one with the emptiest of the other, until one is left.
    Equal spreads are taken in the order of the sizes. No size at all gives no part.
    """
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64)
    filled: dict[int, np.ndarray] = {}
    for i, size in enumerate(sizes):
        filled[i] = np.zeros(ways, np.int64)
        filled[i][0] = size
    heap = [(-int(size), i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    steps: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, left = heapq.heappop(heap)
        _, right = heapq.heappop(heap)
        sums = filled.pop(left) + filled.pop(right)[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        node = n + len(steps)
        steps.append((left, right, order))
        filled[node] = sums
        heapq.heappush(heap, (-int(sums[0]), node))
    labels = {n + len(steps) - 1: np.arange(ways)}
    parts = np.zeros(n, np.int64)
    for node in range(n + len(steps) - 1, n - 1, -1):
        left, right, order = steps[node - n]
        of = labels.pop(node)
        for child, place in ((left, order), (right, ways - 1 - order)):
            names = np.empty(ways, np.int64)
            names[place] = of
            if child < n:
                parts[child] = names[0]
            else:
                labels[child] = names
    return parts


def shard_by_bytes(docs: DataFrame, shards: int = 40, bundles: int = BUNDLES) -> DataFrame:
    """Every row of ``docs`` with its shard and its slot there, shards of nearly equal bytes.

    Columns: ``doc_id``, ``size`` (UTF-8 bytes of the text and 16 more; a null text has none),
    ``text_crc32``, ``law`` (``bytes``), ``shard``, ``slot`` (0, 1, ... without a gap in each shard) and
    ``grown_shard`` (null: the law gives no promise for another number of shards). Rows with equal texts
    share a shard; null and empty texts are equal. Repeated and null ids are rows like any other, an
    empty table gives no rows, further columns are ignored. A group larger than a shard's share fills
    a shard alone, which then exceeds the others.
    """
    text = F.coalesce("text", F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(bundles)).cast("int").alias("bundle"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sharding",
    )
    # At most ``bundles`` rows reach the driver, and as many are sent to the tasks.
    sums = rows.groupBy("bundle").agg(F.sum("size").alias("size")).toArrow().sort_by("bundle")
    parts = differencing(sums["size"].to_numpy(), shards)
    places = rows.sparkSession.createDataFrame(pa.table({"bundle": sums["bundle"], "shard": pa.array(parts, pa.int32())}), "bundle int, shard int")
    placed = rows.join(F.broadcast(places), "bundle").withColumn("block", F.shiftright("row", BLOCK_BITS))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row"))
    return (
        placed.withColumn("inside", inside)
        .join(firsts, ["shard", "block"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("inside") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
