"""Global order and statistics against direct computations."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from folioscope.functions.order import ordered_concat, row_positions, value_positions
from folioscope.operators import evaluation as V
from folioscope.operators import feedback as B
from folioscope.streaming import flows


@pytest.fixture(scope="module")
def values():
    rng = random.Random(8)
    # A third of all rows shares one value.
    return [(i, rng.choice(["a", "b", None]), 7.0 if rng.random() < 0.34 else float(rng.randint(0, 40)), rng.random() < 0.4) for i in range(900)]


@pytest.fixture(scope="module")
def table(spark, values):
    return spark.createDataFrame(values, "id long, g string, x double, label boolean").repartition(7)


def test_row_positions(table, values):
    rows = row_positions(table, [F.asc("x"), F.desc("id")]).collect()
    want = [v[0] for v in sorted(values, key=lambda v: (v[2], -v[0]))]
    assert [r.id for r in sorted(rows, key=lambda r: r.position)] == want
    assert sorted(r.position for r in rows) == list(range(1, len(values) + 1))


def test_value_positions(table, values):
    for r in value_positions(table, "x", ["g"]).collect():
        group = [v[2] for v in values if v[1] == r.g]
        assert (r.n, r.before, r.total) == (group.count(r.x), sum(x < r.x for x in group), len(group))


def test_quantiles(table, values):
    for r in V.nearest_rank_quantiles(table, "x", ["g"]).collect():
        xs = sorted(v[2] for v in values if v[1] == r.g)
        n = len(xs)
        assert (r.n, r.p50, r.p95, r.max) == (n, xs[int(0.5 * n)], xs[min(n - 1, int(0.95 * n))], xs[-1])
        assert r.median == statistics.median(xs) and r.mean == pytest.approx(statistics.mean(xs))


def test_auroc_equals_pair_counting(table, values):
    row = V.auroc(table, "x", "label").first()
    pos = [v[2] for v in values if v[3]]
    neg = [v[2] for v in values if not v[3]]
    assert row.auroc == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
    assert V.auroc(table.where("label"), "x", "label").first().auroc is None


def test_spearman(spark):
    def rho(pairs):
        df = spark.createDataFrame(pairs, "x double, y double")
        row = V.spearman(df, "x", "y").first()
        return None if row is None or row.rho is None else round(row.rho, 9)

    assert rho([(1.0, 10.0), (2.0, 20.0), (3.0, 30.0)]) == 1.0
    assert rho([(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)]) == -1.0
    assert rho([(1.0, 1.0), (2.0, 2.0)]) is None
    assert rho([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)]) is None
    assert rho([(1.0, 1.0), (1.0, 2.0), (2.0, 3.0), (3.0, 4.0)]) == round(4.5 / (4.5 * 5) ** 0.5, 9)


def test_binary_metrics_undefined(spark):
    df = spark.createDataFrame([(False, False), (False, False)], "label boolean, pred boolean")
    row = V.binary_metrics(df, "label", "pred").first()
    assert (row.tn, row.accuracy, row.precision, row.recall, row.f1) == (2, 1.0, None, None, 0.0)


def test_ordered_concat(spark):
    rows = [("k", i, chr(97 + i % 26)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, t string").repartition(9)
    assert ordered_concat(df, ["k"], "i", "t").first().t == "".join(r[2] for r in rows)


def test_prune_keeps_rated_and_ties(spark):
    stamp = "2024-01-01 00:00:0"
    rows = [(f"t{i}", stamp + ("0" if i < 6 else "1")) for i in range(10)]
    logged = spark.createDataFrame(rows, "trace_id string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    rated = spark.createDataFrame([("t0",), ("t9",)], "trace_id string")

    def left(cap):
        return sorted(r.trace_id for r in B.prune_unrated(logged, rated, cap).collect())

    assert left(7) == ["t0", "t4", "t5", "t6", "t7", "t8", "t9"]
    assert left(1) == ["t0", "t9"]  # a soft cap
    assert len(left(0)) == len(left(10)) == 10


def test_negatives_are_circular(spark):
    df = spark.createDataFrame([(1, "q1", "a1"), (2, "q2", None), (3, "q3", "")], "question_id long, question string, ground_truth string")
    got = {r.question: [m.content for m in r.history] for r in V.make_negatives(df, "question_id").collect()}
    fallback = "文档中未找到相关内容。"
    assert got == {"q1": ["q3", fallback], "q2": ["q1", "a1"], "q3": ["q2", fallback]}


def test_failure_runs_cross_spans(spark):
    rng = random.Random(2)
    rows, want = [], []
    for dep in ("a", "b"):
        run = 0
        for i in range(400):
            ok = rng.random() < 0.35
            run = 0 if ok else run + 1
            rows.append((dep, i, i * 600, ok))
            if run == 3:
                want.append((dep, i))
    calls = spark.createDataFrame(rows, "dependency string, call_id long, at long, ok boolean").withColumn("ts", F.timestamp_seconds("at"))
    assert sorted((r.dependency, r.call_id) for r in flows.failure_runs(calls, span="1 hour").collect()) == want


def test_judge_json(spark):
    texts = ['```json\n{"a": "}{", "b": {"c": 1}} tail', "no", '"{" {"a": 1}', '{"a": ', '{} {"a": 1}', 'x } {"a": "\\"}"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [r.json for r in V.parse_judge_json(df, "t", "a string").orderBy("i").collect()]
    assert got == ['{"a": "}{", "b": {"c": 1}}', None, '{"a": 1}', None, "{}", '{"a": "\\"}"}']


def test_score_cells_keep_failures(spark):
    samples = spark.createDataFrame(
        [("c", "q1", "answer", ["t"], "ref"), ("c", "q2", "", ["t"], None)],
        "combo string, user_input string, response string, retrieved_contexts array<string>, reference string",
    )

    def scorer(cell):
        if cell["metric"] == "faithfulness":
            raise RuntimeError("cut off: no end")
        return 0.5

    rows = {(r.user_input, r.metric): r for r in V.score_cells(V.score_plan(samples), scorer).collect()}
    assert len(rows) == 8
    assert rows["q1", "context_recall"].value == 0.5
    assert rows["q1", "faithfulness"].error.startswith("RuntimeError: cut off")
    assert rows["q2", "faithfulness"].skipped == V.SKIPPED_NO_ANSWER
    assert rows["q2", "context_recall"].skipped == V.SKIPPED_NO_REFERENCE


def test_ranges_follow_the_partition_number(spark):
    """No range of values is much larger than its share, also for many partitions."""
    from folioscope.functions import order

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = spark.range(40_000).selectExpr("cast(id as double) * id as v")
        ranged = df.groupBy("v").count().repartitionByRange(order._range_count(df), "v").groupBy(F.spark_partition_id()).count()
        assert ranged.agg(F.max("count")).first()[0] < 40_000 / 200 * 3
        rows = order.value_positions(df, "v").agg(F.min("before"), F.max("before"), F.countDistinct("before")).first()
        assert tuple(rows) == (0, 39_999, 40_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
