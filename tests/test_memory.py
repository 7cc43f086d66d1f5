"""What Python workers hold: batches bounded by bytes, freed memory given back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.functions import memory
from folioscope.llm.shared import documents_of
from folioscope.registry.derive import load


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    """Long texts come in more batches, not in larger ones, and none is lost."""
    rows = spark.range(300, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long text "), 10_000).alias("text"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "rows": [batch.num_rows]})

    for read in (lambda: load(spark, str(tmp_path), "documents"), lambda: documents_of(spark, str(tmp_path))):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        got = read().coalesce(1).mapInArrow(sizes, "bytes long, rows long").collect()
        assert sum(r["rows"] for r in got) == 300
        assert max(r["bytes"] for r in got) < 6 << 20


def test_memory_is_given_back_at_the_end_of_a_task(monkeypatch):
    calls = []
    monkeypatch.setattr(memory, "give_back", lambda: calls.append(1))
    out = memory.giving_back(lambda batches: (x + 1 for x in batches))(iter([1, 2]))
    assert next(out) == 2 and not calls
    assert list(out) == [3] and calls == [1]
