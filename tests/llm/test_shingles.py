"""Shingles of texts of every length, and what the first pass over the documents counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.llm import jaccard
from folioscope.llm.shared import text_blocks, written


def test_rows_are_sorted_by_either_way():
    """Many short rows are sorted together, long ones one by one."""
    draw = np.random.default_rng(5)
    for sizes in ([0, 500, 1, 0, 700], [1, 0, 2, 3, 0, 1]):
        rows = np.repeat(np.arange(len(sizes)), sizes)
        values = draw.integers(0, 50, len(rows)).astype(np.uint64)
        level = (values % 3).astype(np.uint8)
        assert jaccard._sorted_rows(values, rows, len(sizes)).tolist() == values[np.lexsort((values, rows))].tolist()
        assert jaccard._by_level(level, rows, len(sizes)).tolist() == np.lexsort((level, rows)).tolist()


def test_one_pass_gives_classes_and_counts(spark):
    """The documents are not cut into shingles once more to count them."""
    texts = [None, "", "one two", "a b c d e f g", "a b c d e f g", " ".join(f"w{i}" for i in range(900))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counted = jaccard.classes_of(docs, 5)
    assert counted.where(F.col("seen").isNull()).count() == len(texts)
    seen = np.zeros(jaccard.SKETCH, np.int64)
    for block in text_blocks(pa.array(texts, pa.string())):
        _, values = jaccard.shingle_sets(block, 5)
        np.add.at(seen, (values >> np.uint64(48)).astype(np.int64), 1)
    assert jaccard.frequency_levels(counted).tolist() == np.log2(1 + seen).astype(np.uint8).tolist()


def test_written_tables_leave_no_shuffle_files(spark):
    """Shuffles of a table that is written are gone when it stands, without a garbage collection."""
    ids = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    before = ids.shuffleStatuses().size()
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert ids.shuffleStatuses().size() <= before
    assert table.agg(F.sum("count")).first()[0] == 1000


def test_a_line_of_few_documents_is_no_bucket_key(spark):
    """Of a million shingles the few that four documents share are told apart, as their order decides the buckets."""
    rows = [(i, " ".join(map(str, range(2000 * i, 2000 * i + 2000))) + f" line {i % 125} of four documents and no others") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counted = jaccard.classes_of(docs, 5).cache()
    rough = np.repeat(jaccard.frequency_levels(counted), jaccard.CELLS // jaccard.SKETCH)
    found = [jaccard.shared_keys(jaccard.prefixes_of(docs, levels, 5, 75)).count() for levels in (jaccard.frequency_levels(counted, jaccard.CELLS, 4), rough)]
    assert found[0] < 10 and found[1] > 50
