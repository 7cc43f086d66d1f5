"""The corpus pipeline: documents through toxicity, near duplicates, decontamination, secrets and packing.

Each stage takes ``(spark, docs, sf_dir)``; ``run`` writes every stage's rows as Parquet and reads them
back for the next one. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, jaccard, packing, secret_scan, toxicity
from folioscope.llm.shared import documents_of, likely_split, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model rejects go, with an id or without."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.kept(docs, model).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays; a repeated id stays once.

    Rows without an id are in no class and stay. Of rows with one id the smallest by text stays, null
    first. Only texts whose id may have to go, or is repeated, are shuffled.
    """
    classes = jaccard.near_duplicates(docs.select("doc_id", "text")).where("doc_id is not null")
    ids = classes.groupBy("doc_id").agg(F.min("component_id").alias("first"), F.count("*").alias("rows"))
    ids = written(ids.where("first <> doc_id or rows > 1"), "pipeline-ids")
    asked, kept = likely_split(docs.select(*COLUMNS), ids, "doc_id")
    told = asked.join(ids, "doc_id", "left")
    others = [c for c in COLUMNS if c != "doc_id"]
    once = told.where("first = doc_id").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row")).select("doc_id", "row.*")
    return kept.unionByName(told.where("first is null").select(*COLUMNS)).unionByName(once.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, in order or reordered, go."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays, with ``n_chars`` of its new text."""
    forest = secret_scan.train(secret_scan.labelled_findings(docs))
    return secret_scan.redact(docs.select(*COLUMNS), forest).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_documents),
]

#: Trained models and tokenizers take part: SQL cannot state the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = documents_of(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
