"""Match a table of literal strings against a table of texts without a pair join."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN_LIMIT = 64
BLOCK_LIMIT = 20_000
BLOCK_BYTES = 8 << 20
#: Texts that are scanned at once.
SCAN_ROWS = 256


def _automaton_match(text: Column, patterns: list[str]) -> Column:
    """All patterns of a block in one scan per text."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = ahocorasick.Automaton()
        for pattern in patterns:
            machine.add_word(pattern, pattern)
        machine.make_automaton()
        for texts in batches:
            # A batch of the engine may hold many long texts; only a few become Python strings at once.
            for at in range(0, len(texts), SCAN_ROWS):
                part = texts.slice(at, SCAN_ROWS).to_pylist()
                yield pa.array([sorted({hit for _, hit in machine.iter(t)}) if t else [] for t in part], pa.list_(pa.string()))

    return match(text)


def match_literals(texts: DataFrame, text: str, patterns: DataFrame, block: int = BLOCK_LIMIT, plain: int = PLAIN_LIMIT) -> DataFrame:
    """Rows of ``texts`` with a column ``pattern`` for every literal of ``patterns`` they contain.

    Distinct patterns travel to the tasks in blocks bounded by number and bytes. A few are tested with
    ``contains``; more are found in one scan per text. Patterns over the block size mean more
    passes over the texts, never a dropped pattern. The match is case-sensitive.
    """
    wanted = patterns.select("pattern").where("pattern is not null and pattern <> ''").distinct()
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.octet_length("pattern")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    found = None
    for at in range(blocks):
        part = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == at)
        words = sorted(r["pattern"] for r in part.collect())  # one bounded block
        if not words:
            hits = F.array().cast("array<string>")
        elif len(words) <= plain:
            value = F.col(text)
            hits = F.filter(F.array(*[F.lit(w) for w in words]), lambda p: F.contains(value, p))
        else:
            hits = _automaton_match(F.col(text), words)
        rows = texts.withColumn("_hits", hits).where(F.size("_hits") > 0)
        rows = rows.withColumn("pattern", F.explode("_hits")).drop("_hits")
        found = rows if found is None else found.unionByName(rows)
    return found
