"""Substring deduplication on a compacted De Bruijn graph of tokens.

The k-mers of ``window`` words are the edges of a De Bruijn graph. An edge that occurs again is removed at
every occurrence but the first (smallest id, then hash of the text, then start), and a word goes if a removed edge covers it.

The graph is never written out edge by edge: consecutive edges with one sampled anchor are one path from
the start (``repeats``), and paths with equal words are one node path of the graph. A path whose anchor
has no other continuation does not branch: all its edges have the same occurrences, so one join with the
path's first source settles them together. Only at branches, where one anchor leads to several paths, the
edges themselves are counted, one path of each kind standing for its copies. Removed paths and edges that
follow each other in a document are compacted into long spans as far as their source coordinates advance
with them. Paths are equal by two hashes (anchor and whole context), edges by two hashes of their words.

Null and empty texts have no word. Documents shorter than a window lose nothing. Rows repeating an id and a
text are at one place, so neither is earlier; rows without an id, or with one id, are told apart by their
texts. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.repeats import Units, keyed, merged, per_document, repeats, runs_table
from folioscope.llm.shared import SECOND, WORDS, Texts, in_arrow, likely_split, mix, text_blocks, words_of, written


def _words(texts: Texts) -> Units:
    words = words_of(texts, lower=False)
    return Units(words.hash, words.offsets)


def branch_edges(docs: DataFrame, open_: DataFrame, window: int) -> DataFrame:
    """``one, two, doc, copy, start``: the edges of the paths in ``open_`` with two hashes of their words."""
    runs = F.collect_list(F.struct("start", "windows"))
    wanted = written(open_.groupBy("copy", "doc").agg(runs.alias("runs")).selectExpr("copy", "doc", "runs.start starts", "runs.windows windows"), "wanted")
    joined = likely_split(keyed(docs), wanted, "copy")[0].join(wanted, ["copy", "doc"]).select("doc", "text", "starts", "windows", "copy")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for texts in text_blocks(batch.column(1)):
            words = words_of(texts, lower=False)
            sums = [r.prefixes(words.hash) for r in (WORDS, SECOND)]
            some = batch.slice(texts.first, texts.rows)
            starts, windows = (some.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            row = np.repeat(np.arange(texts.rows), some.column(2).value_lengths().to_numpy())
            at = np.repeat(starts, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
            row = np.repeat(row, windows)
            place = at + words.offsets[row]
            inside = place + window <= words.offsets[row + 1]
            row, at, place = row[inside], at[inside], place[inside]
            one, two = (mix(r.ranges(s, place, place + window)).view(np.int64) for r, s in zip((WORDS, SECOND), sums, strict=True))
            yield {"one": one, "two": two, "doc": some.column(0).to_numpy()[row], "copy": some.column(4).to_numpy()[row], "start": at}

    return in_arrow(joined, run, "one long, two long, doc long, copy long, start int")


def removed_edges(docs: DataFrame, window: int = 20, anchor: int = 8) -> DataFrame:
    """``doc, copy, start, windows, source, source_copy, source_start``: runs of edges that occur earlier, and where."""
    found = repeats(runs_table(docs, _words, window, anchor, WORDS))
    # Copies of a path: settled by the path's first source.
    first = found.classes.where("n > 1").selectExpr(
        "anchor", "context", "first.doc as source", "first.copy as source_copy", "first.start as source_start")
    copies = found.members.join(first, ["anchor", "context"]).where("(doc, copy, start) > (source, source_copy, source_start)")
    copies = copies.select("doc", "copy", "start", "windows", "source", "source_copy", "source_start")
    # Branches: edges of the paths that share an anchor.
    edges = written(branch_edges(docs, found.open, window), "edges")
    low = edges.groupBy("one", "two").agg(F.min(F.struct("doc", "copy", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    low = written(low, "low")
    later = edges.join(low, ["one", "two"]).where("(doc, copy, start) > (first.doc, first.copy, first.start)")
    later = later.selectExpr(
        "doc", "copy", "start", "1 as windows", "first.doc as source", "first.copy as source_copy", "first.start as source_start")
    return copies.unionByName(later)


def compacted(removed: DataFrame, window: int = 20) -> DataFrame:
    """``doc, copy, start, end, source, source_copy, source_start``: spans of words whose edges advance with one source."""
    place = Window.partitionBy("copy", "doc").orderBy("start", "source", "source_copy", "source_start")
    before = F.lag(F.struct("source", "source_copy", (F.col("source_start") - F.col("start")).alias("shift"), (F.col("start") + F.col("windows")).alias("edge")))
    # Rows repeating an id and a text have the same runs.
    rows = removed.distinct().withColumn("b", before.over(place))
    goes_on = (F.col("b.source") == F.col("source")) & (F.col("b.source_copy") == F.col("source_copy"))
    goes_on &= (F.col("b.shift") == F.col("source_start") - F.col("start")) & (F.col("b.edge") >= F.col("start"))
    rows = rows.withColumn("span", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(place))
    out = rows.groupBy("copy", "doc", "span").agg(
        F.min("start").alias("start"), (F.max(F.col("start") + F.col("windows")) - 1 + window).alias("end"),
        F.first("source").alias("source"), F.first("source_copy").alias("source_copy"), F.min("source_start").alias("source_start"),
    )
    return out.drop("span")


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, kept_sha256`` of every row; ``kept`` joins the words that are left."""
    spans = written(per_document(compacted(removed_edges(docs, window), window)), "spans")
    some, rest = likely_split(keyed(docs), spans, "copy")
    joined = some.join(spans, ["copy", "doc"], "left").select("doc_id", "text", "starts", "ends")
    rest = rest.selectExpr("doc_id", "text", "cast(null as array<int>) starts", "cast(null as array<int>) ends")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for texts in text_blocks(batch.column(1)):
            words = words_of(texts, lower=False)
            data = texts.data.tobytes()
            kept, removed = [], []
            for k in range(texts.rows):
                a, b = words.offsets[k], words.offsets[k + 1]
                gone = np.zeros(b - a, bool)
                starts, ends = (batch.column(c)[texts.first + k].values for c in (2, 3))
                if starts is not None:
                    for x, y in zip(*merged(starts.to_numpy(), ends.to_numpy()), strict=True):
                        gone[x:y] = True
                left = np.flatnonzero(~gone) + a
                kept.append(b" ".join([data[s:e] for s, e in zip(words.start[left].tolist(), words.end[left].tolist(), strict=True)]))
                removed.append(int(gone.sum()))
            yield {
                "doc_id": batch.column(0).slice(texts.first, texts.rows),
                "n_words": np.diff(words.offsets),
                "n_removed": removed,
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept],
            }

    return in_arrow(joined.unionByName(rest), run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
