"""A trie over the turns of conversations, summed bottom-up by centroid decomposition.

A conversation's prefixes are told apart by 128 bits: the exclusive or of a hash of every turn with its
place. Such keys can be scanned in blocks, so a conversation of any length is spread over tasks. Nodes
with the same smallest member form a chain down from a branch; sums over subtrees are taken on the
forest of chains. Spark cuts that forest into bounded components, tasks decompose each component at its
centroids, and the components form a smaller forest that is summed in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import streamed, written

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations share the first turns of the one at the multiple of FAMILY below; at most SHARED - 1 turns.
FAMILY = 20
SHARED = 4
#: Rows of one conversation or chain that one window may hold.
BLOCK_BITS = 10
#: Weight of a component of the forest; a component holds at most a few times as many chains.
SPAN = 1 << 12
#: Ids that one row of text holds before it is digested.
CHUNK = 4096
NODE = ["depth", "ka", "kb"]


def _block(place: Column) -> Column:
    return F.shiftright(place, BLOCK_BITS)


def _at_edge(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digests of all turns with their place from 0, and the number of turns of every conversation.

    Rows are sorted into ranges that may cut a conversation anywhere; a range knows how many turns of
    its first conversation came before it.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = written(
        conversations.where("conv_id is not null").select(
            F.col("conv_id").cast("long").alias("conv_id"),
            "turn",
            role.alias("role"),
            F.md5(text.cast("binary")).alias("tie"),
            F.xxhash64(F.lit(1), role, text).alias("a"),
            F.xxhash64(F.lit(2), role, text).alias("b"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "trie-turns",
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie"), F.col("row")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch["conv_id"].to_numpy()
            first = np.ones(len(ids), bool)
            first[1:] = ids[1:] != ids[:-1]
            start = np.flatnonzero(first)
            place = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
            if ids[0] == last:
                place[: start[1] if len(start) > 1 else None] += count
            last, count = ids[-1], int(place[-1]) + 1
            yield {**{c: batch[c] for c in ("conv_id", "a", "b", "words")}, "part": pa.array(np.full(len(ids), part), pa.int32()), "place": pa.array(place)}

    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(streamed(ranged, number, "part int, conv_id long, place long, a long, b long, words long"), "trie-ranges")
    pieces = ranged.groupBy("conv_id", "part").agg((F.max("place") + 1).alias("n"))
    counts = pieces.groupBy("conv_id").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A range continues one conversation at most: no more rows than ranges.
    carried = pieces.withColumn("before", F.sum("n").over(before)).where("before is not null").select("conv_id", "part", "before")
    placed = ranged.join(F.broadcast(carried), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "a", "b", "words"), counts


def rebuilt_paths(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every rebuilt conversation (``conv_id``, ``length``), and a row per turn with the keys of its prefix."""
    turns, counts = numbered_turns(conversations)
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("long")
    counts = written(counts.select("conv_id", "n", base, shared.alias("shared")), "trie-counts")
    bases = counts.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    kept = F.least("shared", F.coalesce("base_n", F.lit(0)))
    convs = counts.join(bases, "base", "left").withColumn("kept", kept)
    convs = written(convs.withColumn("length", F.col("kept") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))), "trie-convs")
    firsts = turns.where(f"conv_id % {FAMILY} = 0 and place < {SHARED - 1}").withColumnRenamed("conv_id", "base")
    heads = convs.where("kept > 0").select("conv_id", "base", "kept").join(firsts, "base").where("place < kept")
    shorter = convs.where("kept < shared").select("conv_id", (F.col("shared") - F.col("kept")).alias("shift"))
    own = turns.where(F.col("place") >= shared).join(shorter, "conv_id", "left")
    tails = own.withColumn("place", F.col("place") - F.coalesce("shift", F.lit(0)))
    columns = ["conv_id", "place", "words", F.xxhash64("place", "a", "b").alias("ta"), F.xxhash64("b", "place", "a").alias("tb")]
    rows = heads.select(*columns).unionByName(tails.select(*columns)).withColumn("block", _block(F.col("place")))
    inside = Window.partitionBy("conv_id", "block").orderBy("place")
    scan = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = written(
        rows.select(
            "*",
            F.bit_xor("ta").over(scan).alias("xa"),
            F.bit_xor("tb").over(scan).alias("xb"),
            F.lead("place").over(inside).isNull().alias("last"),
        ),
        "trie-rows",
    )
    full = rows.where(_at_edge(F.col("place")) == (1 << BLOCK_BITS) - 1)
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    carried = full.select("conv_id", (F.col("block") + 1).alias("block"), F.bit_xor("xa").over(over).alias("ca"), F.bit_xor("xb").over(over).alias("cb"))
    paths = rows.join(carried, ["conv_id", "block"], "left")
    for lane in "ab":
        paths = paths.withColumn(f"k{lane}", F.col(f"x{lane}").bitwiseXOR(F.coalesce(f"c{lane}", F.lit(0))))
        paths = paths.withColumn(f"p{lane}", F.col(f"k{lane}").bitwiseXOR(F.col(f"t{lane}")))
    paths = paths.select("conv_id", (F.col("place") + 1).alias("depth"), "ka", "kb", "pa", "pb", "words", "last")
    return convs.select("conv_id", "length"), written(paths, "trie-paths")


def end_digests(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """For every node where conversations end (``depth``, ``ka``, ``kb``), the SHA-256 of their joined ids.

    Ids are sorted in ranges that may cut a node's ids, joined to texts of ``CHUNK`` ids there, and the
    texts of one node are fed in order to one digest, which holds no more than a batch.
    """
    last = paths.where("last")
    edge = _at_edge(F.col("depth")) == 0
    whole = convs.where((F.col("length") > 0) & (_at_edge(F.col("length")) == 0)).select("conv_id", F.col("length").alias("depth"))
    ends = last.where(~edge).select(*NODE, "conv_id").unionByName(last.where(edge).join(whole, ["conv_id", "depth"]).select(*NODE, "conv_id"))
    ends = ends.unionByName(convs.where("length = 0").select(F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(k) for k in NODE[1:]], "conv_id"))

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch[c].to_numpy() for c in NODE]
            ids = batch["conv_id"].to_numpy()
            new = np.zeros(len(ids), bool)
            new[::CHUNK] = True
            for key in keys:
                new[1:] |= key[1:] != key[:-1]
            at = np.flatnonzero(new)
            texts = [",".join(map(str, part)) for part in np.split(ids, at[1:])]
            yield {**{c: pa.array(key[at]) for c, key in zip(NODE, keys, strict=True)}, "first": pa.array(ids[at]), "ids": pa.array(texts, pa.string())}

    order = [*NODE, "conv_id"]
    chunks = streamed(ends.repartitionByRange(*order).sortWithinPartitions(*order), join_ids, "depth long, ka long, kb long, first long, ids string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        node, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for *key, ids in zip(*[batch[c].to_pylist() for c in [*NODE, "ids"]], strict=True):
                if key == node:
                    state.update(b",")
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield dict(zip([*NODE, "ends_sha256"], map(pa.array, zip(*done, strict=True)), strict=True))
        if node:
            yield dict(zip([*NODE, "ends_sha256"], map(pa.array, zip((*node, state.hexdigest()), strict=True)), strict=True))

    return streamed(chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first"), digest, "depth long, ka long, kb long, ends_sha256 string")


def centroid_sums(parent: list[int], values: np.ndarray) -> np.ndarray:
    """For every vertex of a forest the sum of ``values`` over its subtree, itself included.

    Parents come before their children; a parent of -1 marks a top. A component is split at its centroid,
    the deepest vertex with half of it below: the subtree's total goes to the centroid and to all vertices
    from there to the component's top, then the rest above and each branch below are components of their own.
    """
    sums = np.zeros_like(values)
    trees: dict[int, list[int]] = {}
    top = list(range(len(parent)))
    for v, p in enumerate(parent):
        if p >= 0:
            top[v] = top[p]
        trees.setdefault(top[v], []).append(v)
    size = [0] * len(parent)
    branch = [0] * len(parent)
    left = list(trees.values())
    while left:
        vertices = left.pop()
        head = vertices[0]
        if len(vertices) == 1:
            sums[head] += values[head]
            continue
        for v in vertices:
            size[v] = 1
        for v in reversed(vertices[1:]):
            size[parent[v]] += size[v]
        # Vertices with half of the component below lie on one path, so the last of them is the deepest.
        centroid = next(v for v in reversed(vertices) if 2 * size[v] >= len(vertices))
        for v in vertices:
            branch[v] = -1
        parts: dict[int, list[int]] = {}
        below = [centroid]
        for v in vertices:
            if v == centroid:
                branch[v] = v
            elif v == head or branch[parent[v]] == -1:
                parts.setdefault(-1, []).append(v)
            else:
                branch[v] = v if parent[v] == centroid else branch[parent[v]]
                parts.setdefault(branch[v], []).append(v)
                below.append(v)
        total = values[below].sum(axis=0)
        sums[centroid] += total
        v = centroid
        while v != head:
            v = parent[v]
            sums[v] += total
        left.extend(parts.values())
    return sums


def _component_sums(forest: DataFrame) -> DataFrame:
    """``x`` with its sums over the part of its subtree inside its component ``comp``."""

    def solve(table: pa.Table) -> dict:
        ids, ups = table["x"].to_pylist(), table["p"].to_pylist()
        at = {x: i for i, x in enumerate(ids)}
        values = np.stack([table[c].to_numpy() for c in ("leaves", "saved")], axis=1)
        comps = table["comp"].to_pylist()
        parents = [-1 if x == comp else at[p] for x, p, comp in zip(ids, ups, comps, strict=True)]
        sums = centroid_sums(parents, values)
        return {"x": table["x"], "leaves": pa.array(sums[:, 0]), "saved": pa.array(sums[:, 1])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        # Whole components: the last one of a batch waits for its other rows.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            comp = batch["comp"].to_numpy()
            cut = int(np.searchsorted(comp, comp[-1]))
            if cut or (held and held[0]["comp"][0].as_py() != comp[0]):
                yield solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield solve(pa.Table.from_batches(held))

    ordered = forest.select("comp", "x", "p", "w", "leaves", "saved").repartition("comp").sortWithinPartitions("comp", F.desc("w"))
    return streamed(ordered, run, "x long, leaves long, saved long")


def subtree_sums(forest: DataFrame, span: int = SPAN, weight: int | None = None) -> DataFrame:
    """``x, leaves, saved`` summed over every vertex's subtree of a tree.

    ``forest``: ``x``, its parent ``p`` (null at the top), a weight ``w`` that falls from parent to child and
    is at least the sum of the children's plus one, and the values ``leaves`` and ``saved``. Vertices whose
    weights lie in one band of width ``weight`` (``span`` at first) and that hang together are a component:
    in the lowest band a subtree, in others a path, so that none outweighs the band. The components are the
    vertices of a forest that is summed first, with bands ``span`` times as wide, until one is left.
    """
    weight = weight or span
    forest = written(forest.select("x", "p", "w", "leaves", "saved"), "trie-forest")
    top = forest.where("p is null").select("x", "w").head()
    if top is None:
        return forest.select("x", "leaves", "saved")
    if top.w < weight:
        return _component_sums(forest.withColumn("comp", F.lit(top.x)))
    band = F.expr(f"w div {weight}")
    bands = forest.select(F.col("x").alias("p"), band.alias("parent_band"))
    ups = forest.join(bands, "p", "left").select("x", F.when(band == F.col("parent_band"), F.col("p")).otherwise(F.col("x")).alias("up"))
    while True:
        # Every vertex jumps to where its upper vertex had jumped, until all are at their component's top.
        further = ups.select(F.col("x").alias("up"), F.col("up").alias("further"))
        ups = written(ups.join(further, "up").select("x", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("moved")), "trie-tops")
        if not ups.where("moved").limit(1).count():
            break
    forest = written(forest.join(ups.select("x", F.col("up").alias("comp")), "x"), "trie-components")
    totals = forest.groupBy("comp").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    tops = forest.where("x = comp").select("comp", "p", "w")
    over = forest.select(F.col("x").alias("p"), F.col("comp").alias("over"))
    smaller = tops.join(over, "p", "left").join(totals, "comp").select(F.col("comp").alias("x"), F.col("over").alias("p"), "w", "leaves", "saved")
    upper = subtree_sums(smaller, span, weight * span)
    hung = tops.where("p is not null").join(upper.withColumnRenamed("x", "comp"), "comp")
    hung = hung.groupBy(F.col("p").alias("x")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    more = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
    return _component_sums(forest.join(hung, "x", "left").select("comp", "x", "p", "w", *more))


def prefix_trie(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per node of the trie over rebuilt conversations.

    Rows without ``conv_id`` belong to no conversation and are left out; null roles and texts are empty.
    Turns are ordered by ``turn``, null first; turns of one number by role, then by the MD5 of their text, so equal
    rows are interchangeable. An empty table has no conversation and no node. Further columns are ignored.
    """
    convs, paths = rebuilt_paths(conversations)
    smallest, total = convs.agg(F.min("conv_id"), F.count("*")).head()
    deep = paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("m"),
        F.count("*").alias("n_convs"),
        F.max("words").alias("words"),
        F.max("pa").alias("pa"),
        F.max("pb").alias("pb"),
    )
    deep = written(deep, "trie-nodes")
    parents = deep.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("m").alias("parent"))
    below = deep.where("depth > 1").join(parents, ["depth", "pa", "pb"])
    first = deep.where("depth = 1").withColumn("parent", F.lit(smallest).cast("long"))
    columns = [*NODE, "m", "n_convs", "words", "parent"]
    spark = conversations.sparkSession
    root = spark.createDataFrame([(0, 0, 0, smallest, total, 0, None)] if total else [], "depth long, ka long, kb long, m long, n_convs long, words long, parent long")
    tree = written(reduce(DataFrame.unionByName, [below.select(*columns), first.select(*columns), root]), "trie-tree")
    children = tree.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("m")).agg(F.count("*").alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("words")
    tree = tree.join(children, ["depth", "m"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = written(tree.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": saved}), "trie-values")
    chains = tree.groupBy(F.col("m").alias("x")).agg(
        F.min("depth").alias("top"), F.max("n_convs").alias("w"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    uppers = tree.where("parent is not null and parent != m").select(F.col("m").alias("x"), F.col("parent").alias("p"))
    chains = written(chains.join(uppers, "x", "left"), "trie-chains")
    sums = subtree_sums(chains, span).withColumnsRenamed({"leaves": "all_leaves", "saved": "all_saved"})
    hung = chains.where("p is not null").select("x", "p", (F.col("top") - 1).alias("depth")).join(sums, "x")
    hung = hung.groupBy("depth", F.col("p").alias("m")).agg(F.sum("all_leaves").alias("more_leaves"), F.sum("all_saved").alias("more_saved"))
    tree = tree.join(hung, ["depth", "m"], "left").withColumn("block", _block(F.col("depth")))
    up = Window.partitionBy("m", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    tree = tree.withColumns({c: F.sum(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).over(up) for c in ("leaves", "saved")})
    tree = written(tree.drop("more_leaves", "more_saved"), "trie-sums")
    over = Window.partitionBy("m").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    edges = tree.where((F.col("depth") > 0) & (_at_edge(F.col("depth")) == 0))
    carried = edges.select("m", (F.col("block") - 1).alias("block"), *[F.sum(c).over(over).alias(f"more_{c}") for c in ("leaves", "saved")])
    tree = tree.join(carried, ["m", "block"], "left").join(end_digests(convs, paths), NODE, "left")
    return tree.select(
        F.col("m").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(name) for c, name in (("leaves", "n_leaves"), ("saved", "saved_tokens"))],
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
