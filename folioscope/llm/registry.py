"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import collocations, debruijn_dedup, decontaminate, jaccard, merkle, packing, prefix_trie, quality, secret_scan, sharding, suffix_dedup, token_counts, toxicity
from folioscope.llm.shared import bucket, documents_of


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; learnt from labelled rows outside the fold that is held out."""
    docs = documents_of(spark, sf_dir)
    held = bucket(3) == 1
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held))
    return quality.score_quality(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and its likeness to the edited text's and the next document's."""
    return merkle.against_next(documents_of(spark, sf_dir))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding that the forest keeps: its document, word number, digest and probability."""
    docs = documents_of(spark, sf_dir)
    forest = secret_scan.train(secret_scan.labelled_findings(docs))
    found = secret_scan.scan(docs, forest).select("doc_id", F.explode("secrets").alias("x"))
    return found.select(
        "doc_id",
        F.col("x.place").cast("long").alias("word"),
        F.length("x.secret").cast("long").alias("n_chars"),
        F.sha2("x.secret", 256).alias("secret_sha256"),
        "x.probability",
    )


def op7_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that windows of 20 words cover which start earlier too."""
    return debruijn_dedup.remove_repeats(documents_of(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; learnt from labelled rows outside the fold that is held out."""
    docs = documents_of(spark, sf_dir)
    held = bucket(5) == 0
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held))
    return toxicity.score_toxicity(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark item that its tiles cover most; contaminated from 0.6 on."""
    return decontaminate.judge(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that strings of 400 bytes cover which start elsewhere too."""
    return suffix_dedup.remove_repeats(documents_of(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates: five words, similarity 0.75 or more."""
    return jaccard.near_duplicates(documents_of(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens; over the limit above 1024."""
    return token_counts.with_limit(token_counts.count_tokens(documents_of(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of at most 2048 tokens."""
    return packing.pack(documents_of(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of two to four words, by the score of their weakest cut."""
    return collocations.collocations(documents_of(spark, sf_dir))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40, of nearly equal bytes, with equal texts together."""
    return sharding.shard_by_bytes(documents_of(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie over the rebuilt conversations, with sums over its subtree."""
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality": op4_quality,
    "op5_fingerprints": op5_fingerprints,
    "op6_secret_scan": op6_secret_scan,
    "op7_debruijn_dedup": op7_debruijn_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_sharding": op12_sharding,
    "op13_prefix_trie": op13_prefix_trie,
}

WORD = r"[^\x20\x09-\x0D]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op3_jaccard_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{WORD}') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, k FROM (
                SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                    ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN generate_series(1, len(ws) - 4)] END) AS k FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        b AS (SELECT l.doc_id AS x, r.doc_id AS y, count(*) AS c FROM s l JOIN s r ON l.k = r.k AND l.doc_id < r.doc_id GROUP BY ALL),
        e AS (
            SELECT x, y FROM b JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
        both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        reached(a, z) AS (
            SELECT doc_id, doc_id FROM n UNION SELECT reached.a, both_ways.y FROM reached JOIN both_ways ON reached.z = both_ways.x)
        SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(z), w.doc_id) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reached ON reached.a = w.doc_id GROUP BY w.doc_id""",
    "op7_debruijn_dedup": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
        p AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (
            SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS s FROM w WHERE len(ws) >= 20)),
        r AS (SELECT doc_id, s FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
        g AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS i FROM r),
        t AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM w),
        k AS (
            SELECT t.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY t.i) FILTER (g.i IS NULL) AS kept
            FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k USING (doc_id)""",
    "op11_collocations": rf"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang,
                unnest(regexp_split_to_array(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
        g AS (
            SELECT lang, size, unnest([array_to_string(ws[i:i + size - 1], ' ') FOR i IN generate_series(1, len(ws) - size + 1)]) AS phrase
            FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(ws) >= size),
        f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
        c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
        k AS (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM c),
        s AS (
            SELECT k.lang, k.phrase, k.a, k.ws, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * k.a) // (x.f + y.f) AS BIGINT) AS score, k
            FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1:k], ' ')
            JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
        m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        i AS (SELECT lang, a, ws, size, unnest(generate_series(2, size - 1)) AS length FROM c WHERE size > 2),
        j AS (SELECT lang, a, unnest([array_to_string(ws[x:x + length - 1], ' ') FOR x IN generate_series(1, size - length + 1)]) AS phrase FROM i),
        d AS (SELECT lang, phrase, max(a) AS longer FROM j GROUP BY ALL)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM m LEFT JOIN d USING (lang, phrase) JOIN t USING (lang)
        WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000""",
    "op13_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i
            FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT c, list(struct_pack(role := role, text := text) ORDER BY i) AS turns FROM t GROUP BY c),
        h AS (
            SELECT c, turns, xor(list_reduce(
                flatten([[4294967295::BIGINT], flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(c::VARCHAR, '')])]),
                lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, (s & 1) * 3988292384) END), 4294967295) % 4 AS h
            FROM o),
        r AS (
            SELECT h.c, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
        p AS (SELECT c, unnest(generate_series(0, len(turns))) AS d, turns FROM r),
        k AS (SELECT c, d, sha256(CAST(turns[1:d] AS VARCHAR)) AS k, turns[d].text AS last_text, d = len(turns) AS ends FROM p),
        n AS (
            SELECT d, k, min(c) AS m, count(*) AS n_convs, (count(*) - 1) * max(len(regexp_extract_all(coalesce(last_text, ''), '{WORD}'))) AS saved,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM k GROUP BY d, k),
        a AS (SELECT k.c, n.d, n.m FROM k JOIN n USING (d, k)),
        e AS (SELECT n.d, n.m, a.m AS parent FROM n JOIN a ON a.c = n.m AND a.d = n.d - 1),
        f AS (SELECT d - 1 AS d, parent AS m, count(*) AS n_children FROM e GROUP BY ALL),
        v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN f USING (d, m)),
        s AS (
            SELECT a.d, a.m, count(*) FILTER (v.n_children = 0) AS n_leaves, sum(v.saved) AS saved_tokens
            FROM v JOIN a ON a.c = v.m AND a.d <= v.d GROUP BY a.d, a.m)
        SELECT v.m AS conv_id, v.d AS depth, e.parent AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves,
            CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
        FROM v JOIN s USING (d, m) LEFT JOIN e USING (d, m)""",
}
