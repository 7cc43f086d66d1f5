"""Registered lookup, packing and prompt queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import context as K
from folioscope.operators import retrieval as R
from folioscope.plans import tools as P
from folioscope.registry.chunk_queries import CHUNKS_SQL, WS, chunks
from folioscope.registry.derive import EVENTS_SQL, corpus, interactions, load, questions
from folioscope.registry.retrieval_queries import BM25_SQL, EMBEDDER, LEGS_SQL, _vectors

PACK_BUDGET = 300
LONG = 1 << 20


def digest(column: str):
    return F.md5(F.col(column).cast("binary"))


# ---------------------------------------------------------------- requests


def section_requests(spark: SparkSession, d: str) -> DataFrame:
    """One request per document: English ones ask for the first section, the others for all."""
    title = X.strip(F.substring_index("text", "\n", 1))
    return load(spark, d, "documents").select(
        F.col("doc_id").alias("request_id"),
        F.concat(F.lit("doc"), "doc_id", F.lit(".md")).alias("source"),
        F.when(F.col("lang") == "en", title).alias("heading"),
    )


SECTION_REQUESTS_SQL = f"""section_requests AS (
  SELECT doc_id AS request_id, 'doc' || doc_id || '.md' AS source,
         CASE WHEN lang = 'en' THEN trim(split_part(text, chr(10), 1), {WS}) END AS heading FROM documents)"""


def expand_requests(spark: SparkSession, d: str) -> DataFrame:
    """One request per document: exact headings, parts of headings in lower case, unknown names."""
    title = X.strip(F.substring_index("text", "\n", 1))
    return load(spark, d, "documents").select(
        F.col("doc_id").alias("request_id"),
        F.concat(F.when(F.col("lang") == "de", "ghost").otherwise("doc"), F.col("doc_id"), F.lit(".md")).alias("source"),
        F.when(F.col("lang") == "en", title)
        .when(F.col("lang") == "fr", F.lower(F.substring(title, 2, 9)))
        .otherwise("no such heading")
        .alias("heading"),
    )


EXPAND_REQUESTS_SQL = f"""expand_requests AS (
  SELECT doc_id AS request_id, CASE WHEN lang = 'de' THEN 'ghost' ELSE 'doc' END || doc_id || '.md' AS source,
         trim(CASE lang WHEN 'en' THEN trim(split_part(text, chr(10), 1), {WS})
           WHEN 'fr' THEN lower(substr(trim(split_part(text, chr(10), 1), {WS}), 2, 9)) ELSE 'no such heading' END, {WS}) AS section FROM documents)"""


def literal_requests(spark: SparkSession, d: str) -> DataFrame:
    """Two requests per question: its second word anywhere, its third word in one document."""
    words = F.split("text", " ")
    base = load(spark, d, "benchmark")
    anywhere = base.select(
        (F.col("item_id") * 2).alias("request_id"), F.get(words, 1).alias("pattern"), F.lit(None).cast("string").alias("source")
    )
    inside = base.select(
        (F.col("item_id") * 2 + 1).alias("request_id"),
        F.get(words, 2).alias("pattern"),
        F.concat(F.when(F.length("text") > 200, "doc").otherwise("ghost"), F.col("item_id"), F.lit(".md")).alias("source"),
    )
    return anywhere.unionByName(inside)


LITERAL_REQUESTS_SQL = """literal_requests AS (
  SELECT item_id * 2 AS request_id, string_split(text, ' ')[2] AS pattern, CAST(NULL AS VARCHAR) AS source FROM benchmark
  UNION ALL
  SELECT item_id * 2 + 1, string_split(text, ' ')[3],
         CASE WHEN length(text) > 200 THEN 'doc' ELSE 'ghost' END || item_id || '.md' FROM benchmark)"""


def passage_requests(spark: SparkSession, d: str) -> DataFrame:
    """The whole text of every question as a pattern."""
    return load(spark, d, "benchmark").select(
        F.col("item_id").alias("request_id"), F.col("text").alias("pattern"), F.lit(None).cast("string").alias("source")
    )


# ---------------------------------------------------------------- queries


def fetch_section(spark: SparkSession, d: str) -> DataFrame:
    return K.fetch_section(section_requests(spark, d), chunks(spark, d)).select(
        "request_id", F.col("chunk_index").cast("long").alias("chunk_index"), "heading", digest("content").alias("digest")
    )


def document_exists(spark: SparkSession, d: str) -> DataFrame:
    return K.document_exists(expand_requests(spark, d), chunks(spark, d))


def find_literal(spark: SparkSession, d: str) -> DataFrame:
    return K.find_literal(literal_requests(spark, d), chunks(spark, d)).select(
        "request_id", F.col("rank").cast("long").alias("rank"), "source", F.col("chunk_index").cast("long").alias("chunk_index"), "total"
    )


def find_passages(spark: SparkSession, d: str) -> DataFrame:
    return K.find_literal(passage_requests(spark, d), corpus(spark, d).withColumn("chunk_index", F.lit(0))).select(
        "request_id", F.col("rank").cast("long").alias("rank"), "source", "total"
    )


def literal_lookup(spark: SparkSession, d: str) -> DataFrame:
    return K.literal_lookup(literal_requests(spark, d), chunks(spark, d))


def stitch_section(spark: SparkSession, d: str) -> DataFrame:
    return K.stitch_section(chunks(spark, d), 50).select("source", "heading", "chunks", digest("body").alias("digest"))


def expand_section(spark: SparkSession, d: str) -> DataFrame:
    rows = K.expand_section(expand_requests(spark, d), chunks(spark, d), 50)
    return rows.select("request_id", "status", "heading", "chunks", digest("body").alias("digest"), "hint")


def expand_tool(spark: SparkSession, d: str) -> DataFrame:
    """The section tool: bodies cut to the token budget of one call."""
    rows = P.expand_section(expand_requests(spark, d), chunks(spark, d), 50)
    return rows.select("request_id", "status", "chunks", digest("body").alias("digest"), "truncated")


def literal_tool(spark: SparkSession, d: str) -> DataFrame:
    """The literal tool: hits packed into the token budget of one call and rendered."""
    rows = P.find_literal(literal_requests(spark, d), chunks(spark, d))
    return rows.select("request_id", "status", "total", "shown", digest("rendered").alias("digest"), "truncated")


def heading_hints(spark: SparkSession, d: str) -> DataFrame:
    return K.heading_hints(chunks(spark, d))


def estimate_tokens(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", X.estimate_tokens("text").alias("tokens"))


def truncate_tokens(spark: SparkSession, d: str) -> DataFrame:
    cut = load(spark, d, "documents").select("doc_id", X.truncate_tokens("text", 100).alias("cut"))
    return cut.select("doc_id", F.length("cut").cast("long").alias("chars"), digest("cut").alias("digest"))


def _document_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every document as one context list: its chunks in order."""
    return chunks(spark, d).select(
        F.col("source").alias("query_id"), (F.col("chunk_index") + 1).alias("rank"), "source", "heading", "content"
    )


def pack_contexts(spark: SparkSession, d: str) -> DataFrame:
    return K.pack_contexts(_document_hits(spark, d), PACK_BUDGET).select(
        "query_id", F.col("rank").cast("long").alias("rank"), digest("content").alias("digest"), "truncated"
    )


def render_contexts(spark: SparkSession, d: str) -> DataFrame:
    packed = K.pack_contexts(_document_hits(spark, d), PACK_BUDGET)
    return K.render_contexts(packed).select("query_id", digest("rendered").alias("digest"))


def _bm25_hits(spark: SparkSession, d: str) -> DataFrame:
    source = corpus(spark, d)
    asked = questions(spark, d)
    return R.backfill_candidates(R.bm25_search(asked, R.bm25_index(source), 5), source, asked.count() * 5)


def build_prompts(spark: SparkSession, d: str) -> DataFrame:
    prompts = K.build_prompts(questions(spark, d), _bm25_hits(spark, d))
    return prompts.select(
        "query_id",
        F.md5(F.get("messages", 0)["content"].cast("binary")).alias("system_digest"),
        F.get("messages", 1)["content"].alias("asked"),
        K.prompt_token_estimate("messages").alias("tokens"),
    )


def citation_footer(spark: SparkSession, d: str) -> DataFrame:
    return K.citation_footer(_bm25_hits(spark, d))


def confidence_flag(spark: SparkSession, d: str) -> DataFrame:
    from folioscope.plans.retrieve import RetrieveOptions, retrieve

    hits = retrieve(questions(spark, d), _vectors(spark, d), EMBEDDER, RetrieveOptions(hybrid=True, rerank=True))
    return K.confidence_flag(hits, 0.5).select(
        "query_id", F.round("top_rerank_score", 4).alias("top_rerank_score"), "low_confidence"
    )


def search_docs(spark: SparkSession, d: str) -> DataFrame:
    result = P.search_docs(questions(spark, d), _vectors(spark, d), EMBEDDER)
    return result.select("query_id", "status", "hits", "kept", "truncated")


def dedupe_contexts(spark: SparkSession, d: str) -> DataFrame:
    rows = interactions(spark, d).select(
        F.col("session_id").alias("trace_id"),
        F.col("trace_id").cast("long").alias("_event"),
        F.posexplode("contexts").alias("_at", "c"),
    )
    flat = rows.select("trace_id", (F.col("_event") * 2 + F.col("_at")).alias("seq"), "c.source", "c.heading", "c.text")
    return K.dedupe_contexts(flat)


def lookup_status(spark: SparkSession, d: str) -> DataFrame:
    results = interactions(spark, d).select(
        F.col("event_type").alias("tool"),
        (F.col("status") == "ok").alias("ok"),
        (F.col("latency_ms") < 300).alias("empty"),
        (F.col("k") > 50).alias("truncated"),
    )
    return K.lookup_status(results)


# ---------------------------------------------------------------- SQL twins

TOKENS = "(length({0}) + 3) // 4"


def tokens_sql(text: str) -> str:
    """The estimate, with Han characters counted apart."""
    han = f"length(regexp_replace({text}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g'))"
    return f"({han} + (length({text}) - {han} + 3) // 4)"


LABEL = "('文档: ' || source || ' ｜ 章节: ' || CASE WHEN coalesce(heading, '') = '' THEN '（无标题正文）' ELSE heading END)"
PACK_SQL = (
    CHUNKS_SQL
    + f""",
cost AS (SELECT source AS query_id, chunk_index + 1 AS rank, source, heading, content, {tokens_sql(LABEL)} + 1 AS lab,
   {tokens_sql('content')} + {tokens_sql(LABEL)} + 1 AS cost FROM chunks),
used AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS used, sum(cost) OVER (PARTITION BY query_id) AS total FROM cost),
packed AS (SELECT query_id, rank, source, heading,
   CASE WHEN used <= {PACK_BUDGET} THEN content ELSE substr(content, 1, 4 * ({PACK_BUDGET} - lab)) END AS content, total > {PACK_BUDGET} AS truncated
   FROM used WHERE used <= {PACK_BUDGET} OR (rank = 1 AND lab < {PACK_BUDGET}))"""
)

STITCH = """ov AS (SELECT *, coalesce(list_max(list_filter(range(1, least(50, length(coalesce(prev, '')), length(content)) + 1),
    lambda x: right(prev, x) = left(content, x))), 0) AS cut FROM pv)"""
STITCH_SQL = (
    CHUNKS_SQL
    + """,
pv AS (SELECT *, lag(content) OVER (PARTITION BY source, heading ORDER BY chunk_index) AS prev FROM chunks),
"""
    + STITCH
    + f""",
stitched AS (SELECT source, heading, count(*) AS chunks,
   string_agg(CASE WHEN trim(substr(content, cut + 1), {WS}) <> '' THEN substr(content, cut + 1) END, chr(10) ORDER BY chunk_index) AS body
   FROM ov GROUP BY ALL)"""
)

HINTS_SQL = """hs AS (SELECT source, heading, min(chunk_index) AS f FROM chunks WHERE heading <> '' GROUP BY ALL),
hl AS (SELECT source, list(heading ORDER BY f) AS l FROM hs GROUP BY source),
hints AS (SELECT source, array_to_string(l[1:12], '、') || CASE WHEN len(l) > 12 THEN '…（共 ' || len(l) || ' 项）' ELSE '' END AS hint,
   len(l) AS headings FROM hl)"""

NAMES_SQL = """names AS (SELECT string_agg(source, '、' ORDER BY source) FILTER (r <= 12) || CASE WHEN count(*) > 12 THEN '…（共 ' || count(*) || ' 项）' ELSE '' END AS hint
  FROM (SELECT source, row_number() OVER (ORDER BY source) AS r FROM (SELECT DISTINCT source FROM chunks)))"""

EXPAND_SQL = f"""{CHUNKS_SQL}, {EXPAND_REQUESTS_SQL}, {HINTS_SQL},
g AS (SELECT r.request_id, c.*, CASE WHEN c.heading = r.section THEN 1 WHEN contains(lower(c.heading), lower(r.section)) THEN 2 ELSE 3 END AS grade
  FROM expand_requests r JOIN chunks c USING (source)),
b AS (SELECT *, min(grade) OVER (PARTITION BY request_id) AS best FROM g),
k AS (SELECT * FROM b WHERE grade = best AND best < 3),
pv AS (SELECT *, lag(content) OVER (PARTITION BY request_id ORDER BY chunk_index) AS prev FROM k),
{STITCH},
s AS (SELECT request_id, arg_min(heading, chunk_index) AS heading, min(best) AS grade, count(*) AS chunks,
   string_agg(CASE WHEN trim(substr(content, cut + 1), {WS}) <> '' THEN substr(content, cut + 1) END, chr(10) ORDER BY chunk_index) AS body
   FROM ov GROUP BY request_id),
known AS (SELECT DISTINCT source FROM chunks), {NAMES_SQL}"""

FOUND_SQL = f"""{CHUNKS_SQL}, {LITERAL_REQUESTS_SQL},
f AS (SELECT r.request_id, c.source, c.chunk_index, count(*) OVER (PARTITION BY request_id) AS total,
   row_number() OVER (PARTITION BY request_id ORDER BY c.source, chunk_index) AS rank
  FROM literal_requests r JOIN chunks c ON contains(c.content, r.pattern) AND (r.source IS NULL OR r.source = c.source))"""

PROMPT_SQL = f"""{BM25_SQL}, h AS (SELECT b.query_id, bm25_rank AS rank, c.source || ' › ' || c.heading AS citation, c.content
   FROM bleg b JOIN corpus c USING (chunk_id) WHERE bm25_rank <= 5)"""

_SYSTEM = f"""'{K.SYSTEM_BASE}' || chr(10) || chr(10) || coalesce('{K.SYSTEM_WITH_HITS.strip()}' || chr(10) ||
  string_agg('[资料' || rank || '｜出处: ' || citation || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank),
  '{K.SYSTEM_NO_HITS}')"""

QUERIES = {
    "fetch_section": fetch_section,
    "document_exists": document_exists,
    "find_literal": find_literal,
    "find_passages": find_passages,
    "literal_lookup": literal_lookup,
    "stitch_section": stitch_section,
    "expand_section": expand_section,
    "expand_tool": expand_tool,
    "literal_tool": literal_tool,
    "heading_hints": heading_hints,
    "estimate_tokens": estimate_tokens,
    "truncate_tokens": truncate_tokens,
    "pack_contexts": pack_contexts,
    "render_contexts": render_contexts,
    "build_prompts": build_prompts,
    "citation_footer": citation_footer,
    "confidence_flag": confidence_flag,
    "search_docs": search_docs,
    "dedupe_contexts": dedupe_contexts,
    "lookup_status": lookup_status,
}

ORACLES = {
    "fetch_section": f"""WITH RECURSIVE {CHUNKS_SQL}, {SECTION_REQUESTS_SQL}
      SELECT r.request_id, c.chunk_index, c.heading, md5(c.content) AS digest FROM section_requests r JOIN chunks c USING (source)
      WHERE coalesce(r.heading, '') = '' OR r.heading = c.heading""",
    "document_exists": f"""WITH RECURSIVE {CHUNKS_SQL}, {EXPAND_REQUESTS_SQL}
      SELECT request_id, source, source IN (SELECT source FROM chunks) AS exists FROM expand_requests""",
    "find_literal": f"WITH RECURSIVE {FOUND_SQL} SELECT request_id, rank, source, chunk_index, total FROM f WHERE rank <= 40",
    "find_passages": """WITH f AS (SELECT b.item_id AS request_id, 'doc' || d.doc_id || '.md' AS source FROM benchmark b
        JOIN documents d ON contains(d.text, b.text)),
      r AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS total, row_number() OVER (PARTITION BY request_id ORDER BY source) AS rank FROM f)
      SELECT request_id, rank, source, total FROM r WHERE rank <= 40""",
    "literal_lookup": f"""WITH RECURSIVE {FOUND_SQL}, {NAMES_SQL}, t AS (SELECT request_id, max(total) AS total FROM f GROUP BY request_id)
      SELECT r.request_id, CASE WHEN coalesce(total, 0) = 0 AND source IS NOT NULL AND source NOT IN (SELECT source FROM chunks) THEN (SELECT hint FROM names) END AS hint,
        CASE WHEN coalesce(total, 0) > 0 THEN 'ok'
          WHEN source IS NOT NULL AND source NOT IN (SELECT source FROM chunks) THEN 'no_document' ELSE 'empty' END AS status,
        coalesce(total, 0) AS total, least(coalesce(total, 0), 40) AS shown FROM literal_requests r LEFT JOIN t USING (request_id)""",
    "stitch_section": f"WITH RECURSIVE {STITCH_SQL} SELECT source, heading, chunks, md5(body) AS digest FROM stitched",
    "expand_section": f"""WITH RECURSIVE {EXPAND_SQL}
      SELECT r.request_id, CASE WHEN k.source IS NULL THEN 'no_document' WHEN s.grade = 1 THEN 'exact' WHEN s.grade = 2 THEN 'partial' ELSE 'no_section' END AS status,
        CASE WHEN s.grade IS NOT NULL THEN coalesce(nullif(s.heading, ''), '（无标题正文）') END AS heading, coalesce(s.chunks, 0) AS chunks, md5(s.body) AS digest,
        CASE WHEN k.source IS NULL THEN (SELECT hint FROM names) WHEN s.grade IS NULL THEN h.hint END AS hint
      FROM expand_requests r LEFT JOIN known k USING (source) LEFT JOIN s USING (request_id) LEFT JOIN hints h ON h.source = r.source""",
    "expand_tool": f"""WITH RECURSIVE {EXPAND_SQL},
      t AS (SELECT r.request_id, r.source, s.heading, s.body, s.chunks, s.grade, k.source IS NOT NULL AS is_known
        FROM expand_requests r LEFT JOIN known k USING (source) LEFT JOIN s USING (request_id)),
      c AS (SELECT *, {tokens_sql(LABEL)} + 1 AS lab, {tokens_sql('body')} AS cost FROM t)
      SELECT request_id, CASE WHEN NOT is_known THEN 'no_document' WHEN grade = 1 THEN 'exact' WHEN grade = 2 THEN 'partial' ELSE 'no_section' END AS status,
        coalesce(chunks, 0) AS chunks, md5(CASE WHEN cost + lab <= {K.EXPAND_TOKENS} THEN body ELSE substr(body, 1, 4 * ({K.EXPAND_TOKENS} - lab)) END) AS digest,
        cost + lab > {K.EXPAND_TOKENS} AS truncated FROM c""",
    "literal_tool": f"""WITH RECURSIVE {FOUND_SQL},
      h AS (SELECT f.request_id, f.rank, c.* FROM f JOIN chunks c USING (source, chunk_index) WHERE rank <= 40),
      cost AS (SELECT *, {tokens_sql(LABEL)} + 1 AS lab, {tokens_sql('content')} + {tokens_sql(LABEL)} + 1 AS cost FROM h),
      used AS (SELECT *, sum(cost) OVER (PARTITION BY request_id ORDER BY rank) AS used, sum(cost) OVER (PARTITION BY request_id) AS all_cost FROM cost),
      p AS (SELECT request_id, rank, {LABEL} AS label, all_cost > {K.PAYLOAD_TOKENS} AS cut,
          CASE WHEN used <= {K.PAYLOAD_TOKENS} THEN content ELSE substr(content, 1, 4 * ({K.PAYLOAD_TOKENS} - lab)) END AS content
        FROM used WHERE used <= {K.PAYLOAD_TOKENS} OR (rank = 1 AND lab < {K.PAYLOAD_TOKENS})),
      g AS (SELECT request_id, md5(string_agg(label || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest, bool_or(cut) AS cut
        FROM p GROUP BY request_id),
      t AS (SELECT request_id, max(total) AS total FROM f GROUP BY request_id)
      SELECT r.request_id, CASE WHEN coalesce(total, 0) > 0 THEN 'ok'
          WHEN source IS NOT NULL AND source NOT IN (SELECT source FROM chunks) THEN 'no_document' ELSE 'empty' END AS status,
        coalesce(total, 0) AS total, least(coalesce(total, 0), 40) AS shown, digest, coalesce(cut, false) OR coalesce(total, 0) > 40 AS truncated
      FROM literal_requests r LEFT JOIN t USING (request_id) LEFT JOIN g USING (request_id)""",
    "heading_hints": f"WITH RECURSIVE {CHUNKS_SQL}, {HINTS_SQL} SELECT source, hint, headings FROM hints",
    "estimate_tokens": f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents",
    "truncate_tokens": "SELECT doc_id, length(substr(text, 1, 400)) AS chars, md5(substr(text, 1, 400)) AS digest FROM documents",
    "pack_contexts": f"WITH RECURSIVE {PACK_SQL} SELECT query_id, rank, md5(content) AS digest, truncated FROM packed",
    "render_contexts": f"""WITH RECURSIVE {PACK_SQL} SELECT query_id,
      md5(string_agg({LABEL} || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest FROM packed GROUP BY query_id""",
    "build_prompts": f"""WITH {PROMPT_SQL}, s AS (SELECT q.item_id AS query_id, any_value(q.text) AS asked, {_SYSTEM} AS system
        FROM benchmark q LEFT JOIN h ON h.query_id = q.item_id GROUP BY q.item_id)
      SELECT query_id, md5(system) AS system_digest, asked, {tokens_sql('system')} + {tokens_sql('asked')} AS tokens FROM s""",
    "citation_footer": f"""WITH {PROMPT_SQL}, u AS (SELECT query_id, citation, min(rank) AS r FROM h GROUP BY ALL)
      SELECT query_id, chr(10) || chr(10) || '---' || chr(10) || '参考来源：' || string_agg(citation, '；' ORDER BY r) AS footer FROM u GROUP BY query_id""",
    "confidence_flag": f"""WITH {LEGS_SQL} SELECT query_id, round(pair, 4) AS top_rerank_score, pair < 0.5 AS low_confidence
      FROM ranked WHERE combo = 'hybrid+rerank' AND rank = 1""",
    "search_docs": f"""WITH {LEGS_SQL},
      c AS (SELECT query_id, rank, source, heading, content, {tokens_sql(LABEL)} + 1 AS lab, {tokens_sql('content')} + {tokens_sql(LABEL)} + 1 AS cost
            FROM ranked WHERE combo = 'hybrid+rerank'),
      u AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM c)
      SELECT query_id, 'ok' AS status, count(*) AS hits, count(*) FILTER (used <= 1200 OR (rank = 1 AND lab < 1200)) AS kept, sum(cost) > 1200 AS truncated
      FROM u GROUP BY query_id""",
    "dedupe_contexts": f"""WITH {EVENTS_SQL}, c AS (
        SELECT session_id AS trace_id, event_id * 2 AS seq, 'doc' || k || '.md' AS source, 'A' AS heading, 'text ' || k AS text FROM interactions
        UNION ALL SELECT session_id, event_id * 2 + 1, event_type || '.md', '', 'text of ' || event_type FROM interactions)
      SELECT trace_id, source, heading, text, min(seq) AS seq FROM c GROUP BY ALL""",
    "lookup_status": f"""WITH {EVENTS_SQL} SELECT event_type AS tool, CASE WHEN status <> 'ok' THEN 'failed' WHEN latency_ms < 300 THEN 'empty' ELSE 'ok' END AS status,
      count(*) AS results, count(*) FILTER (k > 50) AS truncated FROM interactions GROUP BY ALL""",
}
