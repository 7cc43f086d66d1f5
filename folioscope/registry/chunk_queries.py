"""Registered chunking and store queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import WHITESPACE
from folioscope.operators import chunking as C
from folioscope.registry.derive import MARKDOWN_SQL, load, markdown, spread
from folioscope.sources import files
from folioscope.sources import store as S

SIZE, OVERLAP = 500, 50


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the Markdown corpus at the default sizes."""
    return C.chunk_documents(markdown(spark, d), SIZE, OVERLAP)


def split_sections(spark: SparkSession, d: str) -> DataFrame:
    return C.split_sections(markdown(spark, d)).select(
        "source", F.col("section_idx").cast("long").alias("section_idx"), F.md5(F.col("section").cast("binary")).alias("digest")
    )


def heading_path(spark: SparkSession, d: str) -> DataFrame:
    return C.heading_path(markdown(spark, d)).select(
        "source",
        F.col("section_idx").cast("long").alias("section_idx"),
        "heading",
        F.md5(F.col("body").cast("binary")).alias("digest"),
    )


def split_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = C.split_paragraphs(C.heading_path(markdown(spark, d)))
    return rows.groupBy("source").agg(
        F.count("*").alias("paragraphs"), F.sum(F.length("paragraph")).cast("long").alias("chars")
    )


def split_long(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("doc_id", F.posexplode(C.split_long(F.col("text"), 200)).alias("i", "piece"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.md5(F.col("piece").cast("binary")).alias("digest"))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select(
        "chunk_id",
        "source",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "heading",
        F.length("content").cast("long").alias("chars"),
        F.md5(F.col("embed_text").cast("binary")).alias("digest"),
    )


def chunk_identity(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select(
        "doc_id",
        C.chunk_identity(F.col("source"), F.col("doc_id"), F.col("lang"), F.col("text")).alias("chunk_id"),
    )
    return rows


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_stats(chunks(spark, d), OVERLAP)


def admit_files(spark: SparkSession, d: str) -> DataFrame:
    """Names come from the page addresses, every second path part carrying a suffix of its own."""
    files_in = load(spark, d, "pages").select(
        "page_id",
        F.concat(F.col("url"), F.when(F.col("html").contains("fr"), ".md").otherwise(".MD ")).alias("name"),
        F.encode("html", "UTF-8").alias("content"),
    )
    return files.admit_files(files_in).select("page_id", F.col("filename"), "reason")


def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return S.list_documents(chunks(spark, d))


def count_chunks(spark: SparkSession, d: str) -> DataFrame:
    return S.count_chunks(load(spark, d, "documents"), {"lang": "en", "source": "src1"})


def scan_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = S.scan_chunks(load(spark, d, "documents"), {"source": "src2"}, columns=["doc_id", "lang", "n_chars"])
    return rows


def delete_where(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = S.delete_where(load(spark, d, "documents"), {"source": "src3"})
    return kept.select("doc_id", "source")


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored chunks, and fresh chunks of the English documents with a mark before their text."""
    table = spread(load(spark, d, "documents"))
    stored = table.select(
        F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("source"), F.col("text").alias("content")
    )
    fresh = table.where("lang = 'en'").select(
        F.concat(F.lit("c"), "doc_id").alias("chunk_id"),
        F.concat(F.col("source"), F.lit("-en")).alias("source"),
        F.concat(F.lit("new "), F.col("text")).alias("content"),
    )
    return stored, fresh


def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    stored, fresh = _versions(spark, d)
    return S.upsert_chunks(stored, fresh).select("chunk_id", "source", F.length("content").cast("long").alias("chars"))


def replace_documents(spark: SparkSession, d: str) -> DataFrame:
    """Re-chunk at half the size every document that has labels; the others keep their chunks."""
    labelled = load(spark, d, "labels").select(F.concat(F.lit("doc"), "doc_id", F.lit(".md")).alias("source"))
    docs = markdown(spark, d)
    fresh = C.chunk_documents(docs.join(labelled, "source", "left_semi"), 250, 0)
    return S.list_documents(S.replace_documents(chunks(spark, d), fresh))


def reindex(spark: SparkSession, d: str) -> DataFrame:
    docs = markdown(spark, d)
    return S.reindex_report(docs, C.chunk_documents(docs, SIZE, OVERLAP))


# ---------------------------------------------------------------- SQL twins


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = quoted(WHITESPACE)
WS_CLASS = "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

SECTIONS_SQL = (
    MARKDOWN_SQL
    + f""",
cut AS (SELECT source, unnest(string_split(regexp_replace(content, '\\n(#{{1,6}}{WS_CLASS})', chr(1) || '\\1', 'g'), chr(1))) AS part,
          generate_subscripts(string_split(regexp_replace(content, '\\n(#{{1,6}}{WS_CLASS})', chr(1) || '\\1', 'g'), chr(1)), 1) AS pos FROM md),
sec AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY pos) - 1 AS section_idx, trim(part, {WS}) AS section
        FROM cut WHERE trim(part, {WS}) <> ''),
parsed AS (SELECT source, section_idx, section, split_part(section, chr(10), 1) AS first,
             length(regexp_extract(split_part(section, chr(10), 1), '^(#{{1,6}}){WS_CLASS}+.*$', 1)) AS level,
             trim(regexp_extract(split_part(section, chr(10), 1), '^(#{{1,6}}){WS_CLASS}+(.*)$', 2), {WS}) AS title FROM sec),
opened AS (SELECT *, """
    + ", ".join(
        f"""last_value(CASE WHEN level = {n} THEN section_idx END IGNORE NULLS) OVER w AS i{n},
        last_value(CASE WHEN level = {n} THEN title END IGNORE NULLS) OVER w AS t{n}"""
        for n in range(1, 7)
    )
    + """ FROM parsed WINDOW w AS (PARTITION BY source ORDER BY section_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
paths AS (SELECT source, section_idx, CASE WHEN level = 0 THEN '' ELSE concat_ws(' › ', """
    + ", ".join(
        f"CASE WHEN {n} <= level AND i{n} IS NOT NULL"
        + "".join(f" AND i{n} > coalesce(i{m}, -1)" for m in range(1, n))
        + f" THEN t{n} END"
        for n in range(1, 7)
    )
    + f""") END AS heading,
   CASE WHEN level = 0 THEN section ELSE trim(substr(section, length(first) + 2), {WS}) END AS body FROM opened),
bodies AS (SELECT * FROM paths WHERE body <> ''),
paras AS (SELECT source, section_idx, heading, p, row_number() OVER (PARTITION BY source, section_idx ORDER BY pos) AS pi FROM (
   SELECT source, section_idx, heading, trim(unnest(string_split(body, chr(10) || chr(10))), {WS}) AS p,
          generate_subscripts(string_split(body, chr(10) || chr(10)), 1) AS pos FROM bodies) WHERE p <> '')"""
)


def pieces_expr(text: str, size: int) -> str:
    breaks = C.BREAK_CHARACTERS
    pattern = f"{WS_CLASS}*(?:[\\s\\S]{{1,{size}}}\\z|[\\s\\S]{{{size // 2},{size - 1}}}[{breaks}]|[\\s\\S]{{{size}}})"
    return f"""CASE WHEN length({text}) > {size} THEN list_transform(regexp_extract_all({text}, {quoted(pattern)}), lambda x: trim(x, {WS}))
      ELSE [{text}] END"""


def chunks_sql(name: str, size: int, overlap: int, where: str = "true") -> str:
    """CTEs ending in ``<name>(chunk_id, source, chunk_index, heading, content)``."""
    tail = f"trim(right(r.current, {overlap}), {WS})" if overlap else "''"
    return f""",
{name}_u AS (SELECT source, section_idx, heading, unit, row_number() OVER (PARTITION BY source, section_idx ORDER BY pi, pos) AS k FROM (
   SELECT source, section_idx, heading, pi, unnest({pieces_expr('p', size)}) AS unit,
          generate_subscripts({pieces_expr('p', size)}, 1) AS pos FROM paras WHERE {where})),
{name}_r AS (
  SELECT source, section_idx, heading, k, CAST([] AS VARCHAR[]) AS done, unit AS current FROM {name}_u WHERE k = 1
  UNION ALL
  SELECT r.source, r.section_idx, r.heading, u.k,
    CASE WHEN length(r.current) + 2 + length(u.unit) <= {size} THEN r.done ELSE list_append(r.done, r.current) END,
    CASE WHEN length(r.current) + 2 + length(u.unit) <= {size} THEN r.current || chr(10) || chr(10) || u.unit
         WHEN {tail} <> '' AND length({tail}) + 2 + length(u.unit) <= {size} THEN {tail} || chr(10) || chr(10) || u.unit
         ELSE u.unit END
  FROM {name}_r r JOIN {name}_u u ON u.source = r.source AND u.section_idx = r.section_idx AND u.k = r.k + 1),
{name}_l AS (SELECT source, section_idx, any_value(heading) AS heading, arg_max(list_append(done, current), k) AS pieces FROM {name}_r GROUP BY ALL),
{name}_p AS (SELECT source, heading, content, row_number() OVER (PARTITION BY source ORDER BY section_idx, pos) - 1 AS chunk_index FROM (
   SELECT source, section_idx, heading, unnest(pieces) AS content, generate_subscripts(pieces, 1) AS pos FROM {name}_l)),
{name}_h AS (SELECT *, md5(source || ':' || chunk_index || ':' || heading || ':' || substr(content, 1, 50)) AS h FROM {name}_p),
{name} AS (SELECT h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS chunk_id,
   source, chunk_index, heading, content FROM {name}_h)"""


CHUNKS_SQL = SECTIONS_SQL + chunks_sql("chunks", SIZE, OVERLAP)

_NAME = f"trim(regexp_replace(replace(url || CASE WHEN contains(html, 'fr') THEN '.md' ELSE '.MD ' END, chr(92), '/'), '^.*/', ''), {WS})"

QUERIES = {
    "split_sections": split_sections,
    "heading_path": heading_path,
    "split_paragraphs": split_paragraphs,
    "split_long": split_long,
    "chunk_documents": chunk_documents,
    "chunk_identity": chunk_identity,
    "chunk_stats": chunk_stats,
    "admit_files": admit_files,
    "list_documents": list_documents,
    "count_chunks": count_chunks,
    "scan_chunks": scan_chunks,
    "delete_where": delete_where,
    "upsert_chunks": upsert_chunks,
    "replace_documents": replace_documents,
    "reindex": reindex,
}

ORACLES = {
    "split_sections": f"WITH {SECTIONS_SQL} SELECT source, section_idx, md5(section) AS digest FROM sec",
    "heading_path": f"WITH {SECTIONS_SQL} SELECT source, section_idx, heading, md5(body) AS digest FROM bodies",
    "split_paragraphs": f"WITH {SECTIONS_SQL} SELECT source, count(*) AS paragraphs, CAST(sum(length(p)) AS BIGINT) AS chars FROM paras GROUP BY source",
    "split_long": f"""WITH t AS (SELECT doc_id, trim(text, {WS}) AS t FROM documents)
      SELECT doc_id, generate_subscripts({pieces_expr('t', 200)}, 1) - 1 AS i, md5(unnest({pieces_expr('t', 200)})) AS digest FROM t""",
    "chunk_documents": f"""WITH RECURSIVE {CHUNKS_SQL} SELECT chunk_id, source, chunk_index, heading, length(content) AS chars,
      md5(CASE WHEN heading = '' THEN content ELSE heading || chr(10) || content END) AS digest FROM chunks""",
    "chunk_identity": """WITH t AS (SELECT doc_id, md5(source || ':' || doc_id || ':' || lang || ':' || substr(text, 1, 50)) AS h FROM documents)
      SELECT doc_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS chunk_id FROM t""",
    "chunk_stats": f"""WITH RECURSIVE {CHUNKS_SQL}, n AS (SELECT source, content,
        lag(content) OVER (PARTITION BY source, heading ORDER BY chunk_index) AS prev FROM chunks),
      s AS (SELECT source, length(content) AS chars,
        len(list_filter(range(1, least({OVERLAP}, length(coalesce(prev, '')), length(content)) + 1), lambda x: right(prev, x) = left(content, x))) > 0 AS shared FROM n)
      SELECT source, count(*) AS chunks, max(chars) AS max_chars, min(chars) AS min_chars, CAST(sum(chars) AS BIGINT) AS total_chars,
        count(*) FILTER (shared) AS overlapping FROM s GROUP BY source""",
    "admit_files": f"""WITH t AS (SELECT page_id, {_NAME} AS filename, octet_length(encode(html)) AS bytes FROM pages)
      SELECT page_id, filename, CASE WHEN filename = '' OR starts_with(filename, '.') THEN 'bad_name'
        WHEN NOT regexp_full_match(filename, '(?i)[^/\\\\:*?"<>|\\x00-\\x1f]+\\.md') THEN 'not_markdown'
        WHEN bytes > 5242880 THEN 'too_large' END AS reason FROM t""",
    "list_documents": f"WITH RECURSIVE {CHUNKS_SQL} SELECT source, count(*) AS chunks FROM chunks GROUP BY source",
    "count_chunks": "SELECT count(*) AS chunks FROM documents WHERE lang = 'en' AND source = 'src1'",
    "scan_chunks": "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src2'",
    "delete_where": "SELECT doc_id, source FROM documents WHERE source <> 'src3'",
    "upsert_chunks": """SELECT 'c' || doc_id AS chunk_id, source || CASE WHEN lang = 'en' THEN '-en' ELSE '' END AS source,
      length(text) + CASE WHEN lang = 'en' THEN 4 ELSE 0 END AS chars FROM documents""",
    "replace_documents": f"""WITH RECURSIVE {CHUNKS_SQL}{chunks_sql("small", 250, 0)},
      l AS (SELECT 'doc' || doc_id || '.md' AS source FROM labels),
      m AS (SELECT source FROM chunks WHERE source NOT IN (FROM l) UNION ALL SELECT source FROM small WHERE source IN (FROM l))
      SELECT source, count(*) AS chunks FROM m GROUP BY source""",
    "reindex": f"""WITH RECURSIVE {CHUNKS_SQL} SELECT m.source, count(c.chunk_id) AS chunks, 'success' AS status, CAST(NULL AS VARCHAR) AS error
      FROM md m LEFT JOIN chunks c USING (source) GROUP BY m.source""",
}
