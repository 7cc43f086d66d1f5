"""Cut Markdown into overlapping, heading-aware chunks.

A document is one row, so everything below works on arrays inside that row: no shuffle is needed
from the raw text to the finished chunks, whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import (
    PATH_SEPARATOR,
    WHITESPACE_CLASS,
    overlap_length,
    strip,
    uuid_of,
    with_heading,
)

# Characters after which a long paragraph may be cut, and the paragraph mark.
BREAK_CHARACTERS = "。！？；\n！?!;:：，,、 \t"
PARAGRAPH_MARK = "\n\n"
SMALLEST_SIZE = 50
IDENTITY_PREFIX = 50

PIECE_TYPE = "array<struct<heading:string,piece:string>>"


def chunk_params(size: int = 500, overlap: int = 50) -> tuple[int, int]:
    """Size of at least 50; overlap between 0 and half the size."""
    size = max(SMALLEST_SIZE, int(size))
    return size, max(0, min(int(overlap), size // 2))


def section_array(content: Column) -> Column:
    """Trimmed, non-empty sections; a section starts at a line of 1-6 ``#`` and white space."""
    parts = F.split(content, f"\\n(?=#{{1,6}}{WHITESPACE_CLASS})")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def _parsed_section(section: Column) -> Column:
    first = F.substring_index(section, "\n", 1)
    title = F.regexp_extract(first, f"(?s)^(#{{1,6}}){WHITESPACE_CLASS}+(.*)\\z", 2)
    level = F.length(F.regexp_extract(first, f"(?s)^(#{{1,6}}){WHITESPACE_CLASS}+.*\\z", 1))
    rest = F.substr(section, F.length(first) + 2)
    return F.struct(
        level.alias("level"),
        F.when(level > 0, strip(title)).alias("title"),
        F.when(level > 0, strip(rest)).otherwise(section).alias("body"),
    )


def _with_paths(sections: Column) -> Column:
    """Attach to every parsed section the titles of its open ancestors and itself."""
    parsed = F.transform(sections, _parsed_section)
    entry = "struct<level:int,title:string>"
    empty = F.struct(
        F.array().cast(f"array<{entry}>").alias("open"),
        F.array().cast("array<struct<level:int,heading:string,body:string>>").alias("done"),
    )

    def visit(state: Column, section: Column) -> Column:
        heading = F.struct(section["level"].alias("level"), section["title"].alias("title"))
        above = F.filter(state["open"], lambda e: e["level"] < section["level"])
        opened = F.when(section["level"] > 0, F.concat(above, F.array(heading))).otherwise(state["open"])
        path = F.when(
            section["level"] > 0,
            F.array_join(F.transform(opened, lambda e: e["title"]), PATH_SEPARATOR),
        ).otherwise(F.lit(""))
        row = F.struct(section["level"].alias("level"), path.alias("heading"), section["body"].alias("body"))
        return F.struct(opened.alias("open"), F.concat(state["done"], F.array(row)).alias("done"))

    return F.aggregate(parsed, empty, visit, lambda s: s["done"])


def split_sections(docs: DataFrame) -> DataFrame:
    """Rows ``(source, section_idx, section)``, trimmed and non-empty."""
    return docs.select("source", F.posexplode(section_array(F.col("content"))).alias("section_idx", "section"))


def heading_path(docs: DataFrame) -> DataFrame:
    """Rows ``(source, section_idx, level, heading, body)``; sections without a body are left out."""
    return (
        docs.select("source", F.posexplode(_with_paths(section_array(F.col("content")))).alias("section_idx", "s"))
        .select("source", "section_idx", "s.level", "s.heading", "s.body")
        .where(F.col("body") != "")
    )


def paragraph_array(body: Column) -> Column:
    """Trimmed, non-empty paragraphs of a section body."""
    return F.filter(F.transform(F.split(body, PARAGRAPH_MARK), strip), lambda p: p != "")


def split_paragraphs(sections: DataFrame) -> DataFrame:
    """Rows ``(source, section_idx, heading, paragraph_idx, paragraph)``."""
    return sections.select(
        "source",
        "section_idx",
        "heading",
        F.posexplode(paragraph_array(F.col("body"))).alias("paragraph_idx", "paragraph"),
    )


def long_text_pattern(max_len: int) -> str:
    """One greedy match per piece of an over-long text.

    After skipping white space a piece is the whole rest when it fits, else everything up to the
    last break character of the window when that lies in its second half, else a full window.
    """
    early = max_len // 2
    any_char = "[\\s\\S]"
    breaks = "[" + BREAK_CHARACTERS + "]"
    return (
        f"{WHITESPACE_CLASS}*"
        f"(?:{any_char}{{1,{max_len}}}\\z|{any_char}{{{early},{max_len - 1}}}{breaks}|{any_char}{{{max_len}}})"
    )


def split_long(text: Column, max_len: int) -> Column:
    """Pieces of at most ``max_len`` characters; short text stays one piece."""
    trimmed = strip(text)
    pieces = F.transform(F.regexp_extract_all(trimmed, F.lit(long_text_pattern(max_len)), F.lit(0)), strip)
    return F.when(F.length(trimmed) > max_len, pieces).otherwise(F.array(trimmed))


def unit_array(body: Column, size: int) -> Column:
    """Paragraphs, the over-long ones cut by :func:`split_long`."""
    return F.flatten(F.transform(paragraph_array(body), lambda p: split_long(p, size)))


def pack_units(units: Column, size: int, overlap: int) -> Column:
    """Fill chunks greedily; a new chunk opens with the tail of the last one when that still fits."""
    gap = len(PARAGRAPH_MARK)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("current"))

    def joined(head: Column, unit: Column) -> Column:
        return F.concat(head, F.lit(PARAGRAPH_MARK), unit)

    def visit(state: Column, unit: Column) -> Column:
        current = state["current"]
        empty = current == ""
        fits = F.length(current) + gap + F.length(unit) <= size
        if overlap > 0:
            tail = strip(F.right(current, F.lit(overlap)))
            keeps_tail = (tail != "") & (F.length(tail) + gap + F.length(unit) <= size)
            reopened = F.when(keeps_tail, joined(tail, unit)).otherwise(unit)
        else:
            reopened = unit
        return F.struct(
            F.when(empty | fits, state["done"])
            .otherwise(F.concat(state["done"], F.array(current)))
            .alias("done"),
            F.when(empty, unit).when(fits, joined(current, unit)).otherwise(reopened).alias("current"),
        )

    def finish(state: Column) -> Column:
        return F.when(state["current"] == "", state["done"]).otherwise(
            F.concat(state["done"], F.array(state["current"]))
        )

    return F.aggregate(units, start, visit, finish)


def chunk_identity(source: Column, index: Column, heading: Column, content: Column) -> Column:
    """Stable id of a chunk: MD5 over file, position, heading and the first 50 characters."""
    return uuid_of(
        F.concat_ws(":", source, index.cast("string"), heading, F.left(content, F.lit(IDENTITY_PREFIX)))
    )


def number_pieces(pieces: DataFrame) -> DataFrame:
    """Add id and embedding text to rows ``(source, chunk_index, heading, content)``."""
    return pieces.select(
        chunk_identity(F.col("source"), F.col("chunk_index"), F.col("heading"), F.col("content")).alias("chunk_id"),
        "source",
        "chunk_index",
        "heading",
        "content",
        with_heading("heading", "content").alias("embed_text"),
    )


def chunk_documents(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """``(source, content)`` to chunk rows in one narrow pass over the documents."""
    size, overlap = chunk_params(size, overlap)
    sections = F.filter(_with_paths(section_array(F.col("content"))), lambda s: s["body"] != "")
    pieces = F.flatten(
        F.transform(
            sections,
            lambda s: F.transform(
                pack_units(unit_array(s["body"], size), size, overlap),
                lambda piece: F.struct(s["heading"].alias("heading"), piece.alias("piece")),
            ),
        )
    )
    return number_pieces(
        docs.select("source", F.posexplode(pieces).alias("chunk_index", "p")).select(
            "source",
            "chunk_index",
            F.col("p.heading").alias("heading"),
            F.col("p.piece").alias("content"),
        )
    )


def chunk_stats(chunks: DataFrame, overlap: int = 50) -> DataFrame:
    """Per document: chunks, longest, shortest, characters, and neighbours sharing text."""
    # One document is one input row, so its chunks are a bounded group.
    neighbours = Window.partitionBy("source", "heading").orderBy("chunk_index")
    shared = overlap_length(F.lag("content").over(neighbours), F.col("content"), max(1, overlap))
    return (
        chunks.select("source", "chunk_index", F.length("content").alias("chars"), shared.alias("shared"))
        .groupBy("source")
        .agg(
            F.count("*").alias("chunks"),
            F.max("chars").cast("long").alias("max_chars"),
            F.min("chars").cast("long").alias("min_chars"),
            F.sum("chars").cast("long").alias("total_chars"),
            F.count_if(F.col("shared") > 0).alias("overlapping"),
        )
    )
