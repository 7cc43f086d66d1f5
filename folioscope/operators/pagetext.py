"""Clean extracted page text and rebuild it as Markdown.

Input: ``page_lines(doc_id, page_no, line_no, line)``, one row per text line.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import WHITESPACE, WHITESPACE_CLASS, col_of, nonblank, strip

# The patterns and words lines are recognised by.
LEADER = "\\.{4,}"
TOC_LINES = 5
TOC_ENTRY = "^(\\d+(?:\\.\\d+)*)\\s+(.+?)\\s*\\.{3,}\\s*(\\d+)\\s*$"
NUMBERED = "^(\\d+(?:\\.\\d+)*)\\s*(\\S.*)$"
STEP = "^(\\d+)\\.\\s+(\\S.*)$"
BULLET = "^\\s*[•▪◦·]\\s*(.*)$"
CAPTION = "^(?i)(Figure|Table)\\s+\\d+:\\s*(.*)$"
PROMPT = "^\\[[\\w.\\-]+@[\\w.\\-]+[^\\]]*\\]\\s*[#$]"
BARE_PROMPT = "^[#$]\\s+\\S"
OUTPUT_LIKE = "^(NAME\\s|READY\\s|STATUS\\s|/[\\w./*\\-]+\\s*$|\\{.*\\}\\s*$|\\S+=\\S+)"
COMMAND_WORDS = [
    "kubectl", "helm", "oc ", "docker", "podman", "systemctl", "journalctl",
    "netstat", "pstack", "openssl", "curl", "wget", "ssh", "scp", "tar",
    "cat ", "ls ", "cd ", "ps ", "grep ", "tail ", "head ", "awk ", "sed ",
    "jq ", "chmod", "chown", "mkdir", "rm ", "cp ", "mv ", "export ",
    "source ", "echo ", "kill ", "su ", "sudo ", "python", "sh ", "bash ",
    "./", "cnAdminTool", "cmm ", "vi ",
]
BROKEN_PAIRS = {
    "T elesys": "Telesys",
    "T eam": "Team",
    "T erminate": "Terminate",
    "T able": "Table",
    "T ool": "Tool",
    "T o ": "To ",
    "T he ": "The ",
    "T his ": "This ",
}
HEADER_LENGTH = 12
TITLE_PREFIX = 24
FULL_LINE = 60


# ---------------------------------------------------------------- lines


def fix_text(text: Column | str) -> Column:
    """Mend the known broken letter pairs, collapse blanks and tabs, trim."""
    value = mended = F.col(text) if isinstance(text, str) else text
    for wrong, right in BROKEN_PAIRS.items():
        mended = F.replace(mended, F.lit(wrong), F.lit(right))
    # Few texts have what all pairs begin with; a blank alone stays as it is.
    mended = F.when(F.contains(value, F.lit(os.path.commonprefix([*BROKEN_PAIRS]))), mended).otherwise(value)
    return strip(F.regexp_replace(mended, "[ \\t]{2,}|\\t", " "))


def _at_start(*patterns: str) -> str:
    """Any of the patterns, which all begin with ``^``: told once, else every place of a line is tried for each of them."""
    return "^(?:" + "|".join(pattern.removeprefix("^") for pattern in patterns) + ")"


# One expression for all signs of code, so that a line is scanned once.
CODE_LINE = _at_start(PROMPT, BARE_PROMPT, *(re.escape(word) for word in COMMAND_WORDS), OUTPUT_LIKE)


def _text_of(line: Column | str, stripped: bool) -> Column:
    """The trimmed line; callers that hold a trimmed column say so, as trimming is repeated per use."""
    return col_of(line) if stripped else strip(line)


def is_code(line: Column | str, stripped: bool = False) -> Column:
    """A shell prompt, a command word or something that looks like command output."""
    return _text_of(line, stripped).rlike(CODE_LINE)


def is_prose(line: Column | str, stripped: bool = False) -> Column:
    """At least 12 characters and 3 words, over 75% letters and blanks, a capital first."""
    text = _text_of(line, stripped)
    # Told by one match; listing all words of every line took most of the time.
    some, blank = f"[^{WHITESPACE_CLASS[1:]}", WHITESPACE_CLASS
    three_words = text.rlike(f"{some}{blank}+{some}+{blank}+{some}")
    letters = F.length(text) - F.length(F.regexp_replace(text, "[\\p{L} ]+", ""))
    return (
        (F.length(text) >= 12)
        & text.rlike("^\\p{Lu}")
        & ~text.rlike(_at_start(PROMPT, OUTPUT_LIKE))
        & three_words
        & (letters / F.length(text) > 0.75)
    )


def is_label(line: Column | str, stripped: bool = False) -> Column:
    """A short label of at most five words, letters and light punctuation, not all capitals."""
    text = _text_of(line, stripped)
    shouting = text.rlike("[A-Z]") & ~text.rlike("[a-z]")
    return text.rlike("^[A-Za-z][A-Za-z ,:'()\\-]*\\z") & ~shouting & (F.size(F.split(text, " +")) <= 5)


def classify_line(line: Column | str) -> Column:
    """``code``, ``prose``, ``label`` or ``other``."""
    return (
        F.when(is_code(line), "code").when(is_prose(line), "prose").when(is_label(line), "label").otherwise("other")
    )


# ---------------------------------------------------------------- repeated page parts


def page_counts(page_lines: DataFrame) -> DataFrame:
    """``(doc_id, pages)``."""
    return page_lines.select("doc_id", "page_no").distinct().groupBy("doc_id").agg(F.count("*").alias("pages"))


def furniture(page_lines: DataFrame, ratio: float = 0.5) -> DataFrame:
    """``(doc_id, line, pages_seen)``: trimmed lines on at least ``max(2, int(pages * ratio))`` pages."""
    seen = (
        page_lines.select("doc_id", "page_no", strip("line").alias("line"))
        .where("line <> ''")
        .distinct()
        .groupBy("doc_id", "line")
        .agg(F.count("*").alias("pages_seen"))
    )
    needed = F.greatest(F.lit(2), F.floor(F.col("pages") * F.lit(float(ratio))))
    return (
        seen.join(page_counts(page_lines), "doc_id").where(F.col("pages_seen") >= needed).select("doc_id", "line", "pages_seen")
    )


def running_header(page_lines: DataFrame, ratio: float = 0.5) -> DataFrame:
    """``(doc_id, header)``: first lines' common beginning, extended word by word while enough pages share it.

    Of two continuations the more frequent one is followed, at a tie the one that is seen first; for
    ratios from one half on, only a tie can leave two. Equal first lines are counted once before their
    prefixes are listed. Documents without a shared prefix of at least 12 characters are left out.
    """
    # Pages are counted where their first lines are found, blank ones too, so the lines are read once.
    first = F.min_by(strip("line"), F.when(nonblank("line"), F.col("line_no")))
    firsts = (
        page_lines.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id", "page_no")
        .agg(first.alias("_first"))
        .withColumn("pages", F.count("*").over(Window.partitionBy("doc_id")))
        .where(F.col("_first").isNotNull())
        .groupBy("doc_id", "pages", "_first")
        .agg(F.count("*").alias("_pages"), F.min("page_no").alias("_page"))
    )
    words = F.regexp_extract_all("_first", F.lit(f"[^{WHITESPACE_CLASS[1:]}+"), F.lit(0))
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size("_words")), lambda n: F.array_join(F.slice("_words", F.lit(1), n), " ")
    )
    counted = (
        firsts.withColumn("_words", words)
        .select("doc_id", "pages", "_pages", "_page", F.posexplode(prefixes).alias("_n", "header"))
        .groupBy("doc_id", "pages", "_n", "header")
        .agg(F.sum("_pages").alias("_seen"), F.min("_page").alias("_page"))
    )
    shared = counted.where(F.col("_seen") >= F.col("pages") * F.lit(float(ratio)))
    followed = shared.groupBy("doc_id", "_n").agg(F.max_by("header", F.struct("_seen", -F.col("_page"))).alias("header"))
    # The walk ends where the best prefix of a length does not extend the one before it.
    length = Window.partitionBy("doc_id").orderBy("_n")
    before = F.lag("header").over(length)
    followed = followed.withColumn("_on", before.isNull() | F.startswith("header", F.concat(before, F.lit(" "))))
    followed = followed.withColumn("_on", F.min("_on").over(length)).where("_on")
    return (
        followed.groupBy("doc_id")
        .agg(F.max_by("header", "_n").alias("header"))
        .where(F.length("header") >= HEADER_LENGTH)
    )


def toc_pages(page_lines: DataFrame) -> DataFrame:
    """``(doc_id, page_no)`` of pages with at least five dotted leader lines."""
    return (
        page_lines.groupBy("doc_id", "page_no")
        .agg(F.count_if(F.col("line").rlike(LEADER)).alias("_n"))
        .where(F.col("_n") >= TOC_LINES)
        .select("doc_id", "page_no")
    )


def parse_toc(page_lines: DataFrame) -> DataFrame:
    """``(doc_id, number, title)`` from the contents pages; the last entry of a number wins.

    A numbered line without a leader stays open and is glued to the line after it. A line that closes an
    entry, alone or glued, leaves nothing open, even if it could open one itself. Blank lines are skipped.
    A page is one bounded group, folded line by line.
    """
    rows = (
        page_lines.join(toc_pages(page_lines), ["doc_id", "page_no"], "left_semi")
        .select("doc_id", "page_no", "line_no", strip("line").alias("line"))
        .where("line <> ''")
    )
    pages = rows.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))

    def fold(state: Column, x: Column) -> Column:
        text = F.when(state["open"] == "", x["line"]).otherwise(F.concat(state["open"], F.lit(" "), x["line"]))
        closes = text.rlike(TOC_ENTRY)
        opens = x["line"].rlike(NUMBERED) & ~x["line"].rlike(LEADER)
        return F.struct(
            F.when(~closes & opens, x["line"]).otherwise(F.lit("")).alias("open"),
            F.when(closes, F.concat(state["done"], F.array(F.struct(x["line_no"].alias("line_no"), text.alias("text")))))
            .otherwise(state["done"]).alias("done"),
        )

    kind = rows.schema["line_no"].dataType.simpleString()
    start = F.struct(F.lit("").alias("open"), F.array().cast(f"array<struct<line_no:{kind},text:string>>").alias("done"))
    closed = pages.select("doc_id", "page_no", F.explode(F.aggregate("lines", start, fold)["done"]).alias("e"))
    return (
        closed.select(
            "doc_id",
            "page_no",
            F.col("e.line_no").alias("line_no"),
            F.regexp_extract("e.text", TOC_ENTRY, 1).alias("number"),
            fix_text(F.regexp_extract("e.text", TOC_ENTRY, 2)).alias("title"),
        )
        .groupBy("doc_id", "number")
        .agg(F.max_by("title", F.struct("page_no", "line_no")).alias("title"))
    )


def by_document(page_lines: DataFrame) -> DataFrame:
    """Lines that are not blank, dealt by document, with ``_strip``, the trimmed line.

    The text is shuffled here only: the marks below are windows within a document, which need no
    other deal, and what is told of documents and joined to it has a row for each document.
    """
    return page_lines.where(nonblank("line")).repartition("doc_id").withColumn("_strip", strip("line"))


def mark_contents(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`by_document` with ``_toc`` and ``_entry``: :func:`toc_pages` and :func:`parse_toc` line by line.

    ``_toc`` tells the lines of contents pages, ``_entry`` is the text of the entry a line closes. Whether a
    line finds another open hangs on the line before, so it is carried on from the last line that leaves
    the same behind in either case: lines that turn it over are counted from there.
    """
    order = Window.partitionBy("doc_id", "page_no").orderBy("line_no", "_strip")
    page = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("doc_id").isNotNull() & F.col("page_no").isNotNull()
    rows = rows.withColumns(
        {"_toc": known & (F.count_if(F.col("_strip").rlike(LEADER)).over(page) >= TOC_LINES), "_above": F.lag("_strip").over(order)}
    )
    text = F.col("_strip")
    glued = F.concat("_above", F.lit(" "), text)
    opens = text.rlike(NUMBERED) & ~text.rlike(LEADER)
    alone, both = text.rlike(TOC_ENTRY), F.coalesce(glued.rlike(TOC_ENTRY), text.rlike(TOC_ENTRY))
    # What a line leaves open after a closed and after an open one.
    rows = rows.withColumns({"_after_closed": F.col("_toc") & opens & ~alone, "_after_open": F.col("_toc") & opens & ~both})
    turns = (F.col("_after_closed") & ~F.col("_after_open")).cast("long")
    rows = rows.withColumn("_turns", F.sum(turns).over(so_far))
    same = F.when(
        F.col("_after_closed") == F.col("_after_open"),
        F.struct(F.col("_after_closed").cast("long").alias("open"), F.col("_turns").alias("turns")),
    )
    since = F.last(same, ignorenulls=True).over(before)
    rows = rows.withColumn("_since", since)
    turned = F.col("_turns") - turns - F.col("_since.turns")
    found_open = F.coalesce((F.col("_since.open") + turned) % 2 == 1, F.lit(False))
    whole = F.when(found_open, glued).otherwise(text)
    entry = F.when(F.col("_toc") & whole.rlike(TOC_ENTRY), whole)
    return rows.withColumn("_entry", entry).drop("_above", "_after_closed", "_after_open", "_turns", "_since")


def mark_body(rows: DataFrame, page_lines: DataFrame, ratio: float = 0.5) -> DataFrame:
    """``rows`` of :func:`by_document` with ``_body``, mended ``line`` and trimmed ``_text``: what :func:`clean_lines` keeps of ``page_lines``.

    Furniture is told within a document by a line's pages counted in a window; the pages of a document and its
    running header come from a row for each page.
    """
    by_page = Window.partitionBy("doc_id", "_strip").orderBy("page_no")
    rows = rows.withColumn("_nth", F.dense_rank().over(by_page))
    rows = rows.withColumn("_seen", F.max("_nth").over(Window.partitionBy("doc_id", "_strip")))
    told = page_counts(page_lines).join(running_header(page_lines, ratio), "doc_id", "left")
    needed = F.greatest(F.lit(2), F.floor(F.col("pages") * F.lit(float(ratio))))
    right_trimmed = F.rtrim(F.col("line"), F.lit(WHITESPACE))
    glued = F.regexp_replace(fix_text("line"), "^(\\d+)\\.\\s+(?=\\d)", "$1.")
    body = (
        ~F.col("_strip").rlike("^\\d{1,3}\\z")
        & (F.col("pages").isNull() | (F.col("_seen") < needed))
        & (F.col("header").isNull() | ~F.startswith("_strip", "header"))
    )
    return (
        rows.join(told, "doc_id", "left")
        .withColumns({"_body": body, "_code": is_code("_strip", True)})
        .withColumn("line", F.when(F.col("_code"), right_trimmed).otherwise(glued))
        # Mended lines are trimmed already, and what is left of code is its trimmed line.
        .withColumn("_text", F.when(F.col("_code"), F.col("_strip")).otherwise(F.col("line")))
        .drop("_nth", "_seen", "pages", "header", "_code")
    )


def clean_lines(page_lines: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Body lines: furniture, running headers, bare page numbers and blank lines are dropped.

    Code keeps its spacing; other lines are mended and split numbers such as ``2. 1`` glued.
    """
    rows = mark_body(by_document(page_lines), page_lines, ratio)
    return rows.where("_body").select("doc_id", "page_no", "line_no", "line")


# ---------------------------------------------------------------- Markdown


def markdown_blocks(page_lines: DataFrame, ratio: float = 0.5) -> DataFrame:
    """``(doc_id, block_no, kind, block)``: headings, captions, bullets, steps, code and paragraphs.

    Lines before and on contents pages are dropped. A document is the unit of order, so windows
    run per document; block numbers are gaps-and-islands sums.
    """
    start = toc_pages(page_lines).groupBy("doc_id").agg(F.min("page_no").alias("_start"))
    marked = mark_body(mark_contents(by_document(page_lines)), page_lines, ratio).join(start, "doc_id", "left")
    listed = F.col("_entry").isNotNull()
    body = F.col("_body") & ~F.col("_toc") & (F.col("_start").isNull() | (F.col("page_no") >= F.col("_start")))
    # Entries meet the lines of their number; the last entry of a number wins.
    title = F.when(listed, fix_text(F.regexp_extract("_entry", TOC_ENTRY, 2)))
    at = F.when(listed, F.struct("page_no", "line_no"))
    number = F.when(listed, F.regexp_extract("_entry", TOC_ENTRY, 1)).otherwise(F.regexp_extract("_text", NUMBERED, 1))
    lines = (
        marked.where(listed | body)
        .select("doc_id", "page_no", "line_no", "line", "_text", number.alias("_number"), title.alias("_titled"), at.alias("_at"))
        .withColumn("_title", F.max_by("_titled", "_at").over(Window.partitionBy("doc_id", "_number")))
        .where(F.col("_at").isNull())
        .drop("_titled", "_at")
    )
    rest = F.lower(strip(F.regexp_extract("_text", NUMBERED, 2)))
    heading = F.when(
        F.coalesce(F.col("_title") != "", F.lit(False)), F.startswith(rest, F.lower(F.left("_title", F.lit(TITLE_PREFIX))))
    ).otherwise(F.lit(False))
    step = F.col("_text").rlike(STEP) & is_prose(F.regexp_extract("_text", STEP, 2), True)
    fixed = (
        F.when(heading, "heading")
        .when(F.col("_text").rlike(CAPTION), "caption")
        .when(F.col("_text").rlike(BULLET), "bullet")
        .when(step, "step")
        .when(is_code("_text", True), "code")
        .when(is_prose("_text", True) | is_label("_text", True), "prose")
    )
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A line of no kind of its own stays inside code that is open, else it is prose.
    carried = F.last("_fixed", ignorenulls=True).over(so_far)
    kind = F.coalesce("_fixed", F.when(carried == "code", "code").otherwise("prose"))
    typed = lines.withColumn("_fixed", fixed).withColumn("kind", kind)
    typed = typed.withColumns(
        {"_before": F.lag("kind").over(order), "_last": F.lag(F.col("line")).over(order), "_last_text": F.lag("_text").over(order)}
    )
    ended = F.col("_last_text").rlike("[.:;!?]\\z")
    wrapped = ~ended & (F.length("_last_text") >= FULL_LINE)
    continues = wrapped | F.col("_text").rlike("^\\p{Ll}") | F.col("_last_text").rlike("[,\\-、]\\z")
    same_code = (F.col("kind") == "code") & (F.col("_before") == "code")
    same_prose = (F.col("kind") == "prose") & (F.col("_before") == "prose") & continues
    opens = ~F.coalesce(same_code | same_prose, F.lit(False))
    glue = same_code & F.endswith("_last", F.lit("-")) & ~F.col("_text").rlike("\\s")
    piece = F.when(F.coalesce(glue, F.lit(False)), F.col("_text")).when(F.col("kind") == "code", F.col("line")).otherwise(F.col("_text"))
    joiner = F.when(opens | F.coalesce(glue, F.lit(False)), "").when(F.col("kind") == "code", "\n").otherwise(" ")
    numbered = typed.withColumns(
        {"block_no": F.sum(opens.cast("long")).over(so_far), "_piece": F.concat(joiner, piece)}
    )
    level = F.least(F.lit(6), F.length("_n") - F.length(F.replace("_n", F.lit("."), F.lit(""))) + 2)
    body = F.array_join(F.col("_rows")["_piece"], "")
    shaped = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "_n", F.lit(" "), "_t"))
        .when(F.col("kind") == "caption", F.concat(F.lit("*"), body, F.lit("*")))
        .when(F.col("kind") == "bullet", F.concat(F.lit("- "), fix_text(F.regexp_extract(body, BULLET, 1))))
        .when(
            F.col("kind") == "step",
            F.concat(F.regexp_extract(body, STEP, 1), F.lit(". "), F.regexp_extract(body, STEP, 2)),
        )
        .when(F.col("kind") == "code", F.concat(F.lit("```\n"), body, F.lit("\n```")))
        .otherwise(body)
    )
    return (
        numbered.groupBy("doc_id", "block_no")
        .agg(
            F.first("kind").alias("kind"),
            F.max("_number").alias("_n"),
            F.max("_title").alias("_t"),
            F.array_sort(F.collect_list(F.struct("page_no", "line_no", "_piece"))).alias("_rows"),
        )
        .select("doc_id", "block_no", "kind", shaped.alias("block"))
    )


def assemble_markdown(page_lines: DataFrame, titles: DataFrame, ratio: float = 0.5) -> DataFrame:
    """``(doc_id, markdown)``: the title and all blocks separated by blank lines."""
    blocks = markdown_blocks(page_lines, ratio)
    bodies = (
        blocks.groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("block_no", "block"))).alias("_rows"))
        .select("doc_id", F.array_join(F.col("_rows")["block"], "\n\n").alias("_body"))
    )
    return titles.join(bodies, "doc_id", "left").select(
        "doc_id", F.concat(F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), "_body"), F.lit("\n")).alias("markdown")
    )
