"""Text expressions built from Spark functions; every one takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the results are defined on.
HAN = "\\u4e00-\\u9fff"
KANA = "\\u3040-\\u30ff"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
PATH_SEPARATOR = " › "


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Remove every kind of Unicode white space at both ends, not only blanks."""
    return F.btrim(col_of(text), F.lit(WHITESPACE))


def nonblank(text: Column | str) -> Column:
    """True when something is left after :func:`strip`; false for NULL."""
    return F.coalesce(strip(text) != "", F.lit(False))


def tokenize_bigram(text: Column | str) -> Column:
    """Lower-cased words; a segment holding any Han character becomes character bigrams."""
    lowered = F.lower(col_of(text))
    segments = F.regexp_extract_all(lowered, F.lit(f"[{HAN}{KANA}a-zA-Z0-9]+"), F.lit(0))

    def pieces(segment: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(1), F.length(segment) - 1), lambda i: F.substr(segment, i, F.lit(2))
        )
        is_run = segment.rlike(f"[{HAN}]") & (F.length(segment) > 1)
        return F.when(is_run, pairs).otherwise(F.array(segment))

    # Text without Han characters skips the nested arrays altogether.
    return F.when(lowered.rlike(f"[{HAN}]"), F.flatten(F.transform(segments, pieces))).otherwise(segments)


def estimate_tokens(text: Column | str) -> Column:
    """One token per Han character plus one per started group of four other characters."""
    value = F.coalesce(col_of(text), F.lit(""))
    other = F.length(F.regexp_replace(value, f"[{HAN}]", ""))
    return (F.length(value) - other + F.floor((other + 3) / 4)).cast("long")


def truncate_tokens(text: Column | str, budget: Column | int) -> Column:
    """The longest prefix whose :func:`estimate_tokens` is at most ``budget``."""
    value = col_of(text)
    limit = F.lit(budget) if isinstance(budget, int) else budget
    longest = F.least(F.length(value), (limit * 4).cast("int"))

    def narrow(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        fits = estimate_tokens(F.substr(value, F.lit(1), middle)) <= limit
        return F.struct(
            F.when(fits, middle).otherwise(state["low"]).alias("low"),
            F.when(fits, state["high"]).otherwise(middle).alias("high"),
        )

    # The estimate never falls as the prefix grows, so bisection finds the cut; 33 halvings
    # cover any string length and idle once low and high meet.
    start = F.struct(F.lit(0).alias("low"), (longest + 1).cast("int").alias("high"))
    mixed = F.aggregate(
        F.sequence(F.lit(1), F.lit(33)),
        start,
        lambda s, i: F.when(s["high"] - s["low"] <= 1, s).otherwise(narrow(s, i)),
        lambda s: F.substr(value, F.lit(1), s["low"]),
    )
    plain = F.substr(value, F.lit(1), longest)
    return (
        F.when(limit <= 0, F.lit(""))
        .when(estimate_tokens(value) <= limit, value)
        .when(value.rlike(f"[{HAN}]"), mixed)
        .otherwise(plain)
    )


def strip_think(text: Column | str) -> Column:
    """Drop closed reasoning blocks."""
    return F.regexp_replace(col_of(text), "(?s)<think>.*?</think>", "")


def citation(source: Column | str, heading: Column | str) -> Column:
    """``source › heading``, or the source alone."""
    src, head = col_of(source), col_of(heading)
    return F.when(F.coalesce(head, F.lit("")) != "", F.concat(src, F.lit(PATH_SEPARATOR), head)).otherwise(src)


def with_heading(heading: Column | str, content: Column | str) -> Column:
    """Heading and body on two lines: the text that is embedded and indexed."""
    head, body = col_of(heading), col_of(content)
    return F.when(F.coalesce(head, F.lit("")) != "", F.concat(head, F.lit("\n"), body)).otherwise(body)


def uuid_of(text: Column) -> Column:
    """MD5 of a text written as a UUID."""
    return F.regexp_replace(
        F.md5(text.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def contains_any(text: Column | str, words: list[str]) -> Column:
    """True when any of a fixed list of words occurs in the text."""
    value = col_of(text)
    result = F.lit(False)
    for word in words:
        result = result | value.contains(word)
    return result


def overlap_length(left: Column | str, right: Column | str, limit: int) -> Column:
    """Longest suffix of ``left`` that is a prefix of ``right``, at most ``limit`` characters."""
    a, b = F.coalesce(col_of(left), F.lit("")), F.coalesce(col_of(right), F.lit(""))
    longest = F.least(F.lit(limit), F.length(a), F.length(b))
    sizes = F.when(longest >= 1, F.sequence(F.lit(1), longest)).otherwise(F.array().cast("array<int>"))
    equal = F.filter(sizes, lambda n: F.right(a, n) == F.left(b, n))
    return F.coalesce(F.array_max(equal), F.lit(0))


def label_line(source: Column | str, heading: Column | str) -> Column:
    """The locator line shown above a context."""
    # The wording of the locator.
    head = F.coalesce(F.nullif(col_of(heading), F.lit("")), F.lit("（无标题正文）"))
    return F.concat(F.lit("文档: "), col_of(source), F.lit(" ｜ 章节: "), head)
