"""Whether a line has three words is told by one match, with the same answers as counting them."""

from __future__ import annotations

import re

from folioscope.functions.text import WHITESPACE
from folioscope.operators.pagetext import is_prose

ROWS = ["Averylongword another", "Averylongword another one", "A  b   cdefghijkl", "Onewordonlyhere", "Twowords and three", "Averylongword another ", "Eins zwei\xa0dreivier"]


def test_prose_has_three_words(spark):
    lines = spark.createDataFrame(list(enumerate(ROWS)), "i int, t string")
    got = [r[0] for r in lines.orderBy("i").select(is_prose("t", True)).collect()]
    long = [len([w for w in re.split(f"[{WHITESPACE}]+", t) if w]) >= 3 for t in ROWS]
    letters = [sum(c.isalpha() or c == " " for c in t) / len(t) > 0.75 for t in ROWS]
    assert got == [a and b for a, b in zip(long, letters, strict=True)]


def test_words_are_not_listed(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(is_prose("t", True))._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract_all" not in plan
