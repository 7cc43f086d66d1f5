"""Packing, lookups and conversations on inline rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions.literals import match_literals
from folioscope.operators import chunking as C
from folioscope.operators import context as K
from folioscope.operators import dialogue as D
from folioscope.plans import tools

HISTORY = "array<struct<role:string,content:string>>"


def estimate(text):
    han = sum("一" <= c <= "鿿" for c in text)
    return han + math.ceil((len(text) - han) / 4)


def test_tokens_and_truncation(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab 超时，é😀", k=rng.randint(0, 80))) for _ in range(80)] + ["", "x" * 50]
    for budget in (0, 1, 7, 15):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        rows = df.select("t", X.estimate_tokens("t").alias("n"), X.truncate_tokens("t", budget).alias("cut")).collect()
        for r in rows:
            assert r.n == estimate(r.t)
            longest = max((i for i in range(len(r.t) + 1) if estimate(r.t[:i]) <= budget), default=0)
            assert r.cut == (r.t[:longest] if budget > 0 else "")


def test_pack_first_over_budget(spark):
    rows = [("q", 1, "d", "h", "超" * 50), ("q", 2, "d", "h", "x"), ("r", 1, "d", "h", "abcd"), ("r", 2, "d", "h", "超" * 90), ("r", 3, "d", "h", "y")]
    df = spark.createDataFrame(rows, "query_id string, rank int, source string, heading string, content string")
    label = estimate("文档: d ｜ 章节: h") + 1
    got = {(r.query_id, r.rank): (r.content, r.truncated) for r in K.pack_contexts(df, label + 20).collect()}
    assert got == {("q", 1): ("超" * 20, True), ("r", 1): ("abcd", True)}
    assert K.pack_contexts(df.where("query_id = 'q'"), label).count() == 0


def test_stitch_restores_the_section(spark):
    rng = random.Random(6)
    body = "\n\n".join("".join(rng.choices("abcdefgh ", k=rng.randint(5, 60))).strip() or "x" for _ in range(30))
    chunks = C.chunk_documents(spark.createDataFrame([("a.md", "# T\n" + body)], "source string, content string"), 120, 20)
    whole = K.stitch_section(chunks, 20).first()
    assert whole.chunks > 5
    assert "".join(whole.body.split()) == "".join(body.split())


@pytest.mark.parametrize("plain,block", [(64, 1000), (0, 1000), (2, 3)])
def test_literals_with_regex_characters(spark, plain, block):
    texts = spark.createDataFrame([(1, "a.b (c) [d] 超时设置"), (2, "axb c"), (3, None)], "id long, t string")
    patterns = spark.createDataFrame([("a.b",), ("(c)",), ("[d]",), ("超时",), ("B",), ("c",), ("",), (None,)], "pattern string")
    got = sorted((r.id, r.pattern) for r in match_literals(texts, "t", patterns, block=block, plain=plain).collect())
    assert got == sorted([(1, "a.b"), (1, "(c)"), (1, "[d]"), (1, "超时"), (1, "c"), (2, "c")])


def test_expand_section_states(spark):
    chunks = spark.createDataFrame(
        [("a.md", 0, "Conf", "one"), ("a.md", 1, "Conf › Timeouts", "two"), ("a.md", 2, "Conf › Timeouts", "three"), ("b.md", 0, "", "plain")],
        "source string, chunk_index int, heading string, content string",
    )
    asked = spark.createDataFrame(
        [(1, "a.md", "Conf"), (2, "a.md", "timeouts"), (3, "a.md", "zzz"), (4, "x.md", "Conf"), (5, "b.md", ""), (6, " a.md ", " Conf ")],
        "request_id long, source string, heading string",
    )
    got = {r.request_id: (r.status, r.body, r.hint) for r in K.expand_section(asked, chunks, 10).collect()}
    assert got == {
        1: ("exact", "one", None),
        2: ("partial", "two\nthree", None),
        3: ("no_section", None, "Conf、Conf › Timeouts"),
        4: ("no_document", None, "a.md、b.md"),
        5: ("no_section", None, None),
        6: ("exact", "one", None),
    }
    # A stored index gives the same; so do repeated requests, and no request at all.
    index = K.heading_index(chunks)
    again = K.expand_section(asked.unionByName(asked.withColumn("request_id", F.col("request_id") + 10)), chunks, 10, index).collect()
    assert {r.request_id: (r.status, r.body, r.hint) for r in again} == {**got, **{k + 10: v for k, v in got.items()}}
    assert K.expand_section(asked.limit(0), chunks, 10).count() == 0
    assert {(r.source, r.heading): (r.first, r.last, r.chunks) for r in index.collect()}["a.md", "Conf › Timeouts"] == (1, 2, 2)


def test_literals_share_one_match_table(spark):
    """Many requests of one pattern, places stored twice, limits, scopes and hints."""
    rows = [("a.md", i, "h", f"needle {i}") for i in range(5)] + [("b.md", 0, "h", "needle twice"), ("b.md", 0, "h2", "needle twice"), ("c.md", 0, "h", None)]
    chunks = spark.createDataFrame(rows, "source string, chunk_index int, heading string, content string")
    asked = [(i, "needle", None) for i in range(20)] + [(30, "needle", "b.md"), (31, "needle", "x.md"), (32, "needle", "c.md"), (33, " ", "a.md"), (34, "3", ""), (35, "gone", None)]
    requests = spark.createDataFrame(asked, "request_id long, pattern string, source string")
    got = {}
    for r in K.find_literal(requests, chunks, 6).collect():
        got.setdefault(r.request_id, []).append((r["rank"], r.source, r.chunk_index, r.heading, r.content, r.total))
    first = [(i + 1, "a.md", i, "h", f"needle {i}", 7) for i in range(5)]
    for i in range(20):
        assert sorted(got[i])[:5] == first and sorted(got[i])[5][:3] == (6, "b.md", 0) and len(got[i]) == 6
    assert sorted(got[30]) == [(1, "b.md", 0, "h", "needle twice", 2), (2, "b.md", 0, "h2", "needle twice", 2)]
    assert [x[:3] for x in got[34]] == [(1, "a.md", 3)] and set(got) == {*range(20), 30, 33, 34}
    status = {r.request_id: (r.status, r.total, r.shown, r.hint) for r in K.literal_lookup(requests, chunks, 6).collect()}
    assert status[0] == ("ok", 7, 6, None) and status[30] == ("ok", 2, 2, None) and status[31] == ("no_document", 0, 0, "a.md、b.md、c.md")
    assert status[32][0] == status[35][0] == "empty" and status[33][0] == "blank" and len(status) == len(asked)


def test_prompt_without_hits(spark):
    q = spark.createDataFrame(
        [(1, "q", [("system", "bad"), ("user", "u"), ("assistant", "")])], f"query_id long, question string, history {HISTORY}"
    )
    hits = spark.createDataFrame([], "query_id long, rank int, source string, heading string, content string")
    messages = K.build_prompts(q, hits).first().messages
    assert [m.role for m in messages] == ["system", "user", "user"]
    assert messages[0].content == K.SYSTEM_BASE + "\n\n" + K.SYSTEM_NO_HITS


def ask(spark, rows, *columns):
    df = spark.createDataFrame(rows, f"question string, history {HISTORY}")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_history_rules(spark):
    past = [("user", "a"), ("assistant", "b"), ("system", "c")]
    rows = [("一个很长很长很长很长的问题没有指代", past), ("短问题", past[:2]), ("关于它的默认超时时间设置在哪里可以看到呢", past[:2]), ("短", None)]
    got = ask(spark, rows, F.size(D.sanitize_history("history", 2)), D.has_history("history"), D.needs_rewrite("question", "history"))
    # Only the last message decides whether there is history.
    assert got == [(1, False, False), (2, True, True), (2, True, True), (0, False, False)]
    assert ask(spark, rows[1:2], D.needs_rewrite("question", "history", patterns="^x, 短$"))[0][0] is False
    assert ask(spark, rows[1:2], D.format_history("history")) == [("用户：a\n助手：b",)]


@pytest.mark.parametrize("mode,enabled,want", [("off", True, ["no_history", "disabled"]), ("conditional", False, ["disabled", "disabled"]), ("conditional", True, ["no_history", "heuristic_not_matched"])])
def test_skip_reasons(spark, mode, enabled, want):
    long = "a long question that stands for itself"
    q = spark.createDataFrame([(1, long, []), (2, long, [("user", "x")])], f"query_id long, question string, history {HISTORY}")
    none = spark.createDataFrame([], "query_id long, rewritten string")
    rows = D.resolve_search_query(q, none, mode, enabled).orderBy("query_id").collect()
    assert [r.rewrite_skipped_reason for r in rows] == want
    assert all(r.search_query == long and not r.rewrite_applied for r in rows)


def test_rewrite_cleaning(spark):
    cases = {'"x"': "x", "「x」": "「x」", "「x「": "x", "改写后的问题：问题: y": "y", '"问题：z"': "z", "  ": "q", '"': '"', None: "q", "问题：": "q"}
    df = spark.createDataFrame([(k, "q") for k in cases], "raw string, q string")
    assert {r.raw: r.x for r in df.select("raw", D.normalize_rewrite("raw", "q").alias("x")).collect()} == cases


def test_compaction_never_opens_with_a_tool(spark):
    roles = ["user", "assistant", "tool", "assistant", "tool", "assistant", "user", "assistant", "tool", "assistant"]
    df = spark.createDataFrame([(1, i, r) for i, r in enumerate(roles)], "conv_id long, turn long, role string")
    folded = [r.turn for r in D.compaction_plan(df, 10, 8).where("folded").orderBy("turn").collect()]
    assert folded == [0, 1, 2]
    assert D.compaction_plan(df, 11, 8).where("folded").count() == 0


def test_reasoning_and_verdicts(spark):
    rows = [(1, 0, "token", "a<th"), (1, 1, "token", "ink>why</thi"), (1, 2, "token", "nk>b<think>open"), (2, 0, "reasoning", "r"), (2, 1, "token", "t<thi")]
    df = spark.createDataFrame(rows, "trace_id long, seq long, type string, content string")
    got = {r.trace_id: (r.answer, r.reasoning) for r in D.split_reasoning(df).collect()}
    assert got == {1: ("ab", "whyopen"), 2: ("t<thi", "r")}
    texts = ["是", "不是否", "<think>否</think>是的", "可能", "好好好好是", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(D.parse_yes_no("t")).collect()] == [True, False, True, None, None, None]


def test_a_heading_over_the_budget_leaves_an_empty_body(spark):
    """The section is found and cut to nothing; it is not a section without a body."""
    title = "w" * 4 * K.EXPAND_TOKENS
    chunks = spark.createDataFrame([("a.md", 0, title, "body"), ("b.md", 0, "h", "body")], "source string, chunk_index int, heading string, content string")
    asked = spark.createDataFrame([(1, "a.md", title), (2, "b.md", "h"), (3, "c.md", "h")], "request_id long, source string, heading string")
    got = {r.request_id: (r.status, r.chunks, r.body, r.truncated) for r in tools.expand_section(asked, chunks).collect()}
    assert got == {1: ("exact", 1, "", True), 2: ("exact", 1, "body", False), 3: ("no_document", 0, None, None)}
