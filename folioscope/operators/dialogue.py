"""Conversation histories, rewriting decisions, answers and refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.order import ordered_concat
from folioscope.functions.text import contains_any, strip, strip_think
from folioscope.operators.evaluation import REFUSAL_MARKERS
from folioscope.operators.retrieval import top_ranked

# Roles, labels, patterns and limits the decisions are defined by.
ROLES = ["user", "assistant"]
SPEAKER = {"user": "用户：", "other": "助手："}
REFERRING_PATTERNS = ["它", "这个", "那个", "这[个些]", "那[个些]", "刚才", "上面", "前面", "还有", "继续", "同样", "也是"]
TRIGGER_MAX_LEN = 12
QUOTES = "\"'「」"
REWRITE_LABELS = ["改写后的问题：", "改写后的问题:", "问题：", "问题:"]
REFUSAL_PATTERN = (
    "(没有|未|并未|无)(检索到|找到|提及|提到|涉及|包含|给出|说明|记载|相关|关于)"
    "|无法(回答|根据|从|提供)|不足以回答|知识库中没有|资料中没有|文档中没有"
)
REFUSAL_WINDOW = 150
YES, NO = "是", "否"
SUMMARY_TRIGGER = 20
SUMMARY_KEEP = 8
NO_MESSAGES = "array<struct<role:string,content:string>>"


def _valid(role: Column, content: Column) -> Column:
    return F.coalesce(role.isin(ROLES) & (content != ""), F.lit(False))


def sanitize_history(history: Column | str, limit: int) -> Column:
    """The last ``limit`` messages, of those only user and assistant ones with content."""
    value = F.col(history) if isinstance(history, str) else history
    if limit <= 0:
        return F.array().cast(NO_MESSAGES)
    size = F.size(value)
    last = F.slice(value, F.greatest(size - limit + 1, F.lit(1)), F.lit(limit))
    kept = F.filter(last, lambda m: _valid(m["role"], m["content"]))
    return F.when(value.isNull() | (size == 0), F.array().cast(NO_MESSAGES)).otherwise(kept)


def sanitize_turns(turns: DataFrame, limit: int) -> DataFrame:
    """The same rule on rows ``(conv_id, turn, role, text)``; trimmed per task before the shuffle."""
    last = top_ranked(turns, limit, [F.desc("turn")], by=("conv_id",)).drop("rank")
    return last.where(_valid(F.col("role"), F.col("text")))


def format_history(history: Column | str) -> Column:
    """One labelled line per message."""
    value = F.col(history) if isinstance(history, str) else history
    lines = F.transform(
        value,
        lambda m: F.concat(F.when(m["role"] == "user", SPEAKER["user"]).otherwise(SPEAKER["other"]), m["content"]),
    )
    return F.array_join(lines, "\n")


def collect_history(turns: DataFrame, limit: int) -> DataFrame:
    """``(conv_id, history)`` with the last ``limit`` messages of a conversation, valid ones only."""
    return (
        sanitize_turns(turns, limit)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("_rows"))
        .select("conv_id", F.transform("_rows", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history"))
    )


def has_history(history: Column | str) -> Column:
    """Whether history counts as present: only the last message decides."""
    return F.size(sanitize_history(history, 1)) > 0


def needs_rewrite(
    question: Column | str,
    history: Column | str,
    mode: str = "conditional",
    enabled: bool = True,
    patterns: str = "",
    max_len: int = TRIGGER_MAX_LEN,
) -> Column:
    """Whether a question depends on its history.

    ``patterns`` is a comma-separated list of regular expressions that replaces the length and
    reference-word rules.
    """
    if not enabled or mode.lower() == "off":
        return F.lit(False)
    present = has_history(history)
    if mode.lower() == "always":
        return present
    asked = strip(question)
    custom = [p.strip() for p in patterns.split(",") if p.strip()]
    if custom:
        hit = F.lit(False)
        for pattern in custom:
            hit = hit | asked.rlike(pattern)
    else:
        hit = (F.length(asked) <= max(1, max_len)) | asked.rlike("|".join(REFERRING_PATTERNS))
    return present & hit


def normalize_rewrite(raw: Column | str, fallback: Column | str) -> Column:
    """Clean a model's rewrite: trim, drop equal quotes, drop label prefixes, else the fallback."""
    text = strip(F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit("")))
    other = F.col(fallback) if isinstance(fallback, str) else fallback
    first = F.left(text, F.lit(1))
    quoted = (F.length(text) >= 2) & (first == F.right(text, F.lit(1))) & F.contains(F.lit(QUOTES), first)
    text = F.when(quoted, strip(F.substr(text, F.lit(2), F.length(text) - 2))).otherwise(text)
    for label in REWRITE_LABELS:
        text = F.when(F.startswith(text, F.lit(label)), strip(F.substr(text, F.lit(len(label) + 1)))).otherwise(text)
    return F.coalesce(F.nullif(text, F.lit("")), other)


def resolve_search_query(queries: DataFrame, rewrites: DataFrame, mode: str = "conditional", enabled: bool = True, **options) -> DataFrame:
    """The text that is searched, whether it was rewritten, and why not.

    ``queries(query_id, question, history)``; ``rewrites(query_id, rewritten)`` holds what a model
    returned. A question that needed a rewrite but has none keeps its own text.
    """
    original = strip("question")
    needed = needs_rewrite("question", "history", mode, enabled, **options)
    if not enabled:
        reason = F.lit("disabled")
    else:
        matched = "disabled" if mode.lower() == "off" else "heuristic_not_matched"
        reason = F.when(has_history("history"), matched).otherwise("no_history")
    return (
        queries.withColumn("_needed", needed)
        .join(rewrites.select("query_id", "rewritten"), "query_id", "left")
        .select(
            "query_id",
            original.alias("original_question"),
            F.when(F.col("_needed"), normalize_rewrite("rewritten", original)).otherwise(original).alias("search_query"),
            F.col("_needed").alias("rewrite_applied"),
            F.when(~F.col("_needed"), reason).alias("rewrite_skipped_reason"),
        )
    )


def compaction_plan(messages: DataFrame, trigger: int = SUMMARY_TRIGGER, keep: int = SUMMARY_KEEP) -> DataFrame:
    """Which turns fold into a summary: ``(conv_id, turn, role, folded)``.

    Only conversations with at least ``trigger`` messages fold, and the last ``keep`` stay. The
    kept part never starts with a tool message, so a call and its answer are not parted; the cut
    then moves forward. The cut is found from the last rows of each conversation only.
    """
    trigger, keep = max(4, int(trigger)), max(2, int(keep))
    counts = messages.groupBy("conv_id").agg(F.count("*").alias("_n"), F.max("turn").alias("_last"))
    last = top_ranked(messages, keep, [F.desc("turn")], by=("conv_id",))
    cut = last.groupBy("conv_id").agg(F.min(F.when(F.col("role") != "tool", F.col("turn"))).alias("_cut"))
    plan = counts.join(cut, "conv_id").select(
        "conv_id",
        F.when(F.col("_n") >= trigger, F.coalesce("_cut", F.col("_last") + 1)).alias("_cut"),
    )
    return messages.join(plan, "conv_id").select(
        "conv_id", "turn", "role", F.coalesce(F.col("turn") < F.col("_cut"), F.lit(False)).alias("folded")
    )


def split_reasoning(fragments: DataFrame) -> DataFrame:
    """``(trace_id, answer, reasoning)`` from ordered fragments ``(trace_id, seq, type, content)``.

    Text between ``<think>`` and ``</think>`` is reasoning even when a tag is split over
    fragments; unclosed text belongs to the side it is on. Fragments of type ``reasoning`` come
    from a separate field and precede what the tags hold.
    """
    kinds = fragments.withColumn("_own", F.col("type") == "reasoning")
    joined = ordered_concat(kinds, ["trace_id", "_own"], "seq", "content")
    sides = joined.groupBy("trace_id").agg(
        F.max(F.when(~F.col("_own"), F.col("content"))).alias("_text"),
        F.max(F.when(F.col("_own"), F.col("content"))).alias("_field"),
    )
    text = F.coalesce("_text", F.lit(""))
    block = "(?s)<think>(.*?)(?:</think>|\\z)"
    inside = F.array_join(F.regexp_extract_all(text, F.lit(block), F.lit(1)), "")
    return sides.select(
        "trace_id",
        F.regexp_replace(text, block, "").alias("answer"),
        F.concat(F.coalesce("_field", F.lit("")), inside).alias("reasoning"),
    )


def assemble_answer(events: DataFrame) -> DataFrame:
    """``(trace_id, answer)``: the tokens after the last reset, in order.

    ``events(trace_id, seq, type, content)``; the last reset is found by a pre-aggregated maximum.
    """
    resets = events.groupBy("trace_id").agg(F.max(F.when(F.col("type") == "reset", F.col("seq"))).alias("_reset"))
    tokens = (
        events.where(F.col("type") == "token")
        .join(resets, "trace_id")
        .where(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset")))
        .select("trace_id", "seq", F.col("content").alias("answer"))
    )
    answers = ordered_concat(tokens, ["trace_id"], "seq", "answer")
    return resets.select("trace_id").join(answers, "trace_id", "left").select(
        "trace_id", F.coalesce("answer", F.lit("")).alias("answer")
    )


def is_refusal(answer: Column | str) -> Column:
    """Refusal by the pattern in the first 150 characters outside reasoning blocks."""
    value = F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit(""))
    return F.left(strip(strip_think(value)), F.lit(REFUSAL_WINDOW)).rlike(REFUSAL_PATTERN)


def has_refusal_marker(answer: Column | str) -> Column:
    """Refusal by any of the fixed markers anywhere in the text."""
    return contains_any(answer, REFUSAL_MARKERS)


def parse_yes_no(reply: Column | str) -> Column:
    """True, false or NULL from the first four characters outside reasoning blocks."""
    value = F.coalesce(F.col(reply) if isinstance(reply, str) else reply, F.lit(""))
    head = F.left(strip(strip_think(value)), F.lit(4))
    no = F.contains(head, F.lit(NO))
    return F.when(F.contains(head, F.lit(YES)) & ~no, F.lit(True)).when(no, F.lit(False))


def conversation_state(turns: DataFrame, trigger: int = SUMMARY_TRIGGER, keep: int = SUMMARY_KEEP) -> DataFrame:
    """What the next turn of a conversation starts from.

    ``messages``: the restored history, all of it under ``trigger`` messages and the last ``keep``
    above; ``folded``: how many older messages a summary stands for. At most ``trigger`` messages
    per conversation are ever gathered.
    """
    trigger, keep = max(4, int(trigger)), max(2, int(keep))
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("total"))
    last = (
        top_ranked(turns, trigger, [F.desc("turn")], by=("conv_id",))
        .join(counts, "conv_id")
        .where((F.col("total") < trigger) | (F.col("rank") <= keep))
    )
    return (
        last.groupBy("conv_id", "total")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("_rows"))
        .select(
            "conv_id",
            "total",
            F.transform("_rows", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"),
            (F.col("total") - F.size("_rows")).alias("folded"),
        )
    )


def turn_inputs(turns: DataFrame, sessions: DataFrame, given: DataFrame) -> DataFrame:
    """``(query_id, history)``: the session's state when a session is named, else the given history.

    ``turns(query_id, session_id)``, ``sessions(session_id, messages)``, ``given(query_id, history)``.
    """
    kept = F.filter("history", lambda m: m["role"].isin(ROLES))
    return (
        turns.join(sessions.select("session_id", "messages"), "session_id", "left")
        .join(given, "query_id", "left")
        .select(
            "query_id",
            F.coalesce(
                F.when(F.coalesce("session_id", F.lit("")) != "", F.col("messages")).otherwise(kept),
                F.array().cast(NO_MESSAGES),
            ).alias("history"),
        )
    )
