"""Keyed state over streams: conversations and answers."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType

from folioscope.operators.dialogue import SUMMARY_KEEP, SUMMARY_TRIGGER
from folioscope.streaming.flows import FAILURE_RUN, failure_runs

STATE = "payload string"
IDLE_MS = 24 * 3600 * 1000


def _timeout(idle_ms: int | None) -> str:
    """A clock timeout keeps a query alive for good, so a run to the end of the input uses none."""
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout


def stream_conversations(turns: DataFrame, trigger: int = SUMMARY_TRIGGER, keep: int = SUMMARY_KEEP, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """``(conv_id, total, folded, messages)`` after every batch that adds turns.

    State holds the count and at most ``trigger`` latest messages; older ones are only counted,
    as a summary stands for them. A session without turns for ``idle_ms`` is forgotten.
    ``messages`` is a JSON list.
    """
    trigger, keep = max(4, int(trigger)), max(2, int(keep))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, latest = json.loads(state.get[0]) if state.exists else (0, [])
        for frame in frames:
            total += len(frame)
            rows = [[int(t), r, c] for t, r, c in zip(frame["turn"], frame["role"], frame["text"])]
            latest = heapq.nlargest(trigger, latest + rows, key=lambda m: m[0])
        state.update((json.dumps([total, latest], ensure_ascii=False),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        shown = sorted(latest if total < trigger else latest[:keep], key=lambda m: m[0])
        messages = json.dumps([{"role": r, "content": c} for _, r, c in shown], ensure_ascii=False)
        yield pd.DataFrame(
            {"conv_id": [key[0]], "total": [total], "folded": [total - len(shown)], "messages": [messages]}
        )

    return (
        turns.select("conv_id", "turn", "role", "text")
        .groupBy("conv_id")
        .applyInPandasWithState(
            update,
            "conv_id long, total long, folded long, messages string",
            STATE,
            "append",
            _timeout(idle_ms),
        )
    )


RUN_STATE = "run long, done_us long, held_us array<long>, held_id array<{id}>, held_ok array<boolean>"


def stream_failure_runs(calls: DataFrame, time: str = "ts", threshold: int = FAILURE_RUN, delay: str = "1 minute") -> DataFrame:
    """``(dependency, call_id, ts, run)`` of calls that complete a run of ``threshold`` failures, in event order.

    A call is judged when the watermark has passed it, so batches may bring calls in any order within
    ``delay``. State per dependency is the length of the open run and the calls that still wait. A call that
    comes later than that would change runs that were reported: it is left to :func:`flows.failure_runs`.
    """

    # Calls of one time are ordered by their ids: numbers as numbers, all else as text.
    kind, native = ("long", int) if isinstance(calls.schema["call_id"].dataType, IntegralType) else ("string", str)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, done, held = 0, -1 << 62, []
        if state.exists:
            run, done, *lists = state.get
            held = list(zip(*lists, strict=True))
        mark = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for frame in frames:
                at = frame["_ts"].astype("int64").tolist()
                held += [x for x in zip(at, frame["call_id"].tolist(), frame["ok"].tolist(), strict=True) if x[0] > done]
        held.sort()
        ready = [x for x in held if x[0] <= mark]
        held = held[len(ready) :]
        out = []
        for at, call, ok in ready:
            run = 0 if ok else run + 1
            done = at
            if run == threshold:
                out.append((key[0], call, at, run))
        lists = [list(map(kind, x)) for kind, x in zip((int, native, bool), zip(*held, strict=True) if held else ([], [], []), strict=True)]
        state.update((run, done, *lists))
        if held:
            state.setTimeoutTimestamp(max(held[0][0] // 1000, mark // 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["dependency", "call_id", "ts_us", "run"])

    rows = calls.withWatermark(time, delay).select(
        "dependency", F.col("call_id").cast(kind).alias("call_id"), F.coalesce("ok", F.lit(False)).alias("ok"), F.unix_micros(time).alias("_ts"), time
    )
    found = rows.groupBy("dependency").applyInPandasWithState(
        update, f"dependency string, call_id {kind}, ts_us long, run long", RUN_STATE.format(id=kind), "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.select("dependency", F.col("call_id").cast(calls.schema["call_id"].dataType).alias("call_id"), F.timestamp_micros("ts_us").alias(time), "run")


def close_failure_runs(emitted: DataFrame, raw: DataFrame, time: str = "ts", threshold: int = FAILURE_RUN, delay: str = "1 minute", span: str = "1 hour") -> DataFrame:
    """All runs of a stream that has ended: those it emitted, and those that calls beyond its watermark complete."""
    last = raw.agg(F.max(time).alias("last")).first()["last"]
    if last is None:
        return emitted
    late = failure_runs(raw, time, threshold, span).where(F.col(time) > F.lit(last) - F.expr(f"INTERVAL {delay}"))
    return emitted.unionByName(late.join(emitted.select("dependency", "call_id"), ["dependency", "call_id"], "left_anti"))


def stream_answers(events: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """``(trace_id, answer, status)`` once a trace is done, failed or has gone quiet.

    ``events(trace_id, seq, type, content)`` with types token, reset, done and error. Tokens
    before the last reset are dropped from the state as soon as the reset arrives.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reset, tokens = json.loads(state.get[0]) if state.exists else (-1, {})
        status = "timeout" if state.hasTimedOut else None
        if not state.hasTimedOut:
            for frame in frames:
                for seq, kind, content in zip(frame["seq"], frame["type"], frame["content"]):
                    if kind == "reset":
                        reset = max(reset, int(seq))
                    elif kind == "token":
                        tokens[str(seq)] = content or ""
                    elif kind in ("done", "error"):
                        status = kind
            tokens = {s: t for s, t in tokens.items() if int(s) > reset}
        if status is None:
            state.update((json.dumps([reset, tokens], ensure_ascii=False),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
            return
        if state.exists:
            state.remove()
        answer = "".join(tokens[s] for s in sorted(tokens, key=int))
        yield pd.DataFrame({"trace_id": [key[0]], "answer": [answer], "status": [status]})

    return (
        events.select("trace_id", "seq", "type", "content")
        .groupBy("trace_id")
        .applyInPandasWithState(
            update,
            "trace_id long, answer string, status string",
            STATE,
            "append",
            _timeout(idle_ms),
        )
    )
