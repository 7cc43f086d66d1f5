"""Explicit schemas; nothing in the package infers one on a production path."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
HISTORY = T.ArrayType(MESSAGE)
CONTEXT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("heading", T.StringType()),
    ]
)

DOCUMENTS = T.StructType([T.StructField("source", T.StringType()), T.StructField("content", T.StringType())])

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("heading", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("embed_text", T.StringType()),
    ]
)
STORED_CHUNKS = T.StructType(
    CHUNKS.fields
    + [
        T.StructField("signature", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)

QUESTION = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("ground_truth", T.StringType()),
        T.StructField("expected_keywords", T.ArrayType(T.StringType())),
        T.StructField("expected_sources", T.ArrayType(T.StringType())),
        T.StructField("expected_tool", T.StringType()),
        T.StructField("history", HISTORY),
    ]
)

INTERACTIONS = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("route", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("contexts", T.ArrayType(CONTEXT)),
        T.StructField("stages", T.MapType(T.StringType(), T.StringType())),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("tokens_source", T.StringType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("first_token_ms", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("comment", T.StringType()),
    ]
)

REQUEST_LOG = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("route", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer_chars", T.LongType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("first_token_ms", T.DoubleType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("tokens_source", T.StringType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

SCORE = T.StructType(
    [
        T.StructField("value", T.DoubleType()),
        T.StructField("skipped", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)
SAMPLE = T.StructType(
    [
        T.StructField("combo", T.StringType()),
        T.StructField("user_input", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("retrieved_contexts", T.ArrayType(T.StringType())),
        T.StructField("reference", T.StringType()),
        T.StructField("citations", T.ArrayType(T.StringType())),
    ]
)
SCORED = T.StructType(
    [
        T.StructField("combo", T.StringType()),
        T.StructField("user_input", T.StringType()),
        T.StructField("judge", T.StringType()),
        T.StructField("scores", T.MapType(T.StringType(), SCORE)),
    ]
)
