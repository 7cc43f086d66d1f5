"""Queries the package registers, each with its SQL twin where SQL can state it."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["retrieval_queries", "chunk_queries", "context_queries", "dialogue_queries", "feedback_queries", "metering_queries", "evaluation_queries", "page_queries", "stream_queries", "source_queries"]


def _collect(kind: str) -> dict:
    merged: dict = {}
    for name in _MODULES:
        part = getattr(import_module(f"folioscope.registry.{name}"), kind)
        overlap = merged.keys() & part.keys()
        if overlap:
            raise ValueError(f"registered twice: {sorted(overlap)}")
        merged.update(part)
    return merged


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict:
    return _collect("ORACLES")
