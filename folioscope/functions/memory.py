"""Memory of Python workers, which outlive the task they were started for."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system: a worker goes on with tasks of other operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over a task's batches, that gives its memory back at the end."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole
