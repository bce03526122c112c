"""Memory of reused Python workers.

A worker outlives its tasks and goes on to other operators' ones. What an
operator keeps for its next task (vocabularies, tables, remembered results) is
of no use to another, so it goes when another operator's task begins. Tables of
powers, which are quickly made, and free memory go whenever a task ends.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa

from ebbline.llm.hashing import forget_powers

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: The operator of the last task, and how its tables are dropped.
_held: list[tuple[str, Callable[[], None]]] = []


def give_back() -> None:
    """Returns free memory to the system, where the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@contextmanager
def task_of(operator: str, drop: Callable[[], None] = lambda: None) -> Iterator[None]:
    """Around the batches of a task: ``drop`` frees what the operator keeps, once a task of another begins."""
    if not _held or _held[-1][0] != operator:
        while _held:
            _held.pop()[1]()
        give_back()
        _held.append((operator, drop))
    try:
        yield
    finally:
        forget_powers()
        give_back()


def within(operator: str, run: Run, drop: Callable[[], None] = lambda: None) -> Run:
    """A function over the batches of a task as ``task_of`` the operator."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_of(operator, drop):
            yield from run(batches)

    return whole
