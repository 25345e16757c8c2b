"""Keeps a Python worker's memory from growing from stage to stage: a worker serves many."""

from __future__ import annotations

import ctypes
import functools

#: Rows of a batch that goes to a Python worker, unless the session says otherwise: a row can hold a long text,
#: and the executor holds a batch outside its heap, with as much again while it grows.
BATCH_ROWS = 256

_caches: list[tuple[frozenset[str], object]] = []


def cache_of(container, *kinds: str):
    """``container``, cleared when a worker turns to a task of another kind."""
    _caches.append((frozenset(kinds), container))
    return container


def enter(kind: str) -> None:
    """Drops what only tasks of other kinds need."""
    for kinds, container in _caches:
        if kind not in kinds:
            container.clear()


def trim() -> None:
    """Gives memory that is free back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def small_batches(spark) -> None:
    """Has the session send batches of BATCH_ROWS to Python workers, unless it has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(BATCH_ROWS))


def task(kind: str):
    """For functions of ``mapInArrow``: caches of other kinds go at the start, free memory at the end."""

    def wrap(run):
        @functools.wraps(run)
        def bounded(batches):
            enter(kind)
            try:
                yield from run(batches)
            finally:
                trim()

        return bounded

    return wrap
