"""What a Python process loads once and keeps: models and tables that many tasks of a worker use."""

from __future__ import annotations

import threading
from collections.abc import Callable, Hashable

_held: dict[Hashable, object] = {}
_locks: dict[Hashable, threading.Lock] = {}
_guard = threading.Lock()


def once(key: Hashable, load: Callable[[], object]) -> object:
    """What load() gives, called once in this process for each key, whichever thread or task comes first."""
    if key not in _held:
        with _guard:
            lock = _locks.setdefault(key, threading.Lock())
        with lock:
            if key not in _held:
                _held[key] = load()
    return _held[key]


def forget(key: Hashable | None = None) -> None:
    """Drop what is held under a key, or all of it."""
    with _guard:
        for k in [key] if key is not None else list(_held):
            _held.pop(k, None)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark, size: str = "8m") -> None:
    """Let no Arrow batch that goes to a Python worker have more bytes than this, unless the session has a setting of its
    own: by default 64 MB stand in the JVM, once more on their way, and once more in the worker, for every task."""
    if spark.conf.get(BATCH_BYTES, None) in (None, "67108864b", "64m"):
        spark.conf.set(BATCH_BYTES, size)
