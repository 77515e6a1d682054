"""What the tasks of a Python worker leave behind is given back to the system.

Spark keeps a worker for the tasks of all stages, and allocators keep what a
task has freed for the next one. A worker that waits would so hold the peak of
every operator before, next to a JVM that needs the memory then.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable

import pyarrow as pa

SLACK = 32 << 20  # bytes beyond what stayed the last time from which it is worth the time
_stayed = 0
_shared: dict[str, Callable[[], None]] = {}


def private_bytes() -> int:
    """Resident bytes of this process that are no mapped files; -1 where that cannot be read."""
    try:
        with open("/proc/self/statm") as f:
            _, resident, mapped = f.read().split()[:3]
    except OSError:
        return -1
    return (int(resident) - int(mapped)) * os.sysconf("SC_PAGE_SIZE")


def share(name: str, clear: Callable[[], None]) -> None:
    """Register a table that tasks of the operator ``name`` share in a worker; another operator's task clears it."""
    _shared[name] = clear


def begin(keep: str | None) -> None:
    global _stayed
    for name, clear in _shared.items():
        if name != keep:
            clear()
            _stayed = 0


def give_back() -> None:
    """Hand freed memory to the system, unless little has come since the last time."""
    global _stayed
    now = private_bytes()
    if 0 <= now <= _stayed + SLACK:
        return
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
    _stayed = max(0, private_bytes())


def lean(run, keep: str | None = None):
    """``run`` for mapInArrow, giving back at its end what it has freed; shared tables but that of ``keep`` are cleared first."""

    def task(batches):
        begin(keep)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
