"""What Python workers hold. Spark keeps a worker from task to task, through all operators of a session."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

_kept: dict[tuple, Any] = {}


def kept(owner: str, key: object, make: Callable[[], Any]) -> Any:
    """The one table that this worker keeps for later tasks of ``owner``; another takes its place."""
    if (owner, key) not in _kept:
        _kept.clear()
        _kept[owner, key] = make()
    return _kept[owner, key]


def give_back() -> None:
    """Freed memory goes to the system, where the libraries would hold it for this process."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def keep_freed(end: int = 64 << 20, most: int = 16 << 20) -> None:
    """Arrays of up to ``most`` bytes come from the heap, and up to ``end`` freed bytes at its end stay with this process.

    A loop that makes the same arrays again and again would else give their pages back and fault them in anew each time.
    """
    try:
        mallopt = ctypes.CDLL(None).mallopt
        mallopt(-3, most), mallopt(-1, end)  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def task(owner: str) -> Callable:
    """For functions over an iterator of batches: a task drops what other operators kept, and leaves no freed memory held."""

    def of(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
        @functools.wraps(run)
        def whole(batches: Iterator) -> Iterator:
            if any(k[0] != owner for k in _kept):
                _kept.clear()
            give_back()
            try:
                yield from run(batches)
            finally:
                give_back()

        return whole

    return of
