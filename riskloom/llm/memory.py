"""Python workers are used for one task after another; what a task freed goes back to the system at its end."""
from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def release() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over a task's batches that gives freed memory back when it is done."""

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return tidied
