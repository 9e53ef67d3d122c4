"""Python workers that give memory back: a worker idles beside the JVM while other stages run."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from functools import wraps

import pyarrow as pa


def trim(collect: bool = True) -> None:
    """Return freed memory of Arrow's pool and of the C heap to the system."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps its heap
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(function):
    """A function of an iterator of batches that trims when it has ended."""

    @wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            trim()

    return run
