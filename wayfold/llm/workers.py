"""Python workers outlive their tasks; this gives back what a task has used."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, wraps
from pathlib import Path

import numpy as np
import pyarrow as pa


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Products of small matrices waste time in a second thread, which is another task's core."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def tidy(work: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A generator over batches that leaves no memory behind."""

    @wraps(work)
    def run(batches: Iterable) -> Iterator:
        one_thread()
        try:
            yield from work(batches)
        finally:
            release()

    return run
