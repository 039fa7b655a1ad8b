"""What a Python worker keeps between tasks, and how it gives memory back.

Workers outlive tasks and serve one operator after another. What a model or tokenizer takes stays only
while tasks of the same operator follow each other; a task of another one starts without it. At a task's
end freed memory goes back to the system, which allocators else hold on to.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_kept: dict[tuple, object] = {}


def once(key: tuple, make: Callable[[], object]) -> object:
    """What `make` gives, made once in a worker for as long as tasks of the operator `key[0]` follow each other."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget(operator: str) -> None:
    """Drop what operators other than this one kept."""
    for other in [k for k in _kept if k[0] != operator]:
        del _kept[other]


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call in this system's library
        pass


def lean(operator: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow or pandas function over batches that starts without what other operators kept, and gives memory back when it ends."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        forget(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
