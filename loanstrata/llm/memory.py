"""What a reused Python worker keeps between tasks: one object at most, and no memory that is no longer used."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import pyarrow as pa

from loanstrata.llm import words

_SLOT: dict[bytes, object] = {}


def held(key: bytes, make: Callable):
    """The object made for `key`, kept until a task of this worker asks for another one."""
    if key not in _SLOT:
        _SLOT.clear()
        release()
        _SLOT[key] = make()
    return _SLOT[key]


def release() -> None:
    """Gives buffers that nothing uses any more back to the system: tables of powers, Arrow's pool, the C heap."""
    words._POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A task function for `mapInArrow` or a group that gives its memory back when it has ended."""
    def wrapped(rows):
        out = run(rows)
        if hasattr(out, "__next__"):
            return _drained(out)
        release()
        return out
    return wrapped


def trimmed_pair(run: Callable) -> Callable:
    """The same for a cogroup."""
    def wrapped(left, right):
        out = run(left, right)
        release()
        return out
    return wrapped


def _drained(out):
    yield from out
    release()
