"""Memory of the Python workers, which outlive a task and serve one operator after another."""

from __future__ import annotations

import ctypes
import gc
import threading
from collections.abc import Callable, Iterator

_SERVED: list[str] = [""]


def turn_to(operator: str) -> None:
    """A worker that turns to another operator gives back what the last one kept."""
    if _SERVED[0] == operator:
        return
    _SERVED[0] = operator
    from permaway.llm import tokens

    tokens.forget()
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: Seconds without a task after which a worker gives back what it kept.
REST = 2.0
_TURN, _LOCK = [0], threading.Lock()


def _rest(turn: int) -> None:
    """Gives back what was kept for a next task, if none came."""
    from permaway.llm import tokens

    with _LOCK:
        if turn == _TURN[0]:
            tokens.forget()
            give_back()


def _begin(operator: str) -> None:
    with _LOCK:
        _TURN[0] += 1
    turn_to(operator)


def _end() -> None:
    give_back()
    timer = threading.Timer(REST, _rest, (_TURN[0],))
    timer.daemon = True
    timer.start()


def serving(operator: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, in a worker that serves ``operator``."""

    def served(batches: Iterator) -> Iterator:
        # these belong to the worker's own module: the function is sent without its state
        _begin(operator)
        yield from run(batches)
        _end()

    return served
