"""Retries of calls to a remote service."""

from __future__ import annotations

import random
import time
from collections.abc import Callable


def retried(call: Callable, tries: int = 5, first: float = 4.0, most: float = 120.0, errors: tuple = (OSError,), sleep: Callable[[float], None] = time.sleep):
    """The call's result; waits double from ``first`` to ``most`` seconds, each with up to a quarter more."""
    wait = first
    for n in range(tries):
        try:
            return call()
        except errors:
            if n == tries - 1:
                raise
            sleep(wait * (1 + random.random() / 4))
            wait = min(2 * wait, most)


def halved(items: list, call: Callable[[list], list], too_big: type[Exception]) -> list:
    """call(items), or the two halves' results one after another where the service finds them too many."""
    try:
        return call(items)
    except too_big:
        if len(items) < 2:
            raise
        mid = len(items) // 2
        return halved(items[:mid], call, too_big) + halved(items[mid:], call, too_big)
