"""What a Python worker keeps from task to task.

Workers are shared by all operators of a job, so only the last operator's tables stay: asking for another key drops
what was kept before.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable
from typing import TypeVar

T = TypeVar("T")
_held: dict[Hashable, object] = {}


def sole(key: Hashable, make: Callable[[], T]) -> T:
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]


class Kept(dict):
    """What ``make`` gives for a key, kept for the first ``most`` keys."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value
