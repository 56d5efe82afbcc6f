"""Try again a fixed number of times; raises when the tries are used up."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

V = TypeVar("V")


def retry(call: Callable[[], V], tries: int = 5, sleep_s: float = 1.0, on: tuple[type[Exception], ...] = (Exception,)) -> V:
    for k in range(1, tries + 1):
        try:
            return call()
        except on:
            if k == tries:
                raise
            time.sleep(sleep_s)
    raise ValueError("tries must be positive")
