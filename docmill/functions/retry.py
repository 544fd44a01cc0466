"""Repeated attempts at calls that may fail for a while."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")


def waits(attempts: int, least: float = 4.0, most: float = 10.0) -> list[float]:
    """Seconds between attempts: powers of two within the bounds."""
    return [min(most, max(least, 2.0**i)) for i in range(1, attempts)]


def retrying(call: Callable[[], T], attempts: int = 3, least: float = 4.0, most: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """What ``call`` returns; the last attempt's error is raised."""
    for pause in waits(attempts, least, most):
        try:
            return call()
        except Exception:  # noqa: BLE001  tried again
            sleep(pause)
    return call()
