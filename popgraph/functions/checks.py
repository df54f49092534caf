"""Argument checks that come before any plan is built."""

from __future__ import annotations

import math
import numbers


def positive_int(value, name: str, least: int = 1) -> int:
    if isinstance(value, bool) or not isinstance(value, numbers.Integral):
        raise TypeError(f"{name} must be an integer")
    if value < least:
        raise ValueError(f"{name} must be at least {least}")
    return int(value)


def positive(value, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, numbers.Real):
        raise TypeError(f"{name} must be a number")
    if not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must be finite and positive")
    return float(value)
