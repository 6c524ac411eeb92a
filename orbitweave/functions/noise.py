"""Reproducible noise: a function of (seed, id, draw), the same in any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts) -> Column:
    """In [0, 1), from a hash of the parts."""
    return (F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts)).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)


def gauss(*parts) -> Column:
    """Standard normal (Box-Muller)."""
    return F.sqrt(-2.0 * F.log(1.0 - uniform(*parts, 1))) * F.cos(2.0 * math.pi * uniform(*parts, 2))


def lcg(key: Column, draw: int) -> Column:
    """In [0, 1), by one step of a linear congruence: for fixtures that SQL engines must agree on."""
    return F.pmod(key * 1103515245 + 12345 * draw, F.lit(2147483648)).cast("double") / 2147483648.0
