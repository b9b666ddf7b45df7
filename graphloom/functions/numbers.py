"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def sigmoid(z: Column) -> Column:
    """1 / (1 + exp(-z)) by the branch that can't overflow."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def erfc(x: Column) -> Column:
    """The five-term rational approximation of Abramowitz and Stegun, 7.1.26."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(_A):
        poly = (poly + a) * t
    y = poly * F.exp(-x * x)
    return F.when(x >= 0, y).otherwise(2 - y)


def nearest_rank(ordered: Column, q: float) -> Column:
    """Element round((n - 1) q) of a sorted array; null if empty."""
    return F.try_element_at(ordered, (F.floor((F.size(ordered) - 1) * F.lit(q) + 0.5) + 1).cast("int"))


def rounded(x: Column | str, digits: int) -> Column:
    """A double rounded as SQL engines do that scale it, halves away from zero: 0.145 becomes 0.14, as 0.145 * 100 is below 14.5 (``round`` of Spark goes by the shortest decimal and gives 0.15)."""
    scale = float(10**digits)
    return F.round((F.col(x) if isinstance(x, str) else x) * scale, 0) / scale


def portable_hash(text: Column) -> Column:
    """A 60-bit hash that other SQL engines compute alike: the first 15 hex digits of the MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
