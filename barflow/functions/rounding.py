"""Rounding of doubles by their exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(x: Column, digits: int) -> Column:
    """x (0 to 1,000) to at most four digits: the nearest by the double's exact value, halves of it to the even digit.

    Spark rounds the shortest decimal of a double, which can be a half where the double itself lies above or below it.
    Here the half between two results is made as a double, and where x is that very double, the rest that the
    division has left out is found exactly: 30 bits and the others are multiplied apart, each without a loss.
    """
    scale = float(10**digits)
    k = F.floor(x * scale)
    k = F.when((k + 1) / scale <= x, k + 1).when(k / scale > x, k - 1).otherwise(k).cast("double")
    half = (2 * k + 1) / (2 * scale)
    high = F.floor(half * float(1 << 30)) / float(1 << 30)
    above = (high * (2 * scale) - (2 * k + 1)) + (half - high) * (2 * scale)
    up = (x > half) | ((x == half) & ((above > 0) | ((above == 0) & (F.pmod(k, F.lit(2.0)) == 1))))
    return F.when(up, k + 1).otherwise(k) / scale
