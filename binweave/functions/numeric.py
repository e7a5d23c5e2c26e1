"""Numeric column functions.

All of them are built from JVM expressions, so they stay inside whole-stage
code generation.  ``+ 0.0`` removes the sign of a negative zero, which would
otherwise show up in text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")
POS_INF = float("inf")


def half_even(x: Column) -> Column:
    """Nearest whole number, ties to even (``F.round`` sends ties away from zero)."""
    return F.rint(x) + F.lit(0.0)


def bin_by_count(x: Column, per_unit: float = 1.0) -> Column:
    """Bin of ``x`` when one unit holds ``per_unit`` bins."""
    return F.rint(x * F.lit(float(per_unit))) / F.lit(float(per_unit)) + F.lit(0.0)


def bin_by_width(x: Column, width: float = 1.0, offset: float = 0.0) -> Column:
    """Bin of ``x + offset`` for bins of ``width``; the offset stays in the result."""
    moved = x + F.lit(float(offset))
    return F.rint(moved / F.lit(float(width))) * F.lit(float(width)) + F.lit(0.0)


def two_digits(x: Column) -> Column:
    """``x`` without the float noise past two digits, so that equal offsets compare equal."""
    return F.bround(x, 2) + F.lit(0.0)


def log10_full(x: Column) -> Column:
    """log10 with log10(0) = -inf, where Spark's own returns NULL."""
    return F.when(x == 0, F.lit(NEG_INF)).otherwise(F.log10(x))


def log2_full(x: Column) -> Column:
    return F.when(x == 0, F.lit(NEG_INF)).otherwise(F.log2(x))


def neg_log10(p: Column) -> Column:
    """-log10(p), +inf at p = 0 and a plain 0 at p = 1."""
    return F.when(p == 0, F.lit(POS_INF)).otherwise(F.lit(0.0) - F.log10(p))


def signed_neg_log10(logfc: Column, p: Column) -> Column:
    """-log10(p) carrying the sign of the fold change."""
    return F.signum(logfc) * neg_log10(p) + F.lit(0.0)
