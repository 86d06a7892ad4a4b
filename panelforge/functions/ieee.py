"""Arithmetic with one rule for what is missing: NULL stands for NaN and spreads, infinities are values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def null() -> Column:
    return F.lit(None).cast("double")


def clean(x: Column) -> Column:
    """x, with NaN as NULL."""
    return F.nanvl(x, null())


def divide(a: Column, b: Column) -> Column:
    """a / b as floating point has it, whatever the session's ANSI mode."""
    by_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    # the inner NULLIF keeps ANSI mode from seeing a zero
    return F.when(b.isNull() | a.isNull(), null()).when(b == 0, by_zero).otherwise(clean(a / F.nullif(b, F.lit(0.0))))


def log(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INF)).when(x > 0, F.ln(x))


def power(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), clean(F.pow(a, b)))


def larger(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def smaller(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))
