"""Rounding, unit scaling and fixed-width number text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BYTES_PER_MB = 1048576


def to_mb(column: Column, digits: int = 2) -> Column:
    """Bytes to MB; half-even as the Python reports round."""
    return F.bround(column / F.lit(BYTES_PER_MB), digits)


def whole_mb(column: Column) -> Column:
    """Bytes to whole MB, cut towards zero."""
    return (column / F.lit(BYTES_PER_MB)).cast("bigint")


def used_percent(free: Column, size: Column) -> Column:
    """``100 - round(free * 100 / size, 2)``; NULL when the size is zero."""
    return F.lit(100) - F.bround(F.try_divide(free * 100, size), 2)


def number_text(column: Column, digits: int, decimals: int = 0, leading_zero: bool = False) -> Column:
    """Right-aligned number text of fixed width with one place kept for the sign.

    ``digits``/``decimals`` are the places before and after the point. A value that needs more
    places becomes a row of ``#``; without ``leading_zero`` a fraction loses its zero (``.50``).
    """
    width = 1 + digits + (decimals + 1 if decimals else 0)
    value = F.round(column.cast("decimal(38,10)"), decimals)
    shown = value.cast(f"decimal(38,{decimals})").cast("string")
    if decimals and not leading_zero:
        shown = F.regexp_replace(shown, r"^(-?)0\.", "$1.")
    return (
        F.when(column.isNull(), F.lit(None).cast("string"))
        .when(F.abs(value) >= F.lit(10**digits), F.lit("#" * width))
        .otherwise(F.lpad(shown, width, " "))
    )
