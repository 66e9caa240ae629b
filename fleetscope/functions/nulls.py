"""Column expressions with the source database's NULL rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def concat_nn(*cols: Column) -> Column:
    """Concatenation in which NULL counts as the empty text."""
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def greatest_nn(*cols: Column) -> Column:
    """Largest value, NULL as soon as one input is NULL."""
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    return F.when(known, F.greatest(*cols))


def substr_nn(text: Column, start: Column, length: Column) -> Column:
    """Substring that is NULL, not empty, for a length below one."""
    return F.when(length >= 1, F.substr(text, start, length))


def try_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double, NULL for a zero divisor."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
