"""Next-value and fill-forward over ordered series, in slices of bounded length.

A plain window over a series sends the whole series to one task. Here a series is cut into
slices (``slice_expr``, for example snapshot number divided by 4096); the window runs within
(series, slice), and what crosses a slice border - the first or last value of the neighbour -
comes from a table with one row per (series, slice). The result equals the plain window.

The series key is one struct column, so NULL parts of a key compare as equal in the border join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HASH, SERIES, SLICE = "_hash", "_series", "_slice"
# The hash leads every sort: sorting compares one number before it compares a struct.
SERIES_KEY = (HASH, SERIES)
SLICE_KEY = (HASH, SERIES, SLICE)


def with_slices(df: DataFrame, series: Sequence[str], slice_expr: Column) -> DataFrame:
    """Add the series struct, its hash and the slice number."""
    return df.withColumns({HASH: F.xxhash64(*series), SERIES: F.struct(*series), SLICE: slice_expr})


def slice_heads(df: DataFrame, order: str, value: str, *more: Column) -> DataFrame:
    """Per (series, slice): the first value in ``order``, plus further aggregates."""
    return df.groupBy(*SLICE_KEY).agg(F.min_by(value, order).alias("_head"), *more)


def lead_within(df: DataFrame, order: str, value: str) -> DataFrame:
    """Add ``_next`` and ``_inside``: the next value, and whether it lies in the same slice."""
    window = W.partitionBy(*SLICE_KEY).orderBy(F.col(order).asc_nulls_last())
    return df.withColumn("_next", F.lead(value).over(window)).withColumn(
        "_inside", F.lead(F.lit(True)).over(window)
    )


def neighbours_within(df: DataFrame, order: str, value: str) -> DataFrame:
    """``lead_within`` plus ``_previous`` and ``_after``: the previous value, and whether it lies in the same slice."""
    window = W.partitionBy(*SLICE_KEY).orderBy(F.col(order).asc_nulls_last())
    return lead_within(df, order, value).withColumn("_previous", F.lag(value).over(window)).withColumn(
        "_after", F.lag(F.lit(True)).over(window)
    )


def next_head() -> Column:
    """First value of the following slice, over the table of heads."""
    return F.lead("_head").over(W.partitionBy(*SERIES_KEY).orderBy(SLICE))


def next_value(df: DataFrame, series: Sequence[str], order: str, value: str, alias: str,
               slice_expr: Column | None = None) -> DataFrame:
    """Add the value of the following row of the same series; NULL on the last row."""
    if slice_expr is None:
        window = W.partitionBy(*series).orderBy(F.col(order).asc_nulls_last())
        return df.withColumn(alias, F.lead(value).over(window))
    cut = with_slices(df, series, slice_expr)
    border = slice_heads(cut, order, value).select(*SLICE_KEY, next_head().alias("_border"))
    joined = lead_within(cut, order, value).join(border, list(SLICE_KEY))
    filled = joined.withColumn(alias, F.when(F.col("_inside"), F.col("_next")).otherwise(F.col("_border")))
    return filled.select(*df.columns, alias)


def fill_forward(df: DataFrame, series: Sequence[str], order: str, column: str,
                 slice_expr: Column | None = None) -> DataFrame:
    """Replace NULLs of ``column`` by the latest earlier value of the same series."""
    by_order = F.col(order).asc_nulls_last()
    if slice_expr is None:
        window = W.partitionBy(*series).orderBy(by_order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(column, F.last(column, ignorenulls=True).over(window))
    cut = with_slices(df, series, slice_expr)
    tails = cut.groupBy(*SLICE_KEY).agg(
        F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("_tail")
    )
    before = W.partitionBy(*SERIES_KEY).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    border = tails.select(*SLICE_KEY, F.last("_tail", ignorenulls=True).over(before).alias("_border"))
    window = W.partitionBy(*SLICE_KEY).orderBy(by_order).rowsBetween(W.unboundedPreceding, 0)
    inner = cut.withColumn("_own", F.last(column, ignorenulls=True).over(window)).join(border, list(SLICE_KEY))
    return inner.withColumn(column, F.coalesce("_own", "_border")).select(*df.columns)
