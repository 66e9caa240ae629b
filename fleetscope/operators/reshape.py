"""Wide to long and long to wide."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def listed(column: str, values: Sequence) -> Column:
    """The column itself; a value outside ``values`` stops the job, so that a pivot over them loses nothing."""
    found = F.coalesce(F.col(column).cast("string"), F.lit("NULL"))
    return F.when(F.col(column).isin(list(values)), F.col(column)).otherwise(
        F.raise_error(F.concat(F.lit(f"{column} is not among the columns asked for: "), found))
    )


def settings_rows(df: DataFrame, ids: Sequence[str], name: str = "setting", value: str = "value") -> DataFrame:
    """One row per column of a configuration row; all values become text."""
    others = [c for c in df.columns if c not in ids]
    text = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in others])
    return text.unpivot(list(ids), others, name, value)


def metric_rows(df: DataFrame, ids: Sequence[str], metrics: Mapping[str, Column], name: str = "metric",
                value: str = "value") -> DataFrame:
    """Long rows (ids, metric, value) from one scan instead of one scan per metric."""
    wide = df.select(*ids, *[c.alias(m) for m, c in metrics.items()])
    return wide.unpivot(list(ids), list(metrics), name, value)


def metric_columns(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], name: str = "metric",
                   value: str = "value") -> DataFrame:
    """Wide form of long metric rows; ``metrics`` fixes the schema. Repeated cells are averaged."""
    return df.groupBy(*ids).pivot(name, list(metrics)).agg(F.avg(value))
