"""Ordered text rules: the first matching pattern decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def first_match(text: Column, rules: Sequence[tuple], default=None) -> Column:
    """Value of the first rule (pattern, value) whose LIKE pattern matches ``text``."""
    out = None
    for pattern, value in rules:
        hit, result = text.like(pattern), F.lit(value)
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def classify(df: DataFrame, column: str, outputs: dict[str, tuple[Sequence[tuple], object]]) -> DataFrame:
    """Add one column per entry of ``outputs``: name -> (rules, default)."""
    text = F.col(column)
    return df.withColumns({name: first_match(text, rules, default) for name, (rules, default) in outputs.items()})


def all_rows_hold(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Groups in which every row satisfies ``condition`` (NULL counts as satisfied)."""
    whole = F.every(F.coalesce(condition, F.lit(True))).alias("_whole")
    return df.groupBy(*keys).agg(whole).filter("_whole").drop("_whole")


def words_capitalised(text: Column) -> Column:
    """First letter of each alphanumeric run upper, the rest lower."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), ""
    )
