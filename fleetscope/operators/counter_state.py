"""Counter history that grows load by load: a small state per series takes a new load without the old ones.

The state has one row per series: its last row, which waits for the next value, and moments from which the variance of the
whole series follows. States merge in any order and grouping; a load's deltas need the state before it only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetscope.operators.counters import (
    SERIES_KEYS, SLICE_SNAPSHOTS, _distance, _scale, _slice_of,
)
from fleetscope.operators.ordered import next_value

_EXACT = ("s1", "s2")


def load_state(totals: DataFrame, series: Sequence[str] = SERIES_KEYS, order: str = "snap_id", value: str = "wait_time",
               slice_snapshots: int = SLICE_SNAPSHOTS) -> DataFrame:
    """State of one load: a row per series.

    Moments are taken of the distances from the smallest value of each slice of snapshots and then merged, so their sums stay
    small whatever the counter's size. ``last`` holds the last row without the series' columns.
    """
    scale, cut = _scale(totals, value), [*series, "_slice"]
    rest = [c for c in totals.columns if c not in series]
    least = W.partitionBy(*cut)
    based = totals.withColumn("_slice", _slice_of(order, slice_snapshots)).withColumn("base", F.min(value).over(least))
    plain, steps = _distance(value, "base", scale)
    slices = based.groupBy(*cut).agg(
        F.max_by(F.struct(*rest), order).alias("last"),
        F.min("base").alias("base"),
        F.max(value).alias("high"),
        F.count(F.lit(1)).alias("row_count"),
        F.count(value).alias("n"),
        F.count(steps).alias("counted"),
        F.try_sum(steps).alias("s1"),
        F.try_sum(F.try_multiply(steps, steps)).alias("s2"),
        F.avg(plain).alias("mean"),
        F.var_pop(plain).alias("spread"),
    )
    return merge_states(slices.drop("_slice"), series, order, scale)


def merge_states(states: DataFrame, series: Sequence[str] = SERIES_KEYS, order: str = "snap_id",
                 scale: int | None = 0) -> DataFrame:
    """One row per series from any number: moments move to the smallest base and add up.

    Whole-number sums are exact and don't depend on the order of loads; one that overflowed, or a part that has
    none, leaves NULL, and the variance then comes from means and centred sums. ``scale`` is the counter's number of decimal
    places, None for doubles.
    """
    whole = W.partitionBy(*series)
    placed = states.withColumn("_of", F.min("base").over(whole))
    plain, steps = _distance("base", "_of", scale)
    count = F.col("n").cast("decimal(20,0)")
    moved = placed.withColumns({
        "mean": F.col("mean") + plain,
        "_t1": F.try_add(F.col("s1"), F.try_multiply(count, steps)),
        "_t2": F.try_add(F.col("s2"), F.try_add(
            F.try_multiply(F.try_multiply(F.lit(2), steps), F.col("s1")), F.try_multiply(count, F.try_multiply(steps, steps)))),
    })
    centred = moved.withColumn("_centre", F.sum(F.col("mean") * F.col("n")).over(whole) / F.nullif(F.sum("n").over(whole), F.lit(0)))
    gap = F.col("mean") - F.col("_centre")

    def exact(name: str) -> Column:
        return F.when(F.count(F.when(F.col("n") > 0, F.col(name))) == F.count(F.when(F.col("n") > 0, 1)), F.try_sum(name))

    return centred.groupBy(*series).agg(
        F.max_by("last", F.col(f"last.{order}")).alias("last"),
        F.min("base").alias("base"),
        F.max("high").alias("high"),
        F.sum("row_count").alias("row_count"),
        F.sum("n").alias("n"),
        F.sum("counted").alias("counted"),
        exact("_t1").alias("s1"),
        exact("_t2").alias("s2"),
        F.max("_centre").alias("mean"),
        (F.sum((F.col("spread") + gap * gap) * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("spread"),
    )


def state_variance(scale: int | None = 0) -> Column:
    """Sample variance of a state's series: exactly 0 for a constant one, NULL for fewer than two values."""
    n = F.col("n").cast("decimal(20,0)")
    numerator = F.try_subtract(F.try_multiply(n, F.col("s2")), F.try_multiply(F.col("s1"), F.col("s1"))).cast("double")
    pairs = (F.col("n") * (F.col("n") - 1)).cast("double")
    exact = F.when(F.col("counted") == F.col("n"), numerator / pairs / F.lit(float(100 ** (scale or 0))))
    return (
        F.when(F.col("n") < 2, F.lit(None).cast("double"))
        .when(F.col("base") == F.col("high"), F.lit(0.0))
        .otherwise(F.coalesce(exact, F.col("spread") * F.col("n") / (F.col("n") - 1)))
    )


def _same(series: Sequence[str]) -> Column:
    found = F.lit(True)
    for c in series:
        found = found & F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}"))
    return found


def advance(state: DataFrame | None, totals: DataFrame, series: Sequence[str] = SERIES_KEYS, order: str = "snap_id",
            value: str = "wait_time", slice_snapshots: int = SLICE_SNAPSHOTS) -> tuple[DataFrame, DataFrame]:
    """Take a load: (rows whose delta is now known, new state).

    The rows are those of the load but the last of each series, and the row that waited in the state. Rows not after a series'
    last one are left out: a load that is repeated changes nothing. Store the new state before the next load; the old
    one is then no longer read.
    """
    scale, delta = _scale(totals, value), f"{value}_delta"
    if state is not None:
        after = totals.alias("t").join(state.alias("s"), _same(series), "left")
        new = after.filter(F.col(f"s.last.{order}").isNull() | (F.col(f"t.{order}") > F.col(f"s.last.{order}"))).select("t.*")
        rows = new.unionByName(state.select(*series, "last.*").select(*totals.columns))
    else:
        new = rows = totals
    following = next_value(rows.withColumn("_at", F.col(order)), series, order, F.struct("_at", value), "_then", _slice_of(order, slice_snapshots))
    closed = following.filter(F.col("_then").isNotNull()).withColumn(delta, F.col(f"_then.{value}") - F.col(value))
    grown = load_state(new, series, order, value, slice_snapshots)
    grown = grown if state is None else merge_states(state.unionByName(grown), series, order, scale)
    return closed.select(*totals.columns, delta), grown


def open_rows(state: DataFrame, series: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """The last row of each series, which waits for its next value."""
    return state.select(*series, "last.*")


def whole_history(closed: DataFrame, state: DataFrame, series: Sequence[str] = SERIES_KEYS, value: str = "wait_time",
                  scale: int | None = 0, keep_constant: bool = False, var_round: int | None = None) -> DataFrame:
    """The counter report from stored rows and the state: all rows with delta (NULL on the last) and ``waits_var``."""
    delta = f"{value}_delta"
    waiting = open_rows(state, series).withColumn(delta, F.lit(None).cast(closed.schema[delta].dataType))
    variance = state_variance(scale) if var_round is None else F.round(state_variance(scale), var_round)
    named = state.select(*series, state_variance(scale).alias("_var"), variance.alias("waits_var"))
    kept = named if keep_constant else named.filter(F.col("_var") != 0)
    rows = closed.unionByName(waiting.select(*closed.columns))
    return rows.alias("t").join(kept.alias("s"), _same(series)).select("t.*", "s.waits_var")
