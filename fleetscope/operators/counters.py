"""History of cumulative counters: deltas, variance filter, ranking of series, time x series matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from fleetscope.functions.times import minute_label
from fleetscope.operators.ordered import (
    HASH, SERIES, SERIES_KEY, SLICE, SLICE_KEY, fill_forward, neighbours_within, next_head,
)
from fleetscope.operators.reshape import listed
from fleetscope.session import checkpointed

SERIES_KEYS = ("con_id", "dbid", "instance_number", "stat_name")
# Snapshots per slice. A series has one row per snapshot, so this bounds every window group.
SLICE_SNAPSHOTS = 4096
# Slice of rows without a snapshot: before all others, as NULL would be.
NO_SLICE = -(2**63)


def snapshot_range(snapshots: DataFrame, begin, end, keys: Sequence[str] = ("dbid", "snap_id")) -> DataFrame:
    """Snapshots whose interval lies within [begin, end]."""
    return snapshots.filter(
        (F.col("begin_interval_time") >= F.lit(begin).cast("timestamp_ntz"))
        & (F.col("end_interval_time") <= F.lit(end).cast("timestamp_ntz"))
    ).select(*keys, "begin_interval_time", "end_interval_time")


def counter_totals(facts: DataFrame, snapshots: DataFrame, begin, end, value: str = "value",
                   series: Sequence[str] = SERIES_KEYS, snap_keys: Sequence[str] = ("dbid", "snap_id"),
                   extra: Sequence[str] = ()) -> DataFrame:
    """Sum of the counter per series and snapshot, with the snapshot's interval.

    ``snap_keys`` joins facts with snapshots. The default leaves the instance out, as the source
    reports do; add ``instance_number`` where a snapshot has one row per instance.
    """
    keep = list(dict.fromkeys([*series, *extra, *snap_keys, "snap_id"]))
    joined = facts.select(*keep, value).join(snapshot_range(snapshots, begin, end, snap_keys), list(snap_keys))
    group = list(dict.fromkeys([*series, *extra, "snap_id", "begin_interval_time", "end_interval_time"]))
    return joined.groupBy(*group).agg(F.sum(value).alias("wait_time"))


def _scale(df: DataFrame, column: str) -> int | None:
    """Decimal places of a column, None for doubles."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DecimalType):
        return kind.scale
    return None if isinstance(kind, T.FractionalType) else 0


def _distance(column: str, base: str, scale: int | None) -> tuple[Column, Column]:
    """``column - base`` as a double, and in whole units of the last decimal place (NULL beyond 18 digits)."""
    if scale is None:
        return F.col(column).cast("double") - F.col(base).cast("double"), F.lit(None).cast("decimal(18,0)")
    wide = f"decimal(38,{scale})"
    gap = F.try_subtract(F.col(column).cast(wide), F.col(base).cast(wide))
    return gap.cast("double"), F.try_multiply(gap, F.lit(Decimal(10**scale))).try_cast("decimal(18,0)")


def _dealt(df: DataFrame, *parts: Column) -> DataFrame:
    """Deal rows out by series and ``parts``; the series' hash is made again after the shuffle, not sent."""
    return df.repartition(F.xxhash64(SERIES), SERIES, *parts).withColumn(HASH, F.xxhash64(SERIES))


def _cut(totals: DataFrame, series: Sequence[str], order: str, slice_snapshots: int, *more: str) -> DataFrame:
    """Totals dealt out by series and slice. The series' columns travel in its struct only, except those named in ``more``.

    The slice is made from ``order`` above the shuffle. So the slices' table and the rows beside it need the same columns and read one
    shuffle, as long as the result shows no others. It is never NULL, because a join would filter such a key below the shuffle.
    """
    rest = [c for c in totals.columns if c not in series or c in (order, *more)]
    place = F.coalesce(_slice_of(order, slice_snapshots), F.lit(NO_SLICE))
    return _dealt(totals.select(F.struct(*series).alias(SERIES), *rest), place).withColumn(SLICE, place)


def _slice_table(cut: DataFrame, place: str, value: str) -> DataFrame:
    """One row per (series, slice): first and last value, and the moments of the values' distance from the slice's smallest.

    A shift changes no variance and keeps the squares small, whatever the counter's size.
    """
    based = cut.withColumn("_base", F.min(value).over(W.partitionBy(*SLICE_KEY)))
    plain, steps = _distance(value, "_base", _scale(cut, value))
    return based.groupBy(*SLICE_KEY).agg(
        F.min_by(value, place).alias("_head"),
        F.max_by(value, place).alias("_tail"),
        F.min("_base").alias("_base"),
        F.max(value).alias("_high"),
        F.count(F.lit(1)).alias("_rows"),
        F.count(value).alias("_n"),
        F.count(steps).alias("_counted"),
        F.try_sum(steps).alias("_s1"),
        F.try_sum(F.try_multiply(steps, steps)).alias("_s2"),
        F.avg(plain).alias("_mean"),
        F.var_pop(plain).alias("_spread"),
    )


def _with_variance(slices: DataFrame, scale: int | None) -> DataFrame:
    """Add ``waits_var``, the sample variance of the whole series, to its slices.

    The slices' moments are moved to the series' smallest value. Whole-number sums give the exact variance, so task order doesn't
    change it; where 38 digits don't hold them, and for doubles, means and centred sums are merged. A constant
    series is exactly 0 and a series of one value is NULL.
    """
    whole = W.partitionBy(*SERIES_KEY)
    placed = _dealt(slices.drop(HASH)).withColumn("_of", F.min("_base").over(whole))
    plain, steps = _distance("_base", "_of", scale)
    count = F.col("_n").cast("decimal(20,0)")
    moved = placed.withColumns({
        "_mean": F.col("_mean") + plain,
        "_t1": F.try_add(F.col("_s1"), F.try_multiply(count, steps)),
        "_t2": F.try_add(F.col("_s2"), F.try_add(
            F.try_multiply(F.try_multiply(F.lit(2), steps), F.col("_s1")),
            F.try_multiply(count, F.try_multiply(steps, steps)))),
    })
    n = F.sum("_n").over(whole)
    centred = moved.withColumn("_centre", F.sum(F.col("_mean") * F.col("_n")).over(whole) / n)
    # A sum that overflowed is NULL, and steps beyond 18 digits are not counted; the totals then must not be used.
    full = F.when((F.col("_counted") == F.col("_n")) & F.col("_t1").isNotNull() & F.col("_t2").isNotNull(), F.col("_n"))
    s1, s2 = F.try_sum("_t1").over(whole), F.try_sum("_t2").over(whole)
    numerator = F.try_subtract(F.try_multiply(n.cast("decimal(20,0)"), s2), F.try_multiply(s1, s1)).cast("double")
    exact = F.when(F.sum(full).over(whole) == n, numerator / (n * (n - 1)).cast("double") / F.lit(float(100 ** (scale or 0))))
    gap = F.col("_mean") - F.col("_centre")
    merged = F.sum((F.col("_spread") + gap * gap) * F.col("_n")).over(whole) / (n - 1)
    return centred.withColumn(
        "waits_var",
        F.when(n < 2, F.lit(None).cast("double"))
        .when(F.min("_base").over(whole) == F.max("_high").over(whole), F.lit(0.0))
        .otherwise(F.coalesce(exact, merged)),
    )


def counter_deltas(totals: DataFrame, series: Sequence[str] = SERIES_KEYS, order: str = "snap_id",
                   value: str = "wait_time", slice_snapshots: int = SLICE_SNAPSHOTS,
                   keep_constant: bool = False, on_reset: str = "keep", fill_last: bool = False,
                   var_round: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``<value>_delta`` (next minus current) and ``waits_var`` (variance of the series).

    ``keep_constant=False`` drops series whose variance is 0 or undefined. ``on_reset="null"``
    blanks a negative delta (a restart set the counter back). ``fill_last`` gives the last row of a
    series, which has no next value, the delta of the row before it; other gaps stay.

    ``order`` must be an integer; slices of ``slice_snapshots`` keep window groups bounded. The
    table of slice borders has one row per (series, slice) and serves delta and variance alike.
    ``ties`` order the rows of one snapshot where the series has several.
    """
    delta = f"{value}_delta"
    cut = _cut(totals, series, order, slice_snapshots, value, *ties)
    place = order
    if ties:
        place = "_place"
        cut = cut.withColumn(place, F.struct(order, *ties))
    by_slice = W.partitionBy(*SERIES_KEY).orderBy(SLICE)
    borders = _with_variance(_slice_table(cut, place, value), _scale(totals, value)).select(
        *SLICE_KEY, next_head().alias("_border"), F.lag("_tail").over(by_slice).alias("_before"),
        F.lead(F.lit(True)).over(by_slice).isNull().alias("_final"), "waits_var",
    )
    if not keep_constant:
        borders = borders.filter(F.col("waits_var") != 0)
    # Rows without a snapshot count in the variance only.
    placed = cut.filter(F.col(order).isNotNull())
    joined = neighbours_within(placed, place, value).join(_dealt(borders.drop(HASH), F.col(SLICE)), list(SLICE_KEY))
    following = F.when(F.col("_inside"), F.col("_next")).otherwise(F.col("_border"))
    change = following - F.col(value)
    if fill_last:
        previous = F.when(F.col("_after"), F.col("_previous")).otherwise(F.col("_before"))
        last = F.col("_final") & F.col("_inside").isNull()
        change = F.when(last, F.col(value) - previous).otherwise(change)
    if on_reset == "null":
        change = F.when(change >= 0, change)
    elif on_reset != "keep":
        raise ValueError("on_reset is 'keep' or 'null'")
    variance = F.col("waits_var") if var_round is None else F.round("waits_var", var_round)
    shown = [F.col(c) if c in cut.columns else F.col(SERIES).getField(c).alias(c) for c in totals.columns]
    return joined.withColumn(delta, change).withColumn("waits_var", variance).select(*shown, delta, "waits_var")


def _slice_of(order: str, slice_snapshots: int) -> Column:
    return F.col(order) - F.pmod(F.col(order), F.lit(slice_snapshots))


def counter_history(facts: DataFrame, snapshots: DataFrame, begin, end, value: str = "value",
                    series: Sequence[str] = SERIES_KEYS, snap_keys: Sequence[str] = ("dbid", "snap_id"),
                    extra: Sequence[str] = (), mix_extra: bool = False, **delta_options) -> DataFrame:
    """The whole counter report: snapshot join, sum, delta, variance, filter.

    ``extra`` are further group keys (the latch report's level and hash). They are part of the
    series unless ``mix_extra`` asks for the source report's behaviour, in which rows of one
    snapshot follow each other in a series.
    """
    totals = counter_totals(facts, snapshots, begin, end, value, series, snap_keys, extra)
    if mix_extra:
        return counter_deltas(totals, series, ties=extra, **delta_options)
    return counter_deltas(totals, [*series, *extra], **delta_options)


def series_variance(totals: DataFrame, series: Sequence[str] = SERIES_KEYS, value: str = "wait_time",
                    order: str = "snap_id", slice_snapshots: int = SLICE_SNAPSHOTS) -> DataFrame:
    """(series, row_count, waits_var) of every series that is not constant."""
    cut = _cut(totals, series, order, slice_snapshots, value)
    slices = _with_variance(_slice_table(cut, order, value), _scale(totals, value))
    found = slices.groupBy(*SERIES_KEY).agg(F.sum("_rows").alias("row_count"), F.max("waits_var").alias("waits_var"))
    return found.filter(F.col("waits_var") != 0).select(f"{SERIES}.*", "row_count", "waits_var")


def series_scores(variances: DataFrame, tenant: Sequence[str] = ("con_id",),
                  series: Sequence[str] = ("stat_name", "instance_number"), score: str = "waits_var") -> DataFrame:
    """Mean of ``score`` over the rows of a charted series.

    A charted series may consist of several stored ones (latch levels), each weighted by its rows. Doubles of one power of
    two are added as decimals, the powers (about 2000 at most) in their order: any magnitude keeps its digits and
    the sum does not depend on task order.
    """
    keys = [*tenant, *series]
    weighted = F.col(score) * F.col("row_count")
    power = F.when(weighted > 0, F.floor(F.log2(weighted))).otherwise(F.lit(0)).cast("int")
    parts = (
        variances.select(*keys, score, "row_count", power.alias("_power"),
                         (weighted / F.pow(F.lit(2.0), power)).cast("decimal(20,18)").alias("_part"))
        .groupBy(*keys, "_power")
        .agg(F.sum("_part").cast("double").alias("_part"), F.sum("row_count").alias("_rows"),
             F.min(score).alias("_least"), F.max(score).alias("_most"))
    )
    total = F.aggregate(
        F.sort_array(F.collect_list(F.struct("_power", "_part"))), F.lit(0.0),
        lambda acc, p: acc + p["_part"] * F.pow(F.lit(2.0), p["_power"]))
    mean = F.when(F.min("_least") == F.max("_most"), F.max("_most")).otherwise(total / F.sum("_rows"))
    return parts.groupBy(*keys).agg(mean.alias("score"))


def top_series(variances: DataFrame, tenant: Sequence[str] = ("con_id",),
               series: Sequence[str] = ("stat_name", "instance_number"), k: int = 15,
               include: Sequence[str] = (), exclude: DataFrame | None = None,
               stat: str = "stat_name", exclude_column: str = "name") -> DataFrame:
    """The ``k`` series of largest mean variance per tenant, with their ``series_rank``.

    ``variances`` comes from ``series_variance``: ranking needs no deltas.

    ``exclude`` (for example the idle events) is removed before ranking, within the tenant columns it carries (a
    fleet's releases don't agree on what is idle). ``include`` lists stats
    that stay whatever their rank; they take the ranks after the first ``k``.
    """
    scores = series_scores(variances, tenant, series)
    if exclude is not None:
        within = [c for c in tenant if c in exclude.columns]
        names = exclude.select(*within, F.col(exclude_column).alias(stat)).distinct()
        scores = scores.join(names, [*within, stat], "left_anti")
    order = [F.col("score").desc_nulls_last(), *[F.col(c) for c in series]]
    ranked = W.partitionBy(*tenant).orderBy(*order)
    best = scores.withColumn("series_rank", F.row_number().over(ranked)).filter(F.col("series_rank") <= k)
    if not include:
        return best
    # The listed stats join the best before a second ranking, which sees only these few rows.
    listed = scores.filter(F.col(stat).isin(list(include)))
    both = best.select(*scores.columns).union(listed.select(*scores.columns)).distinct()
    return both.withColumn("series_rank", F.row_number().over(ranked))


def series_label(stat: str = "stat_name", instance: str = "instance_number") -> Column:
    """``stat@instance``."""
    return F.concat(F.col(stat), F.lit("@"), F.col(instance).cast("string"))


def only_series(facts: DataFrame, chosen: DataFrame, tenant: Sequence[str] = ("con_id",),
                series: Sequence[str] = ("stat_name", "instance_number")) -> DataFrame:
    """Facts of the chosen series, so that a second pass sums and sorts little."""
    return facts.join(chosen.select(*tenant, *series), [*tenant, *series], "left_semi")


def series_points(totals: DataFrame, chosen: DataFrame, tenant: Sequence[str] = ("con_id",),
                  series: Sequence[str] = ("stat_name", "instance_number"),
                  keys: Sequence[str] = SERIES_KEYS, **delta_options) -> DataFrame:
    """Deltas of the chosen series only, with rank and label.

    Rows of other series leave before the windows, so these see at most the charted series; facts
    cut by ``only_series`` before their sum spare the sum too.
    """
    names = chosen.select(*tenant, *series, "series_rank")
    kept = totals.join(names, [*tenant, *series]).select(*totals.columns, "series_rank")
    points = counter_deltas(kept, keys, **delta_options)
    return points.withColumn("series", series_label(series[0], series[1])).withColumn(
        "time_label", minute_label(F.col("begin_interval_time"))
    )


def series_matrix(points: DataFrame, slots: int, index: Sequence[str] = ("con_id", "begin_interval_time"),
                  value: str = "wait_time_delta", rank: str = "series_rank") -> DataFrame:
    """Time x series matrix with one column per rank, mean of the values, gaps as 0.

    Columns are ranks, not names: the schema is fixed without a look at the data, and tenants with
    different series share one table. ``series_legend`` maps a rank back to its series. A rank beyond
    ``slots`` stops the job: with listed series, leave room for them after the first k.
    """
    ranks = list(range(1, slots + 1))
    points = points.withColumn(rank, listed(rank, ranks))
    wide = points.groupBy(*index).pivot(rank, ranks).agg(F.avg(F.col(value).cast("double")))
    named = wide.withColumnsRenamed({str(r): f"series_{r:02d}" for r in ranks})
    return named.na.fill(0.0, [f"series_{r:02d}" for r in ranks])


def series_legend(chosen: DataFrame, tenant: Sequence[str] = ("con_id",),
                  series: Sequence[str] = ("stat_name", "instance_number")) -> DataFrame:
    return chosen.select(*tenant, "series_rank", series_label(series[0], series[1]).alias("series"))


def named_matrix(points: DataFrame, names: Sequence[str], index: Sequence[str] = ("begin_interval_time",),
                 value: str = "wait_time_delta") -> DataFrame:
    """Time x series matrix of the series labels a caller picks out."""
    wide = points.groupBy(*index).pivot("series", list(names)).agg(F.avg(F.col(value).cast("double")))
    return wide.na.fill(0.0, list(names))


@dataclass(frozen=True)
class CounterReport:
    """One counter history: which columns of the history table it reads and how."""

    stat: str
    value: str
    extra: tuple[str, ...] = ()
    plotted: str = "wait_time_delta"
    include: tuple[str, ...] = ()
    skip_idle: bool = False
    var_round: int | None = None
    renames: Mapping[str, str] = field(default_factory=dict)


# Statistics always shown in the system-statistics history.
SYSTEM_STATISTICS = (
    "redo writes", "consistent reads", "db block changes", "physical reads", "physical writes", "user calls",
    "parse count (total)", "parse count (hard)", "Logons", "user logons cumulative", "user commits",
    "user rollbacks",
)

# Section name -> stat column, value column, options.
COUNTER_REPORTS = {
    "awr-latches": CounterReport("latch_name", "wait_time", extra=("level#", "latch_hash")),
    "awr-bg-event-wait": CounterReport("event_name", "time_waited_micro"),
    "awr-sga-stat": CounterReport("name", "bytes", plotted="wait_time"),
    "awr-sys-time-model": CounterReport("stat_name", "value"),
    "awr-rac-misc": CounterReport("name", "value"),
    "awr-enqueue-hist": CounterReport("eq_type", "cum_wait_time"),
    "awr-file-statx": CounterReport("filename", "time"),
    "os-stat-hist": CounterReport("stat_name", "value"),
    "sql-stat-hist": CounterReport("sql_id", "elapsed_time_total"),
    "sys-stat-hist": CounterReport("stat_name", "value", include=SYSTEM_STATISTICS),
    "sys-event-hist": CounterReport("event_name", "time_waited_micro", skip_idle=True),
    "awr-time-model-rounded": CounterReport("stat_name", "value", var_round=2),
}


def report_totals(name: str, history: DataFrame, snapshots: DataFrame, begin, end, keys: Sequence[str] = ("con_id",),
                  snap_keys: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Totals and series keys of one of ``COUNTER_REPORTS``; the stat column becomes ``stat_name``."""
    spec = COUNTER_REPORTS[name]
    facts = history.withColumn("stat_name", F.col(spec.stat))
    series = [*keys, "dbid", "instance_number", "stat_name"]
    link = snap_keys or [*(k for k in keys if k == "bundle_id"), "dbid", "snap_id"]
    totals = counter_totals(facts, snapshots, begin, end, spec.value, series, link, spec.extra)
    return totals, series


def counter_report(name: str, history: DataFrame, snapshots: DataFrame, begin, end, keys: Sequence[str] = ("con_id",),
                   snap_keys: Sequence[str] | None = None, mix_extra: bool = False, **options) -> DataFrame:
    """Run one of ``COUNTER_REPORTS`` on its history table: all series with deltas and variance."""
    spec = COUNTER_REPORTS[name]
    totals, series = report_totals(name, history, snapshots, begin, end, keys, snap_keys)
    options.setdefault("var_round", spec.var_round)
    if mix_extra:
        return counter_deltas(totals, series, ties=spec.extra, **options)
    return counter_deltas(totals, [*series, *spec.extra], **options)


def counter_chart(name: str, history: DataFrame, snapshots: DataFrame, begin, end, keys: Sequence[str] = ("con_id",),
                  snap_keys: Sequence[str] | None = None, event_classes: DataFrame | None = None, k: int = 15,
                  **options) -> tuple[DataFrame, DataFrame]:
    """Points and chosen series of a counter report, as its chart shows them.

    Series are ranked by variance first; only the chosen ones get deltas, the last one filled. The
    ranking runs at once and its few rows are kept in the checkpoint folder, because both the
    second pass over the facts and the result use them.
    """
    spec = COUNTER_REPORTS[name]
    totals, series = report_totals(name, history, snapshots, begin, end, keys, snap_keys)
    stored = [*series, *spec.extra]
    idle = None
    if spec.skip_idle and event_classes is not None:
        idle = event_classes.filter(F.col("wait_class") == "Idle")
    chosen = checkpointed(top_series(series_variance(totals, stored), keys, k=k, include=spec.include, exclude=idle))
    options.setdefault("fill_last", True)
    few = only_series(history.withColumn("stat_name", F.col(spec.stat)), chosen, keys)
    again, _ = report_totals(name, few, snapshots, begin, end, keys, snap_keys)
    return series_points(again, chosen, keys, keys=stored, **options), chosen


def section_chart(name: str, rows: DataFrame, event_classes: DataFrame | None = None, keys: Sequence[str] = ("con_id",),
                  k: int = 15, slice_snapshots: int = SLICE_SNAPSHOTS) -> tuple[DataFrame, DataFrame]:
    """Points and chosen series from stored report rows, which carry deltas and variance already.

    This is the chart of a section read from a bundle; ``counter_chart`` starts from the history.
    """
    spec = COUNTER_REPORTS[name]
    idle = None
    if spec.skip_idle and event_classes is not None:
        idle = event_classes.filter(F.col("wait_class") == "Idle")
    ranked = top_series(rows.withColumn("row_count", F.lit(1)), keys, k=k, include=spec.include, exclude=idle)
    chosen = checkpointed(ranked)
    names = chosen.select(*keys, "stat_name", "instance_number", "series_rank")
    kept = rows.join(names, [*keys, "stat_name", "instance_number"])
    series = [*keys, "dbid", "instance_number", "stat_name", *spec.extra]
    slice_expr = F.col("snap_id") - F.pmod(F.col("snap_id"), F.lit(slice_snapshots))
    points = fill_forward(kept, series, "snap_id", "wait_time_delta", slice_expr)
    return points.withColumn("series", series_label()).withColumn(
        "time_label", minute_label(F.col("begin_interval_time"))
    ), chosen
