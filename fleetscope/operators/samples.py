"""Load from activity samples: peak sessions per bucket, mean active sessions by state class."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.functions.times import bucket_start
from fleetscope.operators.dims import sorted_by
from fleetscope.operators.reshape import listed


def in_range(samples: DataFrame, ts: str, begin, end) -> DataFrame:
    """Samples with ``begin <= ts <= end``; the filter reaches the file scan."""
    return samples.filter(F.col(ts).between(F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def peak_load(sources: Sequence[DataFrame], begin, end, keys: Sequence[str] = ("con_id",), ts: str = "sample_time",
              fine: str = "1 second", coarse: str = "10 minutes") -> DataFrame:
    """Largest number of samples per ``fine`` step within each ``coarse`` bucket.

    Each source (live, persisted) is counted on its own, and the maximum over both is taken, so
    a sample present in both sources does not count twice. Both aggregations combine before their
    shuffle; the second one receives at most one row per task, key and bucket.
    """
    tagged = [
        in_range(df, ts, begin, end).select(*keys, F.col(ts).alias("_ts"), F.lit(i).alias("_source"))
        for i, df in enumerate(sources)
    ]
    merged = reduce(DataFrame.unionByName, tagged)
    steps = merged.groupBy("_source", *keys, bucket_start(F.col("_ts"), fine).alias("_step")).agg(
        F.count(F.lit(1)).alias("_count")
    )
    return steps.groupBy(*keys, bucket_start(F.col("_step"), coarse).alias("bucket")).agg(
        F.max("_count").alias("sess_count")
    )


def ten_minute_text(bucket: Column) -> Column:
    """Bucket start as ``yyyy-MM-dd HH:mm``, the reports' text form."""
    return F.date_format(bucket, "yyyy-MM-dd HH:mm")


def perf_load(sources: Sequence[DataFrame], begin, end, keys: Sequence[str] = ("con_id",),
              ts: str = "sample_time", ordered: bool = True) -> DataFrame:
    """Peak concurrent active sessions per ten minutes, in the report's columns and order."""
    peaks = peak_load(sources, begin, end, keys, ts)
    shown = peaks.select(*keys, ten_minute_text(F.col("bucket")).alias("ten_min_timestr"), "sess_count")
    return sorted_by(shown, *keys, "ten_min_timestr", ordered=ordered)


def load_matrix(load: DataFrame, tenants: Sequence[str], index: str = "ten_min_timestr", name: str = "name",
                value: str = "sess_count") -> DataFrame:
    """Bucket x tenant matrix, gaps as 0. One value per cell is expected, so ``max`` just moves it. A tenant that is not
    in ``tenants`` stops the job."""
    wide = load.withColumn(name, listed(name, tenants)).groupBy(index).pivot(name, list(tenants)).agg(F.max(F.col(value).cast("double")))
    return wide.na.fill(0.0, list(tenants))


def wait_state(session_state: str = "session_state", wait_class: str = "wait_class") -> Column:
    """State class of a sample: CPU, IO, CLUSTER or WAIT."""
    waiting = F.col(session_state) == "WAITING"
    return (
        F.when(F.col(session_state) == "ON CPU", "CPU")
        .when(waiting & (F.col(wait_class) == "User I/O"), "IO")
        .when(waiting & (F.col(wait_class) == "Cluster"), "CLUSTER")
        .otherwise("WAIT")
    )


def active_by_state(samples: DataFrame, begin, end, state: Column | None = None, keys: Sequence[str] = ("con_id",),
                    ts: str = "sample_time", bucket: str = "1 hour", samples_per_bucket: int = 360,
                    foreground: Column | None = None) -> DataFrame:
    """Mean active sessions per bucket and state class: sample count over samples per bucket.

    360 samples per hour is the source's ten-second period.
    """
    wanted = F.col("session_type") == "FOREGROUND" if foreground is None else foreground
    label = wait_state() if state is None else state
    return (
        in_range(samples, ts, begin, end)
        .filter(wanted)
        .groupBy(*keys, bucket_start(F.col(ts), bucket).alias("tm"), label.alias("state"))
        .agg((F.count(F.lit(1)) / F.lit(samples_per_bucket)).alias("sess_cnt"))
    )


def state_matrix(states: DataFrame, tenants: Sequence, name: str = "name") -> DataFrame:
    """(bucket, state) x tenant matrix of rounded means, gaps as 0. A tenant that is not in ``tenants`` stops the job."""
    states = states.withColumn(name, listed(name, tenants))
    rounded = states.withColumn("sess_cnt", F.bround(F.coalesce(F.col("sess_cnt"), F.lit(0.0)), 0))
    names = [str(t) for t in tenants]
    return rounded.groupBy("tm", "state").pivot(name, list(tenants)).agg(F.avg("sess_cnt")).na.fill(0.0, names)
