"""Counter history stored by bundle and day, so that a report reads the days of its range only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fleetscope.operators.counters import snapshot_range

DAY = "day"


def with_day(facts: DataFrame, snapshots: DataFrame, keys: Sequence[str] = ("dbid", "snap_id")) -> DataFrame:
    """Facts with the day on which their snapshot's interval begins; NULL without a snapshot. Instances of a snapshot count as
    their first."""
    days = snapshots.groupBy(*keys).agg(F.min(F.to_date("begin_interval_time")).alias(DAY))
    return facts.join(days, list(keys), "left")


def store_history(facts: DataFrame, snapshots: DataFrame, folder: str, keys: Sequence[str] = ("dbid", "snap_id")) -> None:
    """Write facts below ``folder`` by bundle (if they have one) and day.

    A load brings whole days: it replaces the days it holds and leaves all others alone, so a load that is
    repeated after a failure adds nothing twice. Rows are ordered by snapshot within a file, so that its row groups
    hold narrow ranges of them; a day much larger than the others is split over several files. Facts without a
    snapshot are kept under a NULL day, which no range reads.
    """
    parts = [*(c for c in ("bundle_id",) if c in facts.columns), DAY]
    rows = with_day(facts, snapshots, keys).hint("rebalance", *parts).sortWithinPartitions(*parts, "snap_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(folder)


def read_history(spark: SparkSession, folder: str, snapshots: DataFrame, begin, end,
                 keys: Sequence[str] = ("dbid", "snap_id")) -> DataFrame:
    """Stored facts of the days that [begin, end] touches, for ``counter_totals`` over the same range.

    The days are a filter on folders when the query is planned. The numbers of the first and last snapshot of the range are looked up when
    it runs and cut row groups and rows. What is left beyond the range goes in the join with the snapshots.
    """
    found = spark.read.parquet(folder).schema
    text = {"bundle_id": T.StringType()}  # folder names like 007 are names
    schema = T.StructType([T.StructField(f.name, text.get(f.name, f.dataType)) for f in found.fields])
    bounds = snapshot_range(snapshots, begin, end, keys).agg(F.min("snap_id").alias("low"), F.max("snap_id").alias("high"))
    return spark.read.schema(schema).parquet(folder).filter(
        F.col(DAY).between(F.to_date(F.lit(begin).cast("timestamp_ntz")), F.to_date(F.lit(end).cast("timestamp_ntz")))
        & F.col("snap_id").between(bounds.select("low").scalar(), bounds.select("high").scalar())
    ).drop(DAY)
