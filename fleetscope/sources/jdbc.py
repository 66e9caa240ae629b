"""Reading source views over JDBC.

Not run in the test environment, which has no database; tests cover the reader's options and use
Parquet as a stand-in.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetscope.functions.labels import lower_names

FETCH_ROWS = 1000


def reader_options(url: str, view: str, properties: Mapping[str, str] | None = None,
                   partition_column: str | None = None, lower: int | str | None = None,
                   upper: int | str | None = None, partitions: int | None = None,
                   fetch_rows: int = FETCH_ROWS) -> dict[str, str]:
    """Options of one view's scan. With a partition column the scan runs as parallel range reads."""
    options = {"url": url, "dbtable": view, "fetchsize": str(fetch_rows), "pushDownPredicate": "true",
               **(properties or {})}
    if partition_column is not None:
        if None in (lower, upper, partitions):
            raise ValueError("a partitioned scan needs lower, upper and partitions")
        options |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
                    "numPartitions": str(partitions)}
    return options


def read_view(spark: SparkSession, url: str, view: str, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """A view with lower-case names; the projection and later filters are pushed to the database."""
    scan = spark.read.format("jdbc").options(**reader_options(url, view, **options)).load()
    named = lower_names(scan)
    return named if columns is None else named.select(*columns)


def read_fleet(spark: SparkSession, urls: Mapping[str, str], view: str, **options) -> DataFrame:
    """The same view of many databases, told apart by ``bundle_id``."""
    scans = [
        read_view(spark, url, view, **options).withColumn("bundle_id", F.lit(bundle)) for bundle, url in urls.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def between_dates(df: DataFrame, column: str, begin, end) -> DataFrame:
    """Bind values of a history scan as a filter, inclusive at both ends."""
    return df.filter(F.col(column).between(F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
