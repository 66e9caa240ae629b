"""Tablespace usage, file overview, file I/O and recovery-area reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.functions.nulls import greatest_nn
from fleetscope.functions.numbers import to_mb, used_percent, whole_mb
from fleetscope.operators.reshape import metric_columns

TEMP_METRICS = ["filesize", "maxsize", "usedbytes", "pctfree"]


def extendable_size(size: str = "bytes", limit: str = "maxbytes", autoextensible: str = "autoextensible") -> Column:
    """Size a file can reach: its present size unless it may grow beyond."""
    return F.when(F.col(autoextensible) == "NO", F.col(size)).otherwise(
        greatest_nn(F.col(size), F.col(limit))
    )


def tablespace_usage(tablespaces: DataFrame, files: DataFrame, free_space: DataFrame, contents: str = "PERMANENT",
                     keys: Sequence[str] = ("con_id",)) -> DataFrame:
    """Size, reachable size and free bytes per tablespace of one kind (PERMANENT, UNDO).

    Free extents are summed per file before they meet the files, so a file with very many extents
    costs one row in the join.
    """
    name = [*keys, "tablespace_name"]
    file_key = [*name, "file_id", "relative_fno"]
    wanted = tablespaces.filter(F.col("contents") == contents).select(*name)
    free = free_space.groupBy(*file_key).agg(F.sum("bytes").alias("free_bytes"))
    sized = files.join(wanted, name).select(*file_key, "bytes", extendable_size().alias("reach"))
    return (
        sized.join(free, file_key, "left")
        .groupBy(*name)
        .agg(
            F.sum("bytes").alias("file_size"),
            F.sum("reach").alias("file_max_size"),
            F.sum(F.coalesce("free_bytes", F.lit(0))).alias("file_free_space"),
        )
    )


def usage_in_mb(usage: DataFrame, percent: bool = True) -> DataFrame:
    """Byte columns in MB with two places, plus the used percentage."""
    scaled = usage.withColumns({c: to_mb(F.col(c)) for c in ("file_size", "file_max_size", "file_free_space")})
    if not percent:
        return scaled
    return scaled.withColumn("usage_percent", used_percent(F.col("file_free_space"), F.col("file_size")))


def temp_usage_wide(temp_files: DataFrame, tablespaces: DataFrame, sort_usage: DataFrame,
                    keys: Sequence[str] = ("con_id",)) -> DataFrame:
    """Per temporary tablespace: filesize, maxsize, usedbytes, pctfree in one row."""
    name = [*keys, "tablespace_name"]
    larger = F.when(F.col("bytes") > F.col("maxbytes"), F.col("bytes")).otherwise(F.col("maxbytes"))
    limit = F.when(F.col("autoextensible") == "NO", F.col("bytes")).otherwise(larger)
    files = temp_files.groupBy(*name).agg(F.sum("bytes").alias("filesize"), F.sum(limit).alias("_limit"))
    used = sort_usage.groupBy(*keys, F.col("tablespace").alias("tablespace_name")).agg(
        F.sum("blocks").alias("_blocks")
    )
    temporary = (
        tablespaces.filter(F.col("contents") == "TEMPORARY")
        .select(*name, "block_size")
        .join(used, name, "left")
        .select(*name, F.coalesce(F.col("_blocks") * F.col("block_size"), F.lit(0)).alias("usedbytes"),
                F.lit(True).alias("_known"))
    )
    free = (F.col("filesize") - F.coalesce("usedbytes", F.lit(0))) * 100
    return files.join(temporary, name, "full").select(
        *name,
        "filesize",
        F.when(F.col("_known"), F.col("_limit")).alias("maxsize"),
        "usedbytes",
        F.round(F.try_divide(free, F.col("filesize"))).cast("bigint").alias("pctfree"),
    )


def temp_usage(temp_files: DataFrame, tablespaces: DataFrame, sort_usage: DataFrame,
               keys: Sequence[str] = ("con_id",)) -> DataFrame:
    """The same as long rows (tablespace, param, value); a metric without a value has no row."""
    wide = temp_usage_wide(temp_files, tablespaces, sort_usage, keys)
    return wide.unpivot([*keys, "tablespace_name"], TEMP_METRICS, "param", "value").filter(
        F.col("value").isNotNull()
    )


def temp_usage_matrix(long_rows: DataFrame, ids: Sequence[str] = ("con_id", "tablespace_name")) -> DataFrame:
    """Long temp metrics back to one row per tablespace, sizes in MB."""
    wide = metric_columns(long_rows, ids, TEMP_METRICS, "param", "value")
    return wide.withColumns({c: to_mb(F.col(c)) for c in ("filesize", "maxsize", "usedbytes")})


def file_overview(files: DataFrame, keys: Sequence[str] = ("con_id",), tablespace: str = "ts#",
                  size: str = "bytes", within: Sequence[str] = ()) -> DataFrame:
    """Number of files, total MB and number of tablespaces over all rows, or of each ``within`` (a fleet's bundle)."""
    parts = [F.col(c) for c in (*keys, tablespace)]
    more = [c for c in within if c not in keys]
    per_space = files.groupBy(*more, *parts).agg(F.count(F.lit(1)).alias("_files"), F.sum(size).alias("_bytes"))
    # A tablespace with a NULL in its key does not count.
    known = F.when(sum([p.isNull().cast("int") for p in parts], F.lit(0)) == 0, 1)
    return per_space.groupBy(*within).agg(
        F.coalesce(F.sum("_files"), F.lit(0)).alias("file_count"),
        (F.sum("_bytes") / F.lit(1048576)).alias("total_mb"),
        F.count(known).alias("tablespace_count"),
    )


# Statistics of the file I/O reports.
FILE_STATISTICS = ["phyrds", "phywrts", "singleblkrds", "readtim", "writetim", "singleblkrdtim", "avgiotim",
                   "lstiotim", "miniotim", "maxiortm", "maxiowtm"]


def file_io(files: DataFrame, statistics: DataFrame, keys: Sequence[str] = ("con_id",),
            link: Sequence[str] = ("file#",), columns: Sequence[str] = tuple(FILE_STATISTICS)) -> DataFrame:
    """I/O statistics per data or temp file, by file name."""
    named = files.select(*dict.fromkeys([*keys, *link]), F.col("name").alias("file_name"))
    return named.join(statistics.select(*link, *columns), list(link)).select(*keys, "file_name", *columns)


def redo_logs(groups: DataFrame, members: DataFrame, link: Sequence[str] = ()) -> DataFrame:
    """Redo log groups with their members."""
    keys = [*link, "group#"]
    return groups.join(members.select(*keys, "member"), keys).select(
        *link, F.col("group#").alias("group_id"), F.col("thread#").alias("thread_id"), "bytes", "archived",
        "status", "member",
    )


def recovery_area_mb(area: DataFrame, limit: str = "space_limit", used: str = "space_used") -> DataFrame:
    """Recovery-area limit and use in whole MB, row by row."""
    return area.withColumns({limit: whole_mb(F.col(limit)), used: whole_mb(F.col(used))})
