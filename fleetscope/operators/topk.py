"""Top-k statements per tenant, by one measure or by many in one pass."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetscope.functions.nulls import try_ratio
from fleetscope.operators.dims import with_value


@dataclass(frozen=True)
class Measure:
    """A statement measure; with ``per`` it is the per-execution ratio."""

    name: str
    column: str
    per: str | None = None

    def value(self) -> Column:
        base = F.col(self.column)
        return base if self.per is None else try_ratio(base, F.col(self.per))

    def guard(self, executions: str) -> Column:
        """Positive measure and at least one execution; also keeps the division defined."""
        return (F.col(self.column) > 0) & (F.col(executions) > 0)


# Section name -> (column, divisor).
STATEMENT_MEASURES = {
    m.name: m
    for m in [
        Measure("topsql-exec", "executions"),
        Measure("topsql-sort", "sorts"),
        Measure("topsql-shmemory", "sharable_mem"),
        Measure("topsql-pxexec", "px_servers_executions"),
        Measure("topsql-invalids", "invalidations"),
        Measure("topsql-parse", "parse_calls"),
        Measure("topsql-phr-reads", "disk_reads"),
        Measure("topsql-buffer-get", "buffer_gets"),
        Measure("topsql-app-wait", "application_wait_time"),
        Measure("topsql-concurrent-wait", "concurrency_wait_time"),
        Measure("topsql-cluster-wait", "cluster_wait_time"),
        Measure("topsql-user-iowait", "user_io_wait_time"),
        Measure("topsql-rows", "rows_processed"),
        Measure("topsql-cpu", "cpu_time"),
        Measure("topsql-elapse", "elapsed_time"),
        Measure("topsql-sort-exec", "sorts", "executions"),
        Measure("topsql-parse-exec", "parse_calls", "executions"),
        Measure("topsql-gets-exec", "buffer_gets", "executions"),
        Measure("topsql-phread-exec", "disk_reads", "executions"),
        Measure("topsql-appwait-exec", "application_wait_time", "executions"),
        Measure("topsql-concurrwait-exec", "concurrency_wait_time", "executions"),
        Measure("topsql-clustwait-exec", "cluster_wait_time", "executions"),
        Measure("topsql-userio-exec", "user_io_wait_time", "executions"),
        Measure("topsql-rows-exec", "rows_processed", "executions"),
        Measure("topsql-cpu-exec", "cpu_time", "executions"),
        Measure("topsql-elapsed-exec", "elapsed_time", "executions"),
    ]
}


# Sums of quotients are shown with so many places.
RATIO_PLACES = 6


def measure_sum(measure: Measure, positive_only: bool = False) -> Column:
    """Summed measure; ``positive_only`` leaves rows without a positive measure out of the sum.

    Quotients are cut into their whole part, millionths and millionths of these, and each is added as a whole number: a sum does
    not depend on the order in which tasks deliver its parts, and whole numbers add fast.
    """
    value = F.when(F.col(measure.column) > 0, measure.value()) if positive_only else measure.value()
    if measure.per is None:
        return F.sum(value)
    million = F.lit(1e6)
    fraction = (value - F.floor(value)) * million
    parts = [F.floor(value), F.floor(fraction), F.round((fraction - F.floor(fraction)) * million).cast("bigint")]
    whole, micro, rest = (F.sum(p).cast("double") for p in parts)
    return F.round(whole + (micro + rest / million) / million, RATIO_PLACES)


def top_per_group(df: DataFrame, keys: Sequence[str], value: str, k: int, ties: Sequence[str] = (),
                  rank: str = "count_sql") -> DataFrame:
    """First ``k`` rows of each group by ``value`` descending, ``ties`` ascending after it.

    The rank filter lets Spark cut each map partition to ``k`` rows per group before the
    exchange, so a group that holds most rows still sends ``k`` rows per task.
    """
    order = [F.col(value).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def top_overall(df: DataFrame, value: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows by ``value`` descending: a top-k heap per task, no global sort."""
    order = [F.col(value).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    return df.orderBy(*order).limit(k)


def top_within(df: DataFrame, within: Sequence[str], value: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows of each ``within`` (a fleet's bundle), of all rows without one."""
    if not within:
        return top_overall(df, value, k, ties)
    return top_per_group(df, within, value, k, ties, rank="_rank").drop("_rank")


def topk_statements(statements: DataFrame, measure: Measure, keys: Sequence[str] = ("con_id",),
                    item: Sequence[str] = ("sql_id", "sql_text"), executions: str = "executions",
                    k: int = 5) -> DataFrame:
    """Statements with the largest summed measure, ``k`` per tenant or ``k`` overall."""
    summed = (
        statements.filter(measure.guard(executions))
        .groupBy(*keys, *item)
        .agg(measure_sum(measure).alias("value"))
    )
    return top_per_group(summed, keys, "value", k, item) if keys else top_overall(summed, "value", k, item)


def topk_statements_all(statements: DataFrame, measures: Iterable[Measure] = tuple(STATEMENT_MEASURES.values()),
                        keys: Sequence[str] = ("con_id",), item: Sequence[str] = ("sql_id", "sql_text"),
                        executions: str = "executions", k: int = 5, buckets: int = 64) -> DataFrame:
    """All measures from one scan and one aggregation: rows (measure, tenant, statement, value, rank).

    Ranking every statement under every measure would sort (statements x measures) rows. Instead
    statements are hashed into ``buckets``; the ``k``-th largest bucket maximum of a measure is
    a value that at least ``k`` statements reach, so smaller ones cannot be among the first ``k``.
    Only statements at or above it, a few per tenant and measure, become long rows and are ranked.
    """
    chosen = list(measures)
    names = [m.name for m in chosen]
    sums = [measure_sum(m, positive_only=True).alias(m.name) for m in chosen]
    bucket = F.pmod(F.xxhash64(*item), F.lit(buckets))
    # Rows gather by statement before they are summed: three sums a quotient are kept where its rows lie together, not in every task of
    # the scan. The hash is no grouping key, so a part that one large statement fills is split, and a second stage adds its sums up.
    used = dict.fromkeys([*keys, *item, *(c for m in chosen for c in (m.column, m.per) if c)])
    rows = statements.filter(F.col(executions) > 0).select(*used, F.hash(*keys, *item).alias("_statement"))
    sums_of = rows.hint("rebalance", "_statement").groupBy(*keys, *item).agg(*sums)
    # Dealt out by tenant and bucket once, for the maxima and for the join: a hot tenant is spread over its buckets. The tenant is
    # one struct, whose NULL parts compare as equal, and the bucket needs the statement's columns, so both sides read one shuffle.
    tenant = ["_tenant"] if keys else []
    of_tenant = [F.struct(*keys).alias("_tenant")] if keys else []
    summed = sums_of.select(*of_tenant, *item, *[F.col(f"`{n}`") for n in names]).repartition(*tenant, bucket)
    summed = summed.withColumn("_bucket", bucket)
    maxima = (
        summed.groupBy(*tenant, "_bucket")
        .agg(*[F.max(f"`{n}`").alias(n) for n in names])
        .groupBy(*tenant)
        .agg(*[F.sort_array(F.collect_list(f"`{n}`"), asc=False).alias(n) for n in names])
    )
    # A missing k-th maximum gives NULL: the tenant has few statements, all of them stay.
    bounds = maxima.select(*tenant, F.array(*[F.get(f"`{n}`", F.lit(k - 1)).cast("double") for n in names]).alias("_bounds"))
    if keys:
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))).alias("_bucket")
        joined = summed.join(bounds.select("*", each), ["_tenant", "_bucket"], "left")
    else:
        joined = with_value(summed, bounds, "_bounds", "_bounds", required=False)
    entries = [
        F.when(
            F.col(f"`{n}`").cast("double") >= F.coalesce(F.col("_bounds")[i], F.lit(float("-inf"))),
            F.struct(F.lit(n).alias("measure"), F.col(f"`{n}`").cast("decimal(38,6)").alias("value")),
        )
        for i, n in enumerate(names)
    ]
    of_keys = [F.col("_tenant").getField(c).alias(c) for c in keys]
    tall = joined.select(*of_keys, *item, F.inline(F.array_compact(F.array(*entries))))
    return top_per_group(tall, ["measure", *keys], "value", k, item)


def statements_to_pin(statements: DataFrame, keys: Sequence[str] = ("con_id",), min_bytes: int = 190000,
                      k: int = 15, within: Sequence[str] = ()) -> DataFrame:
    """Large statements loaded more often than invalidated, most loads first: ``k`` in all or ``k`` of each ``within``."""
    return top_within(
        statements.filter((F.col("loads") > F.col("invalidations")) & (F.col("sharable_mem") > min_bytes))
        .groupBy(*keys, "sql_text")
        .agg(*[F.sum(c).alias(c) for c in ("sharable_mem", "invalidations", "loads")]),
        within, "loads", k, [*keys, "sql_text"],
    )


# Owners and object types of the pin report.
PIN_SKIPPED_OWNERS = ["SYS", "MDSYS", "CTXSYS", "DBSNMP"]
PIN_TYPES = ["PACKAGE", "PACKAGE BODY", "FUNCTION", "PROCEDURE"]


def code_to_pin(object_cache: DataFrame, keys: Sequence[str] = ("con_id",), min_bytes: int = 1000,
                min_executions: int = 10, k: int = 15, within: Sequence[str] = ()) -> DataFrame:
    """Stored code worth keeping in memory, largest first: ``k`` in all or ``k`` of each ``within``."""
    wanted = (
        (F.col("sharable_mem") > min_bytes)
        & (F.col("executions") > min_executions)
        & ~F.col("owner").isin(PIN_SKIPPED_OWNERS)
        & F.col("type").isin(PIN_TYPES)
        & (F.col("kept") == "NO")
    )
    group = [*keys, "owner", "name", "type"]
    summed = object_cache.filter(wanted).groupBy(*group).agg(F.sum("sharable_mem").alias("sharable_mem"))
    return top_within(summed, within, "sharable_mem", k, group)


def statement_area_summary(area: DataFrame, instances: DataFrame, keys: Sequence[str] = ("con_id",),
                           link: Sequence[str] = ()) -> DataFrame:
    """Statement counts, memory and times per instance and tenant, with the single-use share.

    ``instances`` maps ``inst_id`` to ``instance_name``; ``link`` names further join keys.
    The aggregation runs first, so the join sees one row per (instance, tenant).
    """
    single = F.col("executions") == 1
    group = list(dict.fromkeys([*link, "inst_id", *keys]))
    summed = area.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_sql"),
        F.sum("sharable_mem").alias("totalsqlmem"),
        F.sum(F.when(single, 1).otherwise(0)).alias("singleusesql"),
        F.sum(F.when(single, F.col("sharable_mem")).otherwise(0)).alias("singleusesqlmem"),
        F.sum("version_count").alias("totalcurs"),
        F.sum("cpu_time").alias("cputime"),
        F.sum("elapsed_time").alias("elapsetime"),
    )
    named = summed.join(instances.select(*link, "inst_id", "instance_name"), [*link, "inst_id"])
    lead = list(dict.fromkeys([*link, "instance_name", *keys]))
    return named.select(*lead, *[c for c in summed.columns if c not in group])
