"""The operators bound to the TPC-H-like test tables.

Each function projects test tables into the columns of a source section and runs the same operator
a report runs on real sections. ``QUERIES`` maps the query name to (spark, folder) -> DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from fleetscope.functions import labels, numbers, times
from fleetscope.functions.nulls import concat_nn
from fleetscope.operators import (
    classify, config, counter_state, counters, dims, forest, indexes, memory, reshape, samples, sessions, storage, topk,
)
from fleetscope.operators.topk import Measure
from fleetscope.plans import reports, views
from fleetscope.session import checkpointed, mounted_path, shared_folder
from fleetscope.sources import bundles, history as stored, sinks
from fleetscope.streaming import deltas, load as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINES_BEGIN, LINES_END = "1990-01-01", "2010-01-01"
EVENTS_BEGIN, EVENTS_END = "2023-01-01", "2025-01-01"
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(column: str) -> Column:
    """Money or rate with two decimals as a whole number."""
    return F.round(F.col(column) * 100).cast("bigint")


def whole(column: str) -> Column:
    return F.col(column).cast("bigint")


def text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def as_double(df: DataFrame, column: str, digits: int | None = None) -> DataFrame:
    value = F.col(column).cast("double")
    return df.withColumn(column, value if digits is None else F.round(value, digits))


# ---------------------------------------------------------------- top-k statements


def statements(spark: SparkSession, folder: str, *more: Column) -> DataFrame:
    """Line items as statements: tenant = return flag, statement = part."""
    return table(spark, folder, "lineitem").select(
        *more,
        F.col("l_returnflag").alias("con_id"),
        F.col("l_partkey").alias("sql_id"),
        F.concat(F.lit("stmt "), text("l_partkey")).alias("sql_text"),
        whole("l_linenumber").alias("executions"),
        whole("l_quantity").alias("sorts"),
        cents("l_extendedprice").alias("sharable_mem"),
        (whole("l_linenumber") % 3).alias("px_servers_executions"),
        (whole("l_suppkey") % 2).alias("invalidations"),
        (whole("l_suppkey") % 5).alias("loads"),
        (whole("l_quantity") + whole("l_linenumber")).alias("parse_calls"),
        cents("l_discount").alias("disk_reads"),
        (cents("l_extendedprice") * 2 + whole("l_linenumber")).alias("buffer_gets"),
        cents("l_tax").alias("application_wait_time"),
        (cents("l_tax") * whole("l_quantity")).alias("concurrency_wait_time"),
        (cents("l_discount") * whole("l_quantity")).alias("cluster_wait_time"),
        (whole("l_suppkey") % 7).alias("user_io_wait_time"),
        (whole("l_quantity") * whole("l_linenumber")).alias("rows_processed"),
        (cents("l_extendedprice") + whole("l_quantity")).alias("cpu_time"),
        (cents("l_extendedprice") * whole("l_linenumber")).alias("elapsed_time"),
    )


@query
def topk_total_per_tenant(spark, folder):
    return topk.topk_statements(statements(spark, folder), Measure("quantity", "sorts"), item=["sql_id"])


@query
def topk_total_global(spark, folder):
    return topk.topk_statements(statements(spark, folder), Measure("quantity", "sorts"), keys=(), item=["sql_id"])


@query
def topk_ratio_per_tenant(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("con_id"), F.col("l_partkey").alias("sql_id"),
        F.col("l_extendedprice").alias("price"), whole("l_quantity").alias("executions"),
    )
    found = topk.topk_statements(lines, Measure("unit price", "price", "executions"), item=["sql_id"])
    return as_double(found, "value")


@query
def topk_multi_measure(spark, folder):
    chosen = [
        Measure("quantity", "sorts"), Measure("price", "sharable_mem"),
        Measure("discount", "disk_reads"), Measure("price per line", "sharable_mem", "executions"),
    ]
    found = topk.topk_statements_all(statements(spark, folder), chosen, item=["sql_id"])
    return as_double(found, "value")


@query
def topk_all_statement_measures(spark, folder):
    return as_double(topk.topk_statements_all(statements(spark, folder)), "value")


@query
def statement_sections_fanout(spark, folder):
    """All 26 statement sections in one write, read back section by section."""
    out = shared_folder(spark, "fanout")
    scope = reports.Scope(as_of=LINES_END, begin=LINES_BEGIN, end=LINES_END)
    where = reports.write_reports({"statements": statements(spark, folder)}, scope, out, list(topk.STATEMENT_MEASURES))
    parts = [
        sinks.read_section(spark, out, name, group=group).select(F.lit(name).alias("section"), "con_id", "sql_id", "sql_text", "value", "count_sql")
        for name, group in where.items()
    ]
    return as_double(reduce(DataFrame.unionByName, parts), "value")


@query
def topk_threshold_first15(spark, folder):
    kinds = {"ECONOMY": "PACKAGE", "SMALL": "PACKAGE BODY", "LARGE": "FUNCTION", "MEDIUM": "PROCEDURE"}
    kind = reduce(lambda acc, kv: acc.when(F.col("p_type") == kv[0], kv[1]), kinds.items(), F.when(F.lit(False), ""))
    objects = table(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).select(
        F.col("l_returnflag").alias("con_id"),
        F.when(F.col("p_brand") == "Brand#1", "SYS").otherwise(F.col("p_brand")).alias("owner"),
        F.col("p_name").alias("name"),
        kind.otherwise(F.col("p_type")).alias("type"),
        cents("l_extendedprice").alias("sharable_mem"),
        whole("l_quantity").alias("executions"),
        F.when(F.col("l_linestatus") == "O", "NO").otherwise("YES").alias("kept"),
    )
    return topk.code_to_pin(objects)


@query
def statements_pin_first15(spark, folder):
    return topk.statements_to_pin(statements(spark, folder))


@query
def pin_first15_fleet(spark, folder):
    """Fifteen statements of each database of a fleet; the line status stands for the bundle."""
    lines = statements(spark, folder, F.col("l_linestatus").alias("bundle_id"))
    return topk.statements_to_pin(lines, ("bundle_id", "con_id"), within=("bundle_id",))


@query
def statement_summary(spark, folder):
    area = statements(spark, folder).select(
        "con_id", (F.col("sql_id") % 5).cast("int").alias("inst_id"), F.col("sorts").alias("executions"),
        "sharable_mem", F.col("parse_calls").alias("version_count"), "cpu_time", "elapsed_time",
    )
    return topk.statement_area_summary(area, instances(spark, folder))


# ---------------------------------------------------------------- counter history


def counter_facts(spark, folder, stat: Column, instance: Column, *extra: Column) -> DataFrame:
    """Cumulative quantity per month: tenant = return flag, one snapshot per month."""
    lines = table(spark, folder, "lineitem")
    names = [c for c in ("extra_1", "extra_2")][: len(extra)]
    keys = ["con_id", "dbid", "instance_number", "stat_name", *names]
    month = F.year("l_shipdate").cast("bigint") * 12 + F.month("l_shipdate")
    monthly = (
        lines.select(
            F.col("l_returnflag").alias("con_id"), F.lit(1).cast("bigint").alias("dbid"),
            instance.cast("int").alias("instance_number"), stat.cast("string").alias("stat_name"),
            *[c.alias(n) for c, n in zip(extra, names)], month.alias("snap_id"), whole("l_quantity").alias("quantity"),
        )
        .groupBy(*keys, "snap_id")
        .agg(F.sum("quantity").alias("quantity"))
    )
    # One row per series and month: the running total sees at most the months of the table.
    running = W.partitionBy(*keys).orderBy("snap_id").rowsBetween(W.unboundedPreceding, 0)
    return monthly.select(*keys, "snap_id", F.sum("quantity").over(running).alias("value"))


def month_snapshots(spark, folder) -> DataFrame:
    begin = times.ntz(F.date_trunc("month", F.col("l_shipdate")))
    return (
        table(spark, folder, "lineitem").select(begin.alias("begin_interval_time")).distinct()
        .select(
            F.lit(1).cast("bigint").alias("dbid"),
            (F.year("begin_interval_time").cast("bigint") * 12 + F.month("begin_interval_time")).alias("snap_id"),
            "begin_interval_time",
            (F.col("begin_interval_time") + F.make_ym_interval(F.lit(0), F.lit(1))).alias("end_interval_time"),
        )
    )


def by_status(spark, folder):
    return counter_facts(spark, folder, F.col("l_linestatus"), F.col("l_suppkey") % 4)


def by_supplier(spark, folder):
    return counter_facts(spark, folder, F.col("l_suppkey"), F.col("l_partkey") % 4)


def history(spark, folder, facts: DataFrame, begin: str = LINES_BEGIN, end: str = LINES_END, **options) -> DataFrame:
    return counters.counter_history(facts, month_snapshots(spark, folder), begin, end, **options)


def supplier_totals(spark, folder) -> DataFrame:
    return counters.counter_totals(by_supplier(spark, folder), month_snapshots(spark, folder), LINES_BEGIN, LINES_END)


def supplier_top(spark, folder, **options) -> DataFrame:
    return counters.top_series(counters.series_variance(supplier_totals(spark, folder)), **options)


@query
def counter_delta(spark, folder):
    return history(spark, folder, by_status(spark, folder), keep_constant=True).drop("waits_var")


@query
def counter_delta_short_slices(spark, folder):
    """Same result with slices of 5 snapshots, so that most rows take part in a border."""
    return history(spark, folder, by_status(spark, folder), keep_constant=True, slice_snapshots=5).drop("waits_var")


@query
def counter_variance_filter(spark, folder):
    facts = counter_facts(spark, folder, F.col("l_partkey"), F.col("l_suppkey") % 4)
    kept = history(spark, folder, facts, var_round=2)
    return kept.select("con_id", "instance_number", "stat_name", "snap_id", "wait_time", "waits_var")


@query
def counter_latch_keys(spark, folder):
    facts = latch_facts(spark, folder)
    return counters.counter_report("awr-latches", facts, month_snapshots(spark, folder), LINES_BEGIN, LINES_END).drop(
        "waits_var")


@query
def counter_latch_mixed(spark, folder):
    """Latch rows of one snapshot follow each other in a series, as the source report has it."""
    facts = latch_facts(spark, folder)
    return counters.counter_report("awr-latches", facts, month_snapshots(spark, folder), LINES_BEGIN, LINES_END,
                                   mix_extra=True).drop("waits_var")


def latch_facts(spark, folder):
    facts = counter_facts(spark, folder, F.col("l_suppkey") % 3, F.col("l_suppkey") % 2, F.col("l_linenumber") % 3,
                          F.col("l_linestatus"))
    return facts.withColumnsRenamed(
        {"stat_name": "latch_name", "extra_1": "level#", "extra_2": "latch_hash", "value": "wait_time"}
    )


@query
def counter_variance_rounded(spark, folder):
    return counters.counter_report("awr-time-model-rounded", by_status(spark, folder),
                                   month_snapshots(spark, folder), LINES_BEGIN, LINES_END)


@query
def counter_snapshot_join(spark, folder):
    return counters.counter_totals(by_status(spark, folder), month_snapshots(spark, folder), "1997-01-01", "1999-01-01")


def month_range(facts: DataFrame, begin: str, end: str) -> DataFrame:
    """Facts of the months from ``begin`` up to, not including, ``end``."""
    first, last = (int(d[:4]) * 12 + int(d[5:7]) for d in (begin, end))
    return facts.filter((F.col("snap_id") >= first) & (F.col("snap_id") < last))


@query
def counter_pruned_history(spark, folder):
    """Two years of a history stored by day, which reads the folders of these two years."""
    out, snaps = shared_folder(spark, "history"), month_snapshots(spark, folder)
    stored.store_history(by_status(spark, folder), snaps, out)
    facts = stored.read_history(spark, out, snaps, "1997-01-01", "1999-01-01")
    return counters.counter_history(facts, snaps, "1997-01-01", "1999-01-01", keep_constant=True).drop("waits_var")


@query
def counter_per_instance(spark, folder):
    """Each instance has snapshot rows of its own, begun some hours apart."""
    hours = F.make_dt_interval(F.lit(0), F.col("instance_number"))
    snaps = month_snapshots(spark, folder).join(by_status(spark, folder).select("instance_number", "snap_id").distinct(), "snap_id")
    snaps = snaps.withColumn("begin_interval_time", F.col("begin_interval_time") + hours).withColumn("end_interval_time", F.col("end_interval_time") + hours)
    return counters.counter_history(by_status(spark, folder), snaps, LINES_BEGIN, LINES_END, keep_constant=True,
                                    snap_keys=("dbid", "snap_id", "instance_number")).drop("waits_var")


LOADS = [(LINES_BEGIN, "1997-01-01"), ("1997-01-01", "1999-01-01"), ("1999-01-01", LINES_END)]


@query
def counter_state_merge(spark, folder):
    """Three loads, each with the stored state of the one before and its own days only."""
    out, snaps = shared_folder(spark, "states"), month_snapshots(spark, folder)
    stored.store_history(by_status(spark, folder), snaps, f"{out}/history")
    state, closed = None, []
    for number, (begin, end) in enumerate(LOADS):
        facts = stored.read_history(spark, f"{out}/history", snaps, begin, end)
        rows, grown = counter_state.advance(state, counters.counter_totals(facts, snaps, begin, end))
        rows.write.parquet(f"{out}/closed/load={number}")
        grown.write.parquet(f"{out}/state-{number}")
        state = spark.read.parquet(f"{out}/state-{number}")
    return counter_state.whole_history(spark.read.parquet(f"{out}/closed").drop("load"), state, var_round=2)


@query
def counter_delta_stream(spark, folder):
    """Three loads as a stream; what waits in the state at its end has no delta."""
    out = shared_folder(spark, "stream")
    totals = counters.counter_totals(by_status(spark, folder), month_snapshots(spark, folder), LINES_BEGIN, LINES_END)
    totals = totals.select(*counters.SERIES_KEYS, "snap_id", "wait_time")
    for number, (begin, end) in enumerate(LOADS):  # a load's files hold whole series, and later loads come later
        month_range(totals, begin, end).repartition(*counters.SERIES_KEYS).write.parquet(f"{out}/in/{number}")
    stream = spark.readStream.schema(totals.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 8).parquet(f"{out}/in")
    deltas.run_deltas(stream, deltas.batch_writer(f"{out}/out"), f"{out}/state")
    rows = deltas.closed_rows(spark, f"{out}/out").drop("note")
    return rows.unionByName(deltas.waiting_rows(spark, f"{out}/state"), allowMissingColumns=True)


@query
def counter_ffill(spark, folder):
    return history(spark, folder, by_status(spark, folder), fill_last=True).drop("waits_var")


@query
def counter_top15_series(spark, folder):
    return as_double(supplier_top(spark, folder), "score", 2)


@query
def counter_include_exclude(spark, folder):
    events = table(spark, folder, "supplier").select(
        text("s_suppkey").alias("name"), F.when(F.col("s_acctbal") < 0, "Idle").otherwise("Other").alias("wait_class")
    )
    idle = events.filter(F.col("wait_class") == "Idle")
    return as_double(supplier_top(spark, folder, include=["1", "2", "3"], exclude=idle), "score", 2)


@query
def counter_pivot(spark, folder):
    chosen = checkpointed(supplier_top(spark, folder))
    few = counters.only_series(by_supplier(spark, folder), chosen)
    totals = counters.counter_totals(few, month_snapshots(spark, folder), LINES_BEGIN, LINES_END)
    return counters.series_matrix(counters.series_points(totals, chosen), 15)


@query
def counter_pivot_included(spark, folder):
    """Listed series keep their columns after the first 15."""
    chosen = checkpointed(supplier_top(spark, folder, include=["1", "2", "3"]))
    few = counters.only_series(by_supplier(spark, folder), chosen)
    totals = counters.counter_totals(few, month_snapshots(spark, folder), LINES_BEGIN, LINES_END)
    return counters.series_matrix(counters.series_points(totals, chosen), 15 + 3 * 4)


@query
def counter_large_values(spark, folder):
    """Counters near 1e16 and 1e18 vary as little as they do near 0, in slices of 5 snapshots too."""
    value = F.col("value")
    kinds = {"decimal": (value + F.lit(10**16)).cast("decimal(38,6)"), "bigint": value + F.lit(10**18)}
    parts = [
        history(spark, folder, by_status(spark, folder).withColumn("value", big), var_round=2, slice_snapshots=width).select(
            F.lit(kind).alias("kind"), F.lit(width).alias("width"), "con_id", "instance_number", "stat_name", "snap_id",
            whole("wait_time_delta").alias("wait_time_delta"), "waits_var")
        for kind, big in kinds.items() for width in (5, counters.SLICE_SNAPSHOTS)
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def counter_reset_fill(spark, folder):
    """A counter that wraps: resets stay blank, only the last row repeats its forerunner's delta."""
    facts = by_status(spark, folder).withColumn("value", F.col("value") % 997)
    return history(spark, folder, facts, fill_last=True, on_reset="null", slice_snapshots=5).drop("waits_var")


@query
def counter_section_pivot(spark, folder):
    """The same matrix from a stored section, last deltas filled."""
    out = shared_folder(spark, "sections")
    sinks.write_section(counters.counter_deltas(supplier_totals(spark, folder)), out, "sys-stat-hist")
    rows = sinks.read_section(spark, out, "sys-stat-hist")
    points, _ = counters.section_chart("sys-stat-hist", rows)
    return counters.series_matrix(points, 15)


@query
def counter_legend(spark, folder):
    return counters.series_legend(supplier_top(spark, folder))


@query
def gauge_history(spark, folder):
    """Monthly order value per status as a gauge: the value itself is plotted, not its delta."""
    orders = table(spark, folder, "orders")
    month = times.ntz(F.date_trunc("month", F.col("o_orderdate")))
    facts = orders.select(
        F.lit(0).alias("con_id"), F.lit(1).cast("bigint").alias("dbid"),
        (F.year("o_orderdate").cast("bigint") * 12 + F.month("o_orderdate")).alias("snap_id"),
        (F.col("o_custkey") % 2).cast("int").alias("instance_number"),
        F.col("o_orderstatus").alias("name"), cents("o_totalprice").alias("bytes"),
    )
    snaps = orders.select(month.alias("begin_interval_time")).distinct().select(
        F.lit(1).cast("bigint").alias("dbid"),
        (F.year("begin_interval_time").cast("bigint") * 12 + F.month("begin_interval_time")).alias("snap_id"),
        "begin_interval_time",
        (F.col("begin_interval_time") + F.make_ym_interval(F.lit(0), F.lit(1))).alias("end_interval_time"),
    )
    points, _ = counters.counter_chart("awr-sga-stat", facts, snaps, LINES_BEGIN, LINES_END)
    return points.select("con_id", "series", "time_label", "begin_interval_time", "wait_time")


# ---------------------------------------------------------------- activity samples


def event_halves(spark, folder) -> list[DataFrame]:
    events = table(spark, folder, "events").select(
        F.col("event_type").alias("con_id"), F.col("ts").alias("sample_time"), "event_id"
    )
    return [events.filter(F.col("event_id") % 2 == 0), events.filter(F.col("event_id") % 2 == 1)]


@query
def load_peak_10min(spark, folder):
    return samples.perf_load(event_halves(spark, folder), EVENTS_BEGIN, EVENTS_END)


@query
def load_peak_coarse(spark, folder):
    return samples.peak_load(event_halves(spark, folder), EVENTS_BEGIN, EVENTS_END, fine="1 hour", coarse="1 day")


@query
def load_peak_pivot(spark, folder):
    load = samples.perf_load(event_halves(spark, folder), EVENTS_BEGIN, EVENTS_END)
    return samples.load_matrix(load.withColumnRenamed("con_id", "name"), EVENT_TYPES)


EVENT_STATES = [("click", "CPU"), ("view", "IO"), ("purchase", "CLUSTER")]


def event_states(spark, folder, samples_per_bucket: int) -> DataFrame:
    rows = table(spark, folder, "events").withColumn("con_id", (F.col("user_id") % 3).cast("int"))
    return samples.active_by_state(
        rows, EVENTS_BEGIN, EVENTS_END, classify.first_match(F.col("event_type"), EVENT_STATES, "WAIT"), ts="ts",
        samples_per_bucket=samples_per_bucket, foreground=F.col("event_type") != "signup",
    )


@query
def active_by_state_hour(spark, folder):
    return event_states(spark, folder, 360)


@query
def active_by_state_pivot(spark, folder):
    wide = samples.state_matrix(event_states(spark, folder, 4), [0, 1, 2], name="con_id")
    return wide.withColumnsRenamed({str(i): f"tenant_{i}" for i in range(3)})


# ---------------------------------------------------------------- storage


def tablespaces(spark, folder) -> DataFrame:
    kind = F.when(F.col("n_regionkey") < 3, "PERMANENT").when(F.col("n_regionkey") == 3, "UNDO")
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("con_id"), F.col("n_name").alias("tablespace_name"),
        kind.otherwise("TEMPORARY").alias("contents"), F.lit(8192).alias("block_size"),
    )


def data_files(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("con_id"), F.concat(F.lit("NATION_"), text("c_nationkey")).alias("tablespace_name"),
        F.col("c_custkey").alias("file_id"), (F.col("c_custkey") % 1023).alias("relative_fno"),
        F.abs(cents("c_acctbal")).alias("bytes"), (F.col("c_custkey") * 7919 % 900000).alias("maxbytes"),
        F.when(F.col("c_mktsegment") == "BUILDING", "NO").otherwise("YES").alias("autoextensible"),
    )


def free_space(spark, folder) -> DataFrame:
    files = data_files(spark, folder).select("con_id", "tablespace_name", "file_id", "relative_fno")
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("file_id"),
                                                   (F.col("o_orderkey") % 10000).alias("bytes"))
    return files.join(orders, "file_id").select("con_id", "tablespace_name", "file_id", "relative_fno", "bytes")


def usage(spark, folder, contents: str) -> DataFrame:
    return storage.tablespace_usage(tablespaces(spark, folder), data_files(spark, folder), free_space(spark, folder),
                                    contents)


@query
def usage_rollup(spark, folder):
    return usage(spark, folder, "PERMANENT")


@query
def usage_rollup_other(spark, folder):
    return usage(spark, folder, "UNDO")


@query
def usage_percent(spark, folder):
    return storage.usage_in_mb(usage(spark, folder, "PERMANENT"))


def sort_use(spark, folder) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    urgent = table(spark, folder, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return urgent.join(customers, F.col("o_custkey") == F.col("c_custkey")).filter(F.col("c_nationkey") % 2 == 0).select(
        F.col("c_nationkey").alias("con_id"), F.concat(F.lit("NATION_"), text("c_nationkey")).alias("tablespace"),
        (F.col("o_orderkey") % 3).alias("blocks"),
    )


def temp_rows(spark, folder) -> DataFrame:
    return storage.temp_usage(data_files(spark, folder), tablespaces(spark, folder), sort_use(spark, folder))


@query
def usage_long_metrics(spark, folder):
    return temp_rows(spark, folder)


@query
def usage_wide_pivot(spark, folder):
    return storage.temp_usage_matrix(temp_rows(spark, folder))


@query
def file_overview_fleet(spark, folder):
    """An overview of each database of a fleet; the line number stands for the bundle."""
    files = table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("bundle_id"), F.col("l_returnflag").alias("con_id"), F.col("l_linestatus").alias("ts#"),
        cents("l_extendedprice").alias("bytes"))
    return storage.file_overview(files, ("bundle_id", "con_id"), within=("bundle_id",))


@query
def file_overview(spark, folder):
    files = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("con_id"), F.col("l_linestatus").alias("ts#"), cents("l_extendedprice").alias("bytes")
    )
    return storage.file_overview(files)


@query
def file_io_join(spark, folder):
    files = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("con_id"), F.col("o_orderkey").alias("file#"), F.col("o_orderpriority").alias("name"))
    stats = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("file#")).agg(
        F.count(F.lit(1)).alias("phyrds"), F.sum(whole("l_quantity")).alias("phywrts"),
        F.max(whole("l_linenumber")).alias("singleblkrds"), F.sum(cents("l_extendedprice")).alias("readtim"),
    )
    return storage.file_io(files, stats, columns=["phyrds", "phywrts", "singleblkrds", "readtim"])


@query
def group_member_join(spark, folder):
    groups = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("group#"), F.col("n_regionkey").alias("thread#"),
        (F.col("n_nationkey") * 1048576).cast("bigint").alias("bytes"),
        F.when(F.col("n_regionkey") == 0, "NO").otherwise("YES").alias("archived"), F.col("n_name").alias("status"))
    members = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("group#"), F.col("s_name").alias("member"))
    return storage.redo_logs(groups, members)


@query
def recovery_area_mb(spark, folder):
    areas = table(spark, folder, "orders").select(
        "o_orderkey", (cents("o_totalprice") * 64).alias("space_limit"), cents("o_totalprice").alias("space_used"))
    return storage.recovery_area_mb(areas)


# ---------------------------------------------------------------- configuration


def instances(spark, folder) -> DataFrame:
    return table(spark, folder, "region").select(
        F.col("r_regionkey").alias("inst_id"), F.col("r_regionkey").alias("instance_number"),
        F.col("r_name").alias("instance_name"))


def parameters(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(
        (F.col("p_partkey") % 5).cast("int").alias("inst_id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("value"), F.col("p_size").alias("type"),
        F.when(F.col("p_brand") == "Brand#3", "TRUE").otherwise("FALSE").alias("isdefault"))


@query
def instance_param_numeric(spark, folder):
    return config.changed_parameters(parameters(spark, folder), instances(spark, folder), numeric=True)


@query
def instance_param_other(spark, folder):
    return config.changed_parameters(parameters(spark, folder), instances(spark, folder), numeric=False)


@query
def log_path(spark, folder):
    nodes = table(spark, folder, "nation").select(
        F.col("n_regionkey").alias("inst_id"), F.col("n_name").alias("instance_name"))
    places = table(spark, folder, "region").select(
        F.col("r_regionkey").alias("inst_id"), F.lit("Diag Trace").alias("name"),
        F.concat(F.lit("/logs/"), F.col("r_name")).alias("value"))
    return config.log_paths(nodes, places)


def patches(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderdate").alias("action_time"), F.col("o_orderstatus").alias("action"),
        F.col("o_orderpriority").alias("namespace"), text("o_custkey").alias("version"), text("o_orderkey").alias("id"),
        F.when(F.col("o_custkey") % 7 != 0, F.concat(F.lit("c"), text("o_custkey"))).alias("comments"))


@query
def patch_history(spark, folder):
    return config.patch_history(patches(spark, folder))


@query
def patch_latest(spark, folder):
    return config.patch_history(patches(spark, folder), latest_only=True)


@query
def arch_dest_long(spark, folder):
    places = table(spark, folder, "orders").select(
        (F.col("o_custkey") % 5).cast("int").alias("inst_id"), F.concat(F.lit("DEST_"), text("o_orderkey")).alias("dest_name"),
        F.when(F.col("o_orderstatus") == "P", "INACTIVE").otherwise(F.col("o_orderstatus")).alias("status"),
        F.col("o_orderkey").alias("log_sequence"),
        F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority")).alias("error"))
    database = table(spark, folder, "region").agg(
        F.when(F.count(F.lit(1)) > 0, "ARCHIVELOG").otherwise("NOARCHIVELOG").alias("log_mode"))
    return config.archive_destinations(places, instances(spark, folder), database)


@query
def backup_elapsed(spark, folder):
    hours = F.make_dt_interval(F.lit(0), (F.col("o_custkey") % 100).cast("int"))
    runs = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("operation"), text("o_orderkey").alias("object_type"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("start_time"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + hours).alias("end_time"))
    rows = config.backup_history(runs, "2002-01-01 00:00:00", pattern="%-HIGH%")
    return rows.withColumn("elapsed", times.interval_seconds(F.col("elapsed")).cast("bigint"))


@query
def expiring_users(spark, folder):
    users = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("con_id"), text("o_orderkey").alias("username"), F.col("o_orderdate").alias("expiry_date"),
        classify.first_match(F.col("o_orderstatus"), [("O", "OPEN"), ("F", "EXPIRED(GRACE)")], "LOCKED").alias(
            "account_status"))
    rows = config.expiring_users(users, "2000-01-01 00:00:00")
    return rows.withColumn("expiring_secs", F.col("expiring_secs").cast("bigint"))


@query
def user_roles_outer(spark, folder):
    users = table(spark, folder, "part").select(
        F.lit(0).alias("con_id"), text("p_partkey").alias("username"), F.col("p_brand").alias("default_tablespace"),
        F.col("p_type").alias("temporary_tablespace"))
    grants = table(spark, folder, "lineitem").filter(F.col("l_quantity") > 49).select(
        F.lit(0).alias("con_id"), text("l_partkey").alias("grantee"), F.col("l_returnflag").alias("granted_role"),
        F.col("l_linestatus").alias("default_role"))
    return config.user_roles(users, grants)


@query
def cursor_efficiency(spark, folder):
    events = table(spark, folder, "events").select(
        (F.col("user_id") % 4).cast("int").alias("inst_id"), F.col("user_id").alias("sid"),
        F.col("event_type").alias("statistic#"), cents("value").alias("value"))
    names = [("click", "session cursor cache count"), ("view", "opened cursors current")]
    statname = events.select("inst_id", "statistic#").distinct().withColumn(
        "name", classify.first_match(F.col("statistic#"), names, "other"))
    limits = F.array(
        F.struct(F.lit("session_cached_cursors").alias("name"), (F.col("inst_id") * 2500).alias("size")),
        F.struct(F.lit("open_cursors").alias("name"), ((F.col("inst_id") + 1) * 100000).alias("size")))
    parameter = events.select("inst_id").distinct().select("inst_id", F.inline(limits)).select(
        "inst_id", "name", text("size").alias("value"))
    return as_double(config.cursor_efficiency(statname, events, parameter), "usage_pct", 6)


@query
def config_unpivot(spark, folder):
    rows = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    wide = rows.select(F.col("n_nationkey").alias("dbid"), F.col("n_name").alias("name"),
                       F.col("r_name").alias("log_mode"), F.col("r_regionkey").alias("open_mode"),
                       F.length("r_name").alias("cdb"))
    return config.database_settings(wide)


@query
def autotask_chain(spark, folder):
    tasks = table(spark, folder, "supplier").select(
        F.concat(F.lit("NATION_"), text("s_nationkey")).alias("client_name"), F.col("s_name").alias("task_name"),
        F.lit("collect").alias("operation_name"),
        F.when(F.col("s_acctbal") < 0, "DISABLED").otherwise("ENABLED").alias("status"))
    clients = table(spark, folder, "nation").select(
        F.col("n_name").alias("client_name"), text("n_regionkey").alias("window_group"))
    windows = table(spark, folder, "region").select(
        text("r_regionkey").alias("window_group_name"), F.lit("TRUE").alias("enabled"), F.col("r_name").alias(
            "next_start_date"))
    return config.maintenance_tasks(tasks, clients, windows, keys=())


@query
def job_durations(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    jobs = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        text("o_orderkey").alias("job_name"), F.col("l_linenumber").alias("run_count"),
        F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("repeat_interval"),
        (F.col("l_shipdate") - F.col("o_orderdate")).alias("last_run_duration"))
    return config.scheduler_jobs(jobs, state="F")


@query
def undo_stats_window(spark, folder):
    events = table(spark, folder, "events").select(
        (F.col("user_id") % 4).cast("int").alias("inst_id"), F.col("ts").alias("begin_time"),
        F.col("user_id").alias("unxpstealcnt"), F.col("event_id").alias("expstealcnt"),
        (F.col("event_id") % 3).alias("ssolderrcnt"), (F.col("event_id") % 5).alias("nospaceerrcnt"),
        (F.col("user_id") * 2).alias("maxquerylen"), cents("value").alias("tuned_undoretention"))
    return config.undo_statistics(events, "2024-01-15 00:00:00")


# ---------------------------------------------------------------- sessions and forests


@query
def session_filter_cast(spark, folder):
    rows = table(spark, folder, "orders").select(
        text(F.col("o_custkey") % 4).alias("inst_id"), text("o_orderkey").alias("sid"), text("o_custkey").alias("serial#"),
        F.col("o_orderpriority").alias("username"),
        F.when(F.col("o_orderstatus") == "F", "ACTIVE").otherwise("INACTIVE").alias("status"),
        F.when(F.col("o_custkey") % 3 == 0, text("o_custkey")).alias("blocking_session"))
    return sessions.user_sessions(rows, "active")


@query
def session_top10_pair(spark, folder):
    return sessions.top_groups(table(spark, folder, "orders").select("o_custkey", "o_orderpriority"),
                               ["o_custkey", "o_orderpriority"])


@query
def session_top10_event(spark, folder):
    return sessions.top_groups(table(spark, folder, "events").select("event_type"), ["event_type"])


@query
def session_top10_sql(spark, folder):
    return sessions.top_groups(table(spark, folder, "lineitem").select("l_partkey"), ["l_partkey"])


def blocked_customers(spark, folder) -> DataFrame:
    """Customers as sessions: customer n is blocked by n div 10, the first ten block nobody's wait."""
    return table(spark, folder, "customer").select(
        F.lit(1).alias("inst_id"), F.col("c_custkey").cast("int").alias("sid"), F.col("c_nationkey").alias("serial#"),
        F.when(F.col("c_custkey") >= 10, 1).otherwise(0).alias("blocking_instance"),
        F.when(F.col("c_custkey") >= 10, F.floor(F.col("c_custkey") / 10)).otherwise(0).cast("int").alias(
            "blocking_session"))


@query
def session_columns_by_release(spark, folder):
    """Market segments as databases of releases 9 to 13; two instances each, the older one counts."""
    customers = table(spark, folder, "customer")
    rows = blocked_customers(spark, folder).join(
        customers.select(F.col("c_custkey").cast("int").alias("sid"), F.col("c_mktsegment").alias("bundle_id"), F.col("c_name").alias("username"), F.lit("ACTIVE").alias("status"),
                         F.concat(F.lit("m"), text("c_nationkey")).alias("machine"), F.lit("DEDICATED").alias("server"), (F.col("c_custkey") % 7).alias("p1")), "sid")
    releases = customers.select(F.col("c_mktsegment").alias("bundle_id"), F.concat(
        text(F.length("c_mktsegment") % 5 + 9 + F.col("c_nationkey") % 2), F.lit(".2.0")).alias("version")).distinct()
    return views.sessions_by_release(rows, releases)


@query
def blocking_forest(spark, folder):
    tree = sessions.blocking_forest(blocked_customers(spark, folder))
    return tree.withColumn("path", F.array_join("path", "/"))


@query
def blocked_by_root(spark, folder):
    return sessions.blocked_by_root(blocked_customers(spark, folder))


def memory_inputs(spark, folder) -> memory.MemoryInputs:
    """Nations as databases: sizes from their customers, advice rows from their suppliers."""
    people = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"), F.sum("c_custkey").alias("m"))
    base = people.withColumn("bundle_id", F.concat(F.lit("db"), text("c_nationkey")))
    k, m, mb = F.col("k"), F.col("m"), F.lit(memory.MB).cast("bigint")

    def rows(names: tuple[str, ...], *values: tuple) -> DataFrame:
        cells = [F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, row)]) for row in values]
        return base.select("bundle_id", F.inline(F.array(*cells)))

    sga = rows(("name", "value"), ("Fixed Size", k * 1000 + 1000000), ("Variable Size", (m % 4000 + 2000) * mb + k),
               ("Database Buffers", (m % 700 + 1) * mb), ("Redo Buffers", k * 65536))
    components = rows(
        ("component", "current_size", "granule_size"),
        ("shared pool", m % 300 * mb, m % 2 * mb * 4 + mb * 4), ("large pool", k % 7 * mb, mb * 4), ("java pool", m % 3 * mb, mb * 4), ("streams pool", k * 0, mb * 4),
        ("DEFAULT buffer cache", m % 500 * mb, mb * 4), ("KEEP buffer cache", k % 2 * mb * 8, mb * 4), ("RECYCLE buffer cache", k * 0, mb * 4),
        ("DEFAULT 2K buffer cache", m % 5 * mb, mb * 4), ("DEFAULT 8K buffer cache", k % 3 * mb, mb * 4), ("DEFAULT 16K blocksize buffer cache", k % 4 * mb, mb * 4),
        ("OSM Buffer Cache", mb, mb * 4), ("shared io pool", k * 1000, mb * 4))
    free = rows(("current_size",), (m % 100 * mb,))
    settings = rows(("name", "value"), ("db_block_size", F.when(k % 2 == 0, "8192").otherwise("16384")), ("sga_target", text(m % 3 * 1000)),
                    ("pga_aggregate_target", F.when(m % 4 != 0, text(m % 900 * mb))))
    key = F.col("s_suppkey")
    advice = table(spark, folder, "supplier").select(
        F.concat(F.lit("db"), text("s_nationkey")).alias("bundle_id"), F.when(key % 3 == 1, "KEEP").otherwise("DEFAULT").alias("name"),
        F.when(key % 2 == 0, 8192).otherwise(16384).alias("block_size"), (key % 4 * 0.5).alias("factor"),
        F.when(F.col("s_nationkey") % 3 == 0, F.lit(1.0)).when(key % 7 != 0, (key % 2 + 1).cast("double")).alias("effect"), "s_nationkey")
    loads = lambda name, least: advice.filter(F.col("s_nationkey") >= least).select("bundle_id", F.col("factor").alias(name), F.col("effect").alias("estd_lc_load_time_factor"))
    return memory.MemoryInputs(
        sga, components, free, settings.filter("value is not null"),
        advice.select("bundle_id", "name", "block_size", F.col("factor").alias("size_factor"), F.col("effect").alias("estd_physical_read_factor")),
        loads("shared_pool_size_factor", 3), loads("java_pool_size_factor", 6),
        advice.select("bundle_id", F.col("factor").alias("pga_target_factor"), ((F.col("effect") - 1) * 100).alias("estd_pga_cache_hit_percentage")))


@query
def memory_component_list(spark, folder):
    return as_double(memory.component_list(memory_inputs(spark, folder), ("bundle_id",)), "memory_size", 6)


@query
def memory_advice_status(spark, folder):
    return memory.advice_status(memory_inputs(spark, folder), ("bundle_id",))


@query
def memory_components_report(spark, folder):
    return as_double(memory.memory_components(memory_inputs(spark, folder), ("bundle_id",)), "memory_size", 6)


def region_components(spark, folder) -> DataFrame:
    columns = ["memory_component", "parent_memory_component", "memory_size"]
    regions = table(spark, folder, "region").select(
        F.concat(F.lit("R"), text("r_regionkey")), F.lit(None).cast("string"), F.lit(0).cast("bigint")).toDF(*columns)
    nations = table(spark, folder, "nation").select(
        F.concat(F.lit("N"), text("n_nationkey")), F.concat(F.lit("R"), text("n_regionkey")),
        F.col("n_nationkey").cast("bigint")).toDF(*columns)
    suppliers = table(spark, folder, "supplier").select(
        F.concat(F.lit("S"), text("s_suppkey")), F.concat(F.lit("N"), text("s_nationkey")), cents("s_acctbal")).toDF(*columns)
    return regions.union(nations).union(suppliers)


@query
def memory_forest(spark, folder):
    tree = memory.memory_forest(region_components(spark, folder))
    return tree.withColumn("path", F.array_join("path", "/"))


@query
def memory_subtree_sums(spark, folder):
    sums = memory.memory_sums(region_components(spark, folder))
    within = (F.col("exit") - F.col("entry") + 1).alias("steps")
    return sums.select("id", "parent", "root", "depth", "subtree_size", "subtree_sum", within)


@query
def uncommitted_tx(spark, folder):
    tx = table(spark, folder, "lineitem").select(
        text("l_orderkey").alias("ses_addr"), F.col("l_suppkey").alias("xidusn"), F.col("l_shipdate").alias("start_time"),
        F.col("l_linenumber").alias("ubafil"), F.col("l_partkey").alias("ubablk"), F.col("l_linestatus").alias("status"),
        whole("l_quantity").alias("used_ublk"), cents("l_discount").alias("used_urec"))
    undo = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("usn"), F.col("s_name").alias("name"))
    owners = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("con_id"), (F.col("o_custkey") % 4).cast("int").alias("inst_id"),
        F.col("o_orderkey").alias("sid"), F.col("o_orderpriority").alias("username"), text("o_orderkey").alias("saddr"),
        F.col("o_orderstatus").alias("status"))
    parameter = table(spark, folder, "region").agg(F.max("r_regionkey").alias("top")).select(
        F.lit("db_block_size").alias("name"), text((F.col("top") + 4) * 1024).alias("value"))
    return sessions.open_transactions(tx, undo, owners, parameter)


# ---------------------------------------------------------------- classification and memory parts


@query
def component_classify(spark, folder):
    rules = {
        "colour": ([("red%", "warm"), ("%bolt", "metal"), ("blue%", "cold"), ("small%", "size")], "other"),
        "advised": ([("%ring", "Y"), ("%widget", "Y")], "N"),
    }
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    named = classify.classify(parts, "p_name", rules)
    kind = classify.first_match(F.col("p_type"), [("E%", "1"), ("S%", "2"), ("%A%", "3")])
    return named.withColumns({"kind": kind, "branded": classify.first_match(F.col("p_brand"), [("%#1_", "Y")], "N")})


@query
def component_union_distinct(spark, folder):
    brands = table(spark, folder, "part").select(F.col("p_brand").alias("brand"))
    others = table(spark, folder, "supplier").select(F.concat(F.lit("Brand#"), text("s_nationkey")).alias("brand"))
    return brands.union(others).distinct()


@query
def residual_component(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderstatus", cents("o_totalprice").alias("size"))
    total = orders.agg(F.sum("size").alias("value"))
    free = orders.filter(F.col("o_orderstatus") == "P").agg(F.sum("size").alias("current_size"))
    named = orders.filter(F.col("o_orderstatus") == "F").agg(F.sum("size").alias("value_sum"))
    return memory.residual(total, free, named)


@query
def all_rows_flat(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderstatus")
    return classify.all_rows_hold(orders, ["o_custkey"], F.col("o_orderstatus") != "P")


@query
def distinct_pairs(spark, folder):
    rows = table(spark, folder, "events").select("event_type", (F.col("user_id") % 5).alias("wait_class"))
    return config.event_classes(rows, ["event_type", "wait_class"])


@query
def value_range(spark, folder):
    return memory.value_range(table(spark, folder, "customer"), "c_acctbal")


# ---------------------------------------------------------------- dictionary metadata


def dictionary(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects, owners and the one-row block size."""
    objects = table(spark, folder, "part").select(
        F.col("p_partkey").alias("obj#"), (F.col("p_size") % 5).alias("owner#"),
        F.concat(F.col("p_name"), F.lit(" "), text("p_partkey")).alias("name"))
    owners = table(spark, folder, "region").select(F.col("r_regionkey").alias("user#"), F.col("r_name").alias("name"))
    block = table(spark, folder, "region").agg(((F.max("r_regionkey") + 4) * 1024).alias("value"))
    return objects, owners, block


def column_lists(spark, folder) -> DataFrame:
    """Orders as indexes on their customer's table; an order's lines are the index columns."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    # Rows of one order only: an order has few lines.
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey"))
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("obj#"), place.alias("pos#"), (F.col("l_suppkey") % 5).alias("intcol#"))
    # Orders take little room on disk and much as a table in the driver, so they are not broadcast.
    return lines.hint("merge").join(orders, F.col("obj#") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("bo#"), "obj#", "pos#", "intcol#")


@query
def redundant_prefix(spark, folder):
    plain = table(spark, folder, "orders").filter(F.col("o_orderkey").bitwiseAND(1) == 0).select(F.col("o_orderkey").alias("obj#"))
    return indexes.redundant_prefixes(column_lists(spark, folder), plain).withColumnRenamed("bo#", "table_id")


@query
def redundant_classes(spark, folder):
    return indexes.redundant_classes(column_lists(spark, folder)).withColumnRenamed("bo#", "table_id")


@query
def low_density_groups(spark, folder):
    objects, owners, block = dictionary(spark, folder)
    lines = table(spark, folder, "lineitem")
    sizes = lines.groupBy(F.col("l_partkey").alias("obj#")).agg(F.count(F.lit(1)).alias("n"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("obj#"), "p_size")
    index = parts.join(sizes, "obj#").select(
        "obj#", F.col("obj#").alias("bo#"), (F.col("n") * 10).alias("rowcnt"),
        (F.col("p_size").cast("bigint") + 1).alias("leafcnt"),
        F.lit(2).alias("initrans"), (F.col("p_size") % 20).alias("pctfree$"),
        F.when(F.col("p_size") % 3 == 0, 2).otherwise(1).alias("type#"))
    columns = lines.select(F.col("l_partkey").alias("obj#"), F.col("l_partkey").alias("bo#"),
                           F.col("l_linenumber").alias("intcol#")).distinct()
    stats = lines.groupBy(F.col("l_partkey").alias("obj#"), F.col("l_linenumber").alias("intcol#")).agg(
        F.max(whole("l_quantity")).alias("avgcln"))
    found = indexes.low_density_indexes(index, columns, stats, objects, owners, block)
    return as_double(found, "density_pct", 6)


def part_tables(spark, folder, migrated: int) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("obj#")).agg(
        F.count(F.lit(1)).alias("rowcnt"), F.sum(F.when(F.col("l_quantity") < migrated, 1).otherwise(0)).alias("chncnt"),
        F.sum(whole("l_quantity")).alias("avgrln"))
    return lines.select(
        "obj#", F.lit(None).cast("int").alias("tab#"), "rowcnt", "chncnt", "avgrln",
        (F.col("obj#") % 60 + 1).alias("blkcnt"), (F.col("avgrln") + F.col("obj#") % 3 - 1).alias("avgspc"),
        (F.col("obj#") % 4).alias("initrans"), (F.col("obj#") % 30).alias("pctfree$"),
        F.when(F.col("obj#") % 5 == 0, 32767).when(F.col("obj#") % 5 != 1, (F.col("obj#") % 5).cast("int")).alias(
            "degree"))


@query
def row_migration_calc(spark, folder):
    objects, owners, block = dictionary(spark, folder)
    columns = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("obj#"), (whole("l_quantity") - 1).alias("length"))
    found = indexes.migrated_rows(part_tables(spark, folder, 25), columns, objects, owners, block)
    return as_double(found, "migration_pct", 6)


@query
def table_density_calc(spark, folder):
    objects, owners, block = dictionary(spark, folder)
    reads = table(spark, folder, "region").agg(F.count(F.lit(1)).alias("value"))
    found = indexes.table_density(part_tables(spark, folder, 1), objects, owners, block, reads)
    return as_double(found, "density_pct", 6)


# ---------------------------------------------------------------- dimensions, scans, labels


def nation_tenants(spark, folder) -> DataFrame:
    tenants = table(spark, folder, "nation").filter(F.col("n_nationkey") > 0).select(
        F.col("n_nationkey").alias("con_id"), F.col("n_name").alias("name"))
    return dims.with_whole_database(tenants)


def customers_by_nation(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("con_id")).agg(
        F.count(F.lit(1)).alias("customers"))


@query
def tenant_dim_join(spark, folder):
    return dims.join_tenant(customers_by_nation(spark, folder), nation_tenants(spark, folder))


@query
def tenant_filter(spark, folder):
    return dims.join_tenant(customers_by_nation(spark, folder), nation_tenants(spark, folder), tenant="NATION_3")


@query
def section_scan(spark, folder):
    """Parameterised range scan with projection, and the major version as a column."""
    rows = spark.sql(
        "SELECT o_orderkey, o_orderdate, concat(o_custkey, '.', o_orderkey, '.0') AS version FROM {orders}"
        " WHERE o_orderdate >= :bdate AND o_orderdate <= :edate",
        args={"bdate": "1997-01-01", "edate": "1998-01-01"}, orders=table(spark, folder, "orders"))
    return rows.withColumn("main_release", dims.major_version(F.col("version")))


@query
def first_row(spark, folder):
    return table(spark, folder, "orders").orderBy(F.col("o_orderdate").asc_nulls_last(), "o_orderkey").limit(1)


@query
def axis_values(spark, folder):
    label = F.date_format("l_shipdate", "yyyy-MM").alias("month")
    return table(spark, folder, "lineitem").select(label).distinct().orderBy("month")


@query
def labels_rename(spark, folder):
    rows = table(spark, folder, "nation").select(
        F.col("n_name").alias("instance_name"), F.col("n_regionkey").alias("con_id"),
        F.col("n_nationkey").alias("memory_size"), F.col("n_name").alias("n_name"))
    return labels.rename_columns(labels.project_existing(rows, ["con_id", "instance_name", "n_name", "memory_size", "cdb"]))


@query
def equal_to_latest_database(spark, folder):
    """Rows of the newest order date's key only: equality with an uncorrelated scalar."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("dbid"))
    current = orders.agg(F.max("dbid").alias("dbid"))
    return config.current_database(orders, current)


@query
def fixed_width_text(spark, folder):
    rows = table(spark, folder, "customer")
    return rows.select(
        "c_custkey",
        numbers.number_text(F.col("c_acctbal"), 3, 2).alias("narrow"),
        numbers.number_text(F.col("c_acctbal") / 10, 3, leading_zero=True).alias("whole"),
        concat_nn(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.lit(":"), F.col("c_mktsegment")).alias("joined"))


# ---------------------------------------------------------------- sections, bundles, streams


def sections_with_bundles(spark, folder) -> dict[str, DataFrame]:
    """Two sections of several bundles."""
    redo = group_member_join(spark, folder)
    bundle = F.concat(F.lit("db"), F.col("thread_id").cast("string"))
    groups = table(spark, folder, "nation").select(
        F.concat(F.lit("db"), text("n_regionkey")).alias("bundle_id"), F.col("n_nationkey").alias("con_id"),
        F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "READ, \"WRITE\"").alias("open_mode"))
    return {"redo-log": redo.withColumn("bundle_id", bundle), "pdb-info": groups}


@query
def bundle_roundtrip(spark, folder):
    """Sections to bundles and back; the shared folder must be a mounted path, as for every bundle that is written."""
    out = shared_folder(spark, "bundles")
    written = bundles.write_bundles(sections_with_bundles(spark, folder), mounted_path(out))
    written.write.mode("overwrite").parquet(f"{out}/written")
    return bundles.read_bundle_section(spark, out, "redo-log")


@query
def section_csv_roundtrip(spark, folder):
    out = shared_folder(spark, "sections")
    sinks.write_sections(sections_with_bundles(spark, folder), out, "csv")
    return sinks.read_section(spark, out, "pdb-info", "csv")


def event_stream(spark, folder) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return streams.sample_stream(spark, folder, schema, "events.parquet")


@query
def load_peak_stream(spark, folder):
    """Streaming peak load per ten minutes, open buckets included."""
    rows = event_stream(spark, folder).withColumnRenamed("event_type", "con_id").select("con_id", "ts")
    out = shared_folder(spark, "stream")
    return streams.peak_load(streams.run_available(rows, streams.load_counts(ts="ts"), f"{out}/rows", f"{out}/state"))


@query
def active_by_state_stream(spark, folder):
    rows = event_stream(spark, folder).withColumn("con_id", (F.col("user_id") % 3).cast("int"))
    reduce = streams.state_counts(
        ts="ts", state=classify.first_match(F.col("event_type"), EVENT_STATES, "WAIT"),
        foreground=F.col("event_type") != "signup")
    out = shared_folder(spark, "stream")
    return streams.active_by_state(streams.run_available(rows, reduce, f"{out}/rows", f"{out}/state"))
