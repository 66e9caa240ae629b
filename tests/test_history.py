"""Stored history, mergeable counter states and streamed deltas against the one-pass report."""

import re
import time

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import counter_state, counters
from fleetscope.plans import testbed
from fleetscope.sources import history
from fleetscope.streaming import deltas

FACT = "bundle_id string, con_id int, dbid bigint, instance_number int, stat_name string, snap_id bigint, value bigint"
SNAP = "bundle_id string, dbid bigint, snap_id bigint, begin_interval_time timestamp_ntz, end_interval_time timestamp_ntz"


@pytest.fixture
def tables(spark):
    """Two bundles, ten days of 24 hourly snapshots, three series; one fact without a snapshot."""
    facts = spark.range(240).selectExpr("id AS snap_id").crossJoin(spark.range(3).selectExpr("string(id) AS stat_name")).crossJoin(
        spark.createDataFrame([("007",), ("8",)], "bundle_id string")).selectExpr(
        "bundle_id", "1 AS con_id", "1L AS dbid", "1 AS instance_number", "stat_name", "snap_id", "snap_id * snap_id * (1 + int(stat_name)) AS value")
    facts = facts.unionByName(spark.createDataFrame([("007", 1, 1, 1, "0", 5000, 7)], FACT))
    snaps = spark.range(240).crossJoin(spark.createDataFrame([("007",), ("8",)], "bundle_id string")).selectExpr(
        "bundle_id", "1L AS dbid", "id AS snap_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(id)) AS begin_interval_time",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(id) + 1) AS end_interval_time")
    return facts, snaps


KEYS = ("bundle_id", "dbid", "snap_id")


def test_a_day_is_read_from_its_folders_only(spark, tables, tmp_path):
    facts, snaps = tables
    folder = str(tmp_path / "history")
    history.store_history(facts, snaps, folder, KEYS)
    everything = spark.read.parquet(folder)
    assert everything.count() == facts.count() and len(everything.inputFiles()) >= 21
    found = history.read_history(spark, folder, snaps, "2024-01-03", "2024-01-04", KEYS)
    assert sorted(found.columns) == sorted(facts.columns)
    rows = found.collect()
    assert {r.snap_id for r in rows} == set(range(48, 72)) and {r.bundle_id for r in rows} == {"007", "8"}
    physical = found._jdf.queryExecution().executedPlan()
    if "Adaptive" in physical.nodeName():
        physical = physical.executedPlan()
    if "QueryStage" in physical.nodeName():
        physical = physical.plan()
    leaves = physical.collectLeaves()
    files = next(m.get().value() for i in range(leaves.size()) if (m := leaves.apply(i).metrics().get("numFiles")).isDefined())
    assert 4 <= files <= 8 < len(everything.inputFiles())  # two bundles, two days
    plan = physical.toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= ", plan) and "snap_id" in plan.split("PartitionFilters")[1]
    totals = counters.counter_totals(found, snaps, "2024-01-03", "2024-01-04", series=["bundle_id", *counters.SERIES_KEYS], snap_keys=KEYS)
    want = counters.counter_totals(facts, snaps, "2024-01-03", "2024-01-04", series=["bundle_id", *counters.SERIES_KEYS], snap_keys=KEYS)
    assert sorted(totals.collect()) == sorted(want.collect())


def test_a_repeated_load_replaces_its_days(spark, tables, tmp_path):
    facts, snaps = tables
    folder = str(tmp_path / "history")
    first, second = facts.filter("snap_id < 48"), facts.filter("snap_id between 24 and 71")
    for load in (first, second, second):
        history.store_history(load, snaps, folder, KEYS)
    assert spark.read.parquet(folder).count() == facts.filter("snap_id < 72").count()


def one_pass(totals, **options):
    return counters.counter_deltas(totals, keep_constant=True, **options)


@pytest.mark.parametrize("kind,big", [("bigint", 0), ("bigint", 10**18), ("decimal(38,6)", 10**16), ("double", 0)])
def test_states_merge_to_the_one_pass_report(spark, kind, big):
    totals = spark.range(400).selectExpr("int(id % 2) AS con_id", "1L AS dbid", "1 AS instance_number", "string(id % 4) AS stat_name", "id DIV 4 AS snap_id",
                                         f"cast({big} + id * (id % 4) + id % 7 AS {kind}) AS wait_time")
    totals = totals.withColumn("wait_time", F.expr("CASE WHEN stat_name = '1' AND snap_id = 40 THEN NULL WHEN stat_name = '3' THEN 5 ELSE wait_time END").cast(kind))
    totals = totals.filter("stat_name <> '2' OR snap_id > 60").cache()
    state, rows = None, []
    for low, high in [(0, 10), (10, 11), (5, 11), (11, 70), (70, 100)]:  # the third load repeats what is there
        closed, state = counter_state.advance(state, totals.filter(F.col("snap_id").between(low, high - 1)), slice_snapshots=16)
        rows.append(closed)
        state = spark.createDataFrame(state.collect(), state.schema)
    closed = rows[0]
    for more in rows[1:]:
        closed = closed.unionByName(more)
    scale = {"bigint": 0, "decimal(38,6)": 6, "double": None}[kind]
    found = {(r.stat_name, r.snap_id): r for r in counter_state.whole_history(closed, state, scale=scale, keep_constant=True).collect()}
    want = {(r.stat_name, r.snap_id): r for r in one_pass(totals).collect()}
    assert set(found) == set(want)
    for key, r in want.items():
        assert (found[key].wait_time, found[key].wait_time_delta) == (r.wait_time, r.wait_time_delta)
        assert found[key].waits_var == pytest.approx(r.waits_var, rel=1e-12 if kind != "double" else 1e-9)
    kept = counter_state.whole_history(closed, state, scale=scale)
    assert {r.stat_name for r in kept.collect()} == {"0", "1", "2"}


def test_states_merge_in_any_order(spark):
    totals = spark.range(300).selectExpr("0 AS con_id", "1L AS dbid", "1 AS instance_number", "'s' AS stat_name", "id AS snap_id", "id * id AS wait_time")
    parts = [counter_state.load_state(totals.filter(F.col("snap_id") % 3 == i), slice_snapshots=7) for i in range(3)]
    whole = counter_state.load_state(totals).select(counter_state.state_variance(), "last", "base", "high", "n", "s1", "s2").collect()
    for order in ((0, 1, 2), (2, 0, 1)):
        a, b, c = (parts[i] for i in order)
        twice = counter_state.merge_states(counter_state.merge_states(a.unionByName(b)).unionByName(c))
        assert twice.select(counter_state.state_variance(), "last", "base", "high", "n", "s1", "s2").collect() == whole


ROW = "k string, snap_id bigint, wait_time bigint"


def feed(spark, folder, number, rows):
    spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(f"{folder}/in/{number}")


def source(spark, folder):
    return spark.readStream.schema(ROW).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    folder, big = str(tmp_path), 2**60 + 1
    for number, rows in enumerate([[("a", 1, 10), ("b", 1, big), ("a", 2, 15), (None, 1, 1)], [("a", 4, 30), ("b", 2, None), (None, 2, 3)], [("b", 3, 9), ("a", 3, 99), ("b", 4, big)]]):
        feed(spark, folder, number, rows)
    write, seen = deltas.batch_writer(f"{folder}/out"), []

    def failing(batch, number):
        write(batch, number)  # written, but not yet known to be: this batch comes again
        seen.append(number)
        if len(seen) == 2:
            raise RuntimeError("stopped on request")

    with pytest.raises(Exception, match="stopped on request"):
        deltas.run_deltas(source(spark, folder), failing, f"{folder}/state", ["k"])
    deltas.run_deltas(source(spark, folder), write, f"{folder}/state", ["k"])
    found = sorted(map(tuple, deltas.closed_rows(spark, f"{folder}/out").collect()), key=repr)
    assert found == sorted([("a", 1, 10, 5, None), ("a", 2, 15, 15, None), ("a", 3, 99, None, "late"), ("b", 1, big, None, None), ("b", 2, None, None, None),
                            ("b", 3, 9, big - 9, None), (None, 1, 1, 2, None)], key=repr)
    waiting = deltas.waiting_rows(spark, f"{folder}/state").collect()
    assert sorted(map(tuple, waiting), key=repr) == sorted([("a", 4, 30), ("b", 4, big), (None, 2, 3)], key=repr)


def test_a_pause_closes_a_series(spark, tmp_path):
    folder = str(tmp_path)
    feed(spark, folder, 0, [("a", 1, 10), ("b", 1, 5)])
    run = (
        deltas.delta_stream(source(spark, folder), ["k"], pause_ms=100).writeStream.foreachBatch(deltas.batch_writer(f"{folder}/out")).outputMode("append")
        .option("checkpointLocation", f"{folder}/state").trigger(processingTime="1 second").start()
    )
    end = time.time() + 60
    try:
        while time.time() < end and (not (tmp_path / "out").is_dir() or not any(tmp_path.glob("out/*/*.parquet")) or deltas.closed_rows(spark, f"{folder}/out").count() < 2):
            time.sleep(0.5)
    finally:
        run.stop()
    assert sorted(map(tuple, deltas.closed_rows(spark, f"{folder}/out").collect()))[:2] == [("a", 1, 10, None, "closed"), ("b", 1, 5, None, "closed")]
    assert deltas.waiting_rows(spark, f"{folder}/state").count() == 0


def test_streamed_doubles_and_decimals(spark, tmp_path):
    for kind in ("double", "decimal(20,3)"):
        folder = str(tmp_path / kind[:6])
        spark.createDataFrame([("a", 1, "1.5"), ("a", 2, "4.25"), ("a", 3, None)], "k string, snap_id bigint, wait_time string").selectExpr(
            "k", "snap_id", f"cast(wait_time AS {kind}) AS wait_time").coalesce(1).write.parquet(f"{folder}/in/0")
        rows = spark.readStream.schema(f"k string, snap_id bigint, wait_time {kind}").option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        deltas.run_deltas(rows, deltas.batch_writer(f"{folder}/out"), f"{folder}/state", ["k"])
        found = sorted((r.snap_id, r.wait_time_delta if r.wait_time_delta is None else float(r.wait_time_delta)) for r in deltas.closed_rows(spark, f"{folder}/out").collect())
        assert found == [(1, 2.75), (2, None)]


def test_pruned_history_of_the_test_tables_reads_few_folders(spark, small):
    found = testbed.QUERIES["counter_pruned_history"](spark, small)
    assert "PartitionFilters: [isnotnull(day" in found._jdf.queryExecution().toString()
