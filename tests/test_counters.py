import random
from datetime import datetime, timedelta
from statistics import variance

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import counters
from fleetscope.operators.ordered import fill_forward, next_value

TOTALS = "con_id INT, dbid BIGINT, instance_number INT, stat_name STRING, snap_id BIGINT, wait_time BIGINT"
T0 = datetime(2024, 1, 1)


def series(rows, con=1, stat="s", inst=1):
    return [(con, 1, inst, stat, snap, value) for snap, value in rows]


def by_snap(df, *columns):
    return [tuple(r) for r in df.orderBy("stat_name", "snap_id").select(*columns).collect()]


def test_only_a_varying_series_stays(frame):
    rows = series([(1, 5)], stat="one") + series([(1, 7), (2, 7), (3, 7)], stat="flat") + series(
        [(1, 1), (2, 2), (3, 4), (4, 8)], stat="up")
    out = counters.counter_deltas(frame(TOTALS, rows))
    assert by_snap(out, "stat_name", "wait_time_delta") == [("up", 1), ("up", 2), ("up", 4), ("up", None)]
    assert out.first().waits_var == pytest.approx(9.583333333)
    kept = counters.counter_deltas(frame(TOTALS, rows), keep_constant=True)
    assert {(r.stat_name, r.waits_var) for r in kept.collect() if r.stat_name != "up"} == {("one", None), ("flat", 0.0)}


@pytest.mark.parametrize("width", [1, 2, 3, 7, 4096])
def test_slices_do_not_change_the_result(frame, width):
    rng = random.Random(width)
    rows = []
    for stat in ("a", "b", None):
        for con in (1, None):
            snaps = sorted(rng.sample(range(60), 20))
            rows += series([(s, rng.randrange(1000)) for s in snaps], con=con, stat=stat)
    out = counters.counter_deltas(frame(TOTALS, rows), slice_snapshots=width, fill_last=True)
    got = {(r.con_id, r.stat_name, r.snap_id): (r.wait_time_delta, round(r.waits_var, 6)) for r in out.collect()}
    expected = {}
    for con in (1, None):
        for stat in ("a", "b", None):
            own = sorted((s, v) for c, _, _, n, s, v in rows if (c, n) == (con, stat))
            values = [v for _, v in own]
            mean = sum(values) / len(values)
            var = sum((v - mean) ** 2 for v in values) / (len(values) - 1)
            deltas = [b - a for a, b in zip(values, values[1:])]
            for (snap, _), delta in zip(own, deltas + deltas[-1:]):
                expected[con, stat, snap] = (delta, round(var, 6))
    assert got == expected


def test_deltas_add_up(frame):
    rows = series([(i, i * i % 97) for i in range(50)])
    out = counters.counter_deltas(frame(TOTALS, rows), slice_snapshots=8)
    assert out.agg(F.sum("wait_time_delta")).first()[0] == rows[-1][-1] - rows[0][-1]


def test_variance_beyond_exact_digits(frame):
    rows = series([(i, 10**17 * (i % 3)) for i in range(9)])
    out = counters.counter_deltas(frame(TOTALS, rows).withColumn("wait_time", F.col("wait_time").cast("decimal(38,6)")),
                                  slice_snapshots=4)
    assert out.first().waits_var == pytest.approx(7.5e33)
    var = counters.series_variance(frame(TOTALS, rows).withColumn("wait_time", F.col("wait_time").cast("double")))
    assert var.first().waits_var == pytest.approx(7.5e33)


@pytest.mark.parametrize("kind, base", [("bigint", 10**18), ("decimal(38,6)", 10**16), ("decimal(38,0)", 10**30), ("double", 10**12)])
@pytest.mark.parametrize("width", [5, 4096])
def test_variance_of_large_counters(frame, kind, base, width):
    """Fifty snapshots rising by 1 vary by 212.5 wherever they start."""
    rows = frame(TOTALS, series([(i, i) for i in range(50)])).withColumn(
        "wait_time", (F.col("wait_time").cast("decimal(38,0)") + F.lit(str(base)).cast("decimal(38,0)")).cast(kind))
    assert counters.counter_deltas(rows, slice_snapshots=width).first().waits_var == pytest.approx(212.5)
    found = counters.series_variance(rows, slice_snapshots=width).first()
    assert (found.row_count, found.waits_var) == (50, pytest.approx(212.5))


def test_variance_with_a_far_outlier(frame):
    rows = frame(TOTALS, series([(i, i if i else -9 * 10**18) for i in range(50)]))
    values = [-9.0e18, *range(1, 50)]
    mean = sum(values) / 50
    expected = sum((v - mean) ** 2 for v in values) / 49
    assert counters.series_variance(rows, slice_snapshots=7).first().waits_var == pytest.approx(expected)


def test_scores_of_any_size(frame):
    ddl = "con_id INT, stat_name STRING, instance_number INT, waits_var DOUBLE, row_count BIGINT"
    rows = frame(ddl, [(1, "big", 1, 1e40, 2), (1, "big", 1, 3e40, 2), (1, "small", 1, 1e-9, 3), (1, "less", 1, 1e-12, 3)])
    found = {r.stat_name: r.score for r in counters.series_scores(rows).collect()}
    assert found == {"big": pytest.approx(2e40), "small": 1e-9, "less": 1e-12}


def test_matrix_without_room_stops(frame):
    points = frame("con_id INT, begin_interval_time STRING, series_rank INT, wait_time_delta BIGINT", [(1, "a", 1, 5), (1, "a", 2, 6)])
    assert counters.series_matrix(points, 2).first().series_02 == 6.0
    with pytest.raises(Exception, match="series_rank is not among"):
        counters.series_matrix(points, 1).collect()


def test_only_the_last_row_is_filled(frame):
    rows = series([(1, 10), (2, 20), (3, 5), (4, 9)])
    for width in (1, 2, 4096):
        out = counters.counter_deltas(frame(TOTALS, rows), on_reset="null", fill_last=True, slice_snapshots=width)
        assert by_snap(out, "wait_time_delta") == [(10,), (None,), (4,), (4,)]


def test_reset_can_be_blanked(frame):
    rows = series([(1, 5), (2, 9), (3, 1), (4, 2)])
    assert by_snap(counters.counter_deltas(frame(TOTALS, rows)), "wait_time_delta") == [(4,), (-8,), (1,), (None,)]
    assert by_snap(counters.counter_deltas(frame(TOTALS, rows), on_reset="null"), "wait_time_delta") == [
        (4,), (None,), (1,), (None,)]
    with pytest.raises(ValueError):
        counters.counter_deltas(frame(TOTALS, rows), on_reset="x")


def test_fill_does_not_leak_between_series(frame):
    rows = series([(1, 1), (2, 5), (3, 6)], stat="a") + series([(1, 10), (2, 30), (3, 31)], stat="b")
    out = counters.counter_deltas(frame(TOTALS, rows), fill_last=True, slice_snapshots=2)
    assert by_snap(out, "stat_name", "wait_time_delta") == [
        ("a", 4), ("a", 1), ("a", 1), ("b", 20), ("b", 1), ("b", 1)]


@pytest.mark.parametrize("width", [None, 2, 100])
def test_fill_forward_and_next_value(frame, width):
    df = frame("k STRING, o INT, v INT", [("a", 0, None), ("a", 1, 4), ("a", 2, None), ("a", 5, None), ("a", 6, 7),
                                          ("b", 3, None), ("b", 9, None)])
    cut = None if width is None else F.floor(F.col("o") / width)
    filled = fill_forward(df, ["k"], "o", "v", cut).orderBy("k", "o").collect()
    assert [r.v for r in filled] == [None, 4, 4, 4, 7, None, None]
    after = next_value(df, ["k"], "o", "o", "n", cut).orderBy("k", "o").collect()
    assert [r.n for r in after] == [1, 2, 5, 6, None, 9, None]


def snapshots(frame, rows):
    ddl = "dbid BIGINT, snap_id BIGINT, instance_number INT, begin_interval_time TIMESTAMP_NTZ, end_interval_time TIMESTAMP_NTZ"
    return frame(ddl, [(1, s, i, T0 + timedelta(hours=s), T0 + timedelta(hours=s + 1)) for s, i in rows])


def test_snapshot_fan_out_follows_the_keys(frame):
    facts = frame("con_id INT, dbid BIGINT, snap_id BIGINT, instance_number INT, stat_name STRING, value BIGINT",
                  [(1, 1, 5, 1, "s", 10), (1, 1, 5, 2, "s", 20)])
    snaps = snapshots(frame, [(5, 1), (5, 2)])
    loose = counters.counter_totals(facts, snaps, "2024-01-01", "2024-01-02")
    assert sorted(r.wait_time for r in loose.collect()) == [20, 40]
    keys = ("dbid", "snap_id", "instance_number")
    exact = counters.counter_totals(facts, snaps, "2024-01-01", "2024-01-02", snap_keys=keys)
    assert sorted(r.wait_time for r in exact.collect()) == [10, 20]


def test_snapshot_range_is_inclusive(frame):
    snaps = snapshots(frame, [(1, 1), (2, 1), (3, 1)])
    kept = counters.snapshot_range(snaps, "2024-01-01 02:00:00", "2024-01-01 04:00:00")
    assert sorted(r.snap_id for r in kept.collect()) == [2, 3]


def test_latch_rows_with_and_without_their_extra_keys(frame):
    facts = frame("con_id INT, dbid BIGINT, snap_id BIGINT, instance_number INT, latch_name STRING, `level#` INT,"
                  " latch_hash BIGINT, wait_time BIGINT",
                  [(1, 1, s, 1, "l", lv, 9, 100 * lv + s * s) for s in (1, 2, 3) for lv in (0, 1)])
    snaps = snapshots(frame, [(1, 1), (2, 1), (3, 1)])
    args = ("awr-latches", facts, snaps, "2024-01-01", "2024-01-03")
    apart = counters.counter_report(*args).orderBy("level#", "snap_id").collect()
    assert [r.wait_time_delta for r in apart] == [3, 5, None, 3, 5, None]
    mixed = counters.counter_report(*args, mix_extra=True).orderBy("snap_id", "level#").collect()
    assert [r.wait_time_delta for r in mixed] == [100, -97, 100, -95, 100, None]


def test_ranking_include_and_exclude(frame):
    rows = []
    for i in range(20):
        rows += series([(1, 0), (2, i)], stat=f"s{i:02d}")
    variances = counters.series_variance(frame(TOTALS, rows))
    idle = frame("name STRING, wait_class STRING", [("s19", "Idle"), ("s18", "Idle")])
    best = counters.top_series(variances, k=3, exclude=idle).orderBy("series_rank").collect()
    assert [r.stat_name for r in best] == ["s17", "s16", "s15"]
    more = counters.top_series(variances, k=3, exclude=idle, include=["s02", "s16", "s19"]).orderBy("series_rank")
    assert [(r.stat_name, r.series_rank) for r in more.collect()] == [
        ("s17", 1), ("s16", 2), ("s15", 3), ("s02", 4)]


def test_matrix_has_fixed_columns_and_zero_gaps(frame):
    rows = series([(1, 0), (2, 5), (3, 9)], stat="a") + series([(2, 1), (3, 2)], stat="b")
    totals = frame(TOTALS, rows).withColumn(
        "begin_interval_time", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, snap_id)"))
    chosen = counters.top_series(counters.series_variance(totals))
    points = counters.series_points(totals, chosen, fill_last=True)
    wide = counters.series_matrix(points, 3).orderBy("begin_interval_time").collect()
    assert [(r.series_01, r.series_02, r.series_03) for r in wide] == [(5.0, 0.0, 0.0), (4.0, 1.0, 0.0), (4.0, 1.0, 0.0)]
    legend = counters.series_legend(chosen).orderBy("series_rank").collect()
    assert [r.series for r in legend] == ["a@1", "b@1"]
    named = counters.named_matrix(points, ["b@1", "zz@1"]).orderBy("begin_interval_time").collect()
    assert [(r["b@1"], r["zz@1"]) for r in named] == [(0.0, 0.0), (1.0, 0.0), (1.0, 0.0)]


def test_chart_of_a_gauge_and_of_events_without_idle_ones(frame):
    snaps = snapshots(frame, [(1, 1), (2, 1), (3, 1)])
    history = frame("con_id INT, dbid BIGINT, snap_id BIGINT, instance_number INT, event_name STRING, time_waited_micro BIGINT",
                    [(1, 1, s, 1, n, s * w) for s in (1, 2, 3) for n, w in (("idle one", 100), ("busy", 5))])
    classes = frame("name STRING, wait_class STRING", [("idle one", "Idle"), ("busy", "Other")])
    points, chosen = counters.counter_chart("sys-event-hist", history, snaps, "2024-01-01", "2024-01-03",
                                            event_classes=classes)
    assert [r.stat_name for r in chosen.collect()] == ["busy"]
    assert sorted((r.time_label, r.wait_time_delta) for r in points.collect()) == [
        ("01-01 01:00", 5), ("01-01 02:00", 5), ("01-01 03:00", 5)]


def test_chart_from_stored_rows_equals_chart_from_history(frame):
    snaps = snapshots(frame, [(1, 1), (2, 1), (3, 1), (4, 1)])
    history = frame("con_id INT, dbid BIGINT, snap_id BIGINT, instance_number INT, latch_name STRING, `level#` INT,"
                    " latch_hash BIGINT, wait_time BIGINT",
                    [(1, 1, s, 1, n, lv, 9, s * s * w + lv) for s in (1, 2, 3, 4) for n, w in (("a", 3), ("b", 1), ("c", 2))
                     for lv in (0, 1)])
    args = ("awr-latches", history, snaps, "2024-01-01", "2024-01-03")
    points, chosen = counters.counter_chart(*args, k=2)
    stored, again = counters.section_chart("awr-latches", counters.counter_report(*args), k=2, slice_snapshots=2)
    columns = ["series", "`level#`", "snap_id", "time_label", "wait_time_delta", "series_rank"]
    assert sorted(map(tuple, stored.select(columns).collect())) == sorted(map(tuple, points.select(columns).collect()))
    assert [r.stat_name for r in again.orderBy("series_rank").collect()] == ["a", "c"]
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))


def test_rows_without_snapshot_count_in_the_variance_only(frame):
    """NULL snapshots, values and keys, with slices of any width: such rows are not shown, their values are part of the variance."""
    rng = random.Random(5)
    rows = []
    for con, stat in ((1, "a"), (None, "a"), (1, None), (2, "b")):
        snaps = rng.sample(range(-40, 40), 25)
        rows += series([(s, rng.choice([None, *range(500)])) for s in snaps], con=con, stat=stat)
        rows += series([(None, rng.choice([None, 7, 900])) for _ in range(4)], con=con, stat=stat)
    want = {}
    for con, stat in {(r[0], r[3]) for r in rows}:
        own = [r for r in rows if (r[0], r[3]) == (con, stat)]
        shown = sorted((r[4], r[5]) for r in own if r[4] is not None)
        spread = variance([r[5] for r in own if r[5] is not None])
        for (snap, value), (_, after) in zip(shown, [*shown[1:], (None, None)], strict=True):
            want[con, stat, snap] = (value, None if None in (value, after) else after - value, pytest.approx(spread))
    for width in (1, 3, 4096):
        out = counters.counter_deltas(frame(TOTALS, rows).repartition(5), slice_snapshots=width).collect()
        assert {(r.con_id, r.stat_name, r.snap_id): (r.wait_time, r.wait_time_delta, r.waits_var) for r in out} == want
        assert len(out) == len(want)


def test_slices_and_rows_read_one_shuffle(frame):
    rows = series([(s, s * s) for s in range(30)]) + series([(s, 3 * s) for s in range(30)], stat="t")
    totals = frame(TOTALS, rows).groupBy("con_id", "dbid", "instance_number", "stat_name", "snap_id").agg(
        F.sum("wait_time").alias("wait_time")).filter("snap_id IS NOT NULL")
    out = counters.counter_deltas(totals, slice_snapshots=7).select("stat_name", "snap_id", "wait_time", "waits_var")
    assert out.count() == 60 and len(out.collect()) == 60
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final
    dealt = [line for line in final.splitlines() if "hashpartitioning(xxhash64(_series" in line and "pmod(snap_id" in line]
    assert len(dealt) == 2 and sum("ReusedExchange" in line for line in dealt) == 1
