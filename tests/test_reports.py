"""Reports on native source tables: values, section names, and fleet against one database."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import config, dims, indexes, memory, samples, sessions, storage
from fleetscope.operators.counters import SYSTEM_STATISTICS
from fleetscope.plans.reports import REPORTS, collect_sections, run_chart, run_report
from fleetscope.plans.views import VIEWS, columns_of, session_columns, view
from fleetscope.sources.schemas import SECTIONS, schema_of
from tests.fixtures import AS_OF, FLEET, ONE, fleet_tables, tables


@pytest.fixture(scope="module")
def one(spark):
    return tables(spark)


@pytest.fixture(scope="module")
def fleet(spark):
    return fleet_tables(spark)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_every_section_has_a_report():
    assert set(SECTIONS) <= set(REPORTS)


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_fleet_repeats_the_single_database(one, fleet, name):
    """Two copies of a database give each bundle the single database's report."""
    alone = run_report(name, one, ONE)
    many = run_report(name, fleet, FLEET)
    assert "bundle_id" in many.columns
    extra = [c for c in many.columns if c not in alone.columns and c != "bundle_id"]
    assert extra in ([], ["place"])
    expected = rows(alone)
    got = many.select("bundle_id", *[f"`{c}`" for c in alone.columns]).collect()
    for bundle in ("db1", "db2"):
        assert sorted((tuple(r)[1:] for r in got if r.bundle_id == bundle), key=repr) == expected


@pytest.mark.parametrize("name", sorted(SECTIONS))
def test_columns_of_sections(one, name):
    """A report has at least its section's columns."""
    assert set(schema_of(name).fieldNames()) <= set(run_report(name, one, ONE).columns)


def test_chart_of_events_leaves_idle_ones_out(one, fleet, frame):
    names = frame("name STRING, wait_class STRING", [("b", "Idle"), ("a", "Other")])
    points, legend = run_chart("sys-event-hist", {**one, "event_name": names}, ONE)
    assert rows(legend, "con_id", "stat_name", "series_rank") == [(1, "a", 1), (3, "a", 1)]
    assert {r.stat_name for r in points.collect()} == {"a"} and points.count() == 2 * 4
    per_bundle = frame("bundle_id STRING, name STRING, wait_class STRING", [("db1", "b", "Idle"), ("db2", "a", "Idle")])
    _, legend = run_chart("sys-event-hist", {**fleet, "event_name": per_bundle}, FLEET)
    assert set(rows(legend, "bundle_id", "stat_name")) == {("db1", "a"), ("db2", "b")}


def test_chart_of_statistics_keeps_listed_ones(one):
    listed = SYSTEM_STATISTICS[0]
    named = F.when(F.col("stat_name") == "a", listed).otherwise(F.col("stat_name"))
    _, legend = run_chart("sys-stat-hist", {**one, "hist_sysstat": one["hist_sysstat"].withColumn("stat_name", named)}, ONE, k=1)
    assert rows(legend, "con_id", "stat_name", "series_rank") == [(1, "b", 1), (1, listed, 2), (3, "b", 1), (3, listed, 2)]


def test_snapshots_of_each_instance(one):
    """With a snapshot row for each instance, naming the instance keeps sums from doubling."""
    second = {n: one[n].unionByName(one[n].withColumn("instance_number", F.lit(2).cast(one[n].schema["instance_number"].dataType)))
              for n in ("snapshot", "hist_sysstat")}
    scope = replace(ONE, snap_keys=("dbid", "snap_id", "instance_number"))
    got = run_report("sys-stat-hist", {**one, **second}, scope)
    expected = run_report("sys-stat-hist", one, ONE)
    for instance in (1, 2):
        assert rows(got.filter(F.col("instance_number") == instance).drop("instance_number")) == rows(expected.drop("instance_number"))


def test_status_and_state_filters(one):
    sessions_all, jobs_all = rows(run_report("current-sessions", one, ONE), "status"), rows(run_report("sched-jobs", one, ONE), "state")
    status, state = sessions_all[0][0], jobs_all[0][0]
    scope = replace(ONE, session_status=status, job_state=state)
    assert rows(run_report("current-sessions", one, scope), "status") == [r for r in sessions_all if r[0] == status]
    assert rows(run_report("sched-jobs", one, scope), "state") == [r for r in jobs_all if r[0] == state]
    assert run_report("current-sessions", one, replace(ONE, session_status="nothing")).count() == 0


def test_missing_source_is_named(one):
    with pytest.raises(KeyError, match="statements"):
        run_report("topsql-cpu", {}, ONE)
    assert set(collect_sections({"database": one["database"]}, ONE)) == {"database", "database-settings"}


def test_tablespaces(one):
    assert rows(run_report("tablespace-usage", one, ONE)) == [
        (1, "SYS", 1000, 1000, 0), (3, "DATA", 2010, 6000, 150)]
    assert rows(run_report("undo-tablespace-usage", one, ONE)) == [(3, "UNDO", 2000, 2000, 400)]
    mb = storage.usage_in_mb(run_report("tablespace-usage", one, ONE).withColumns(
        {c: F.col(c) * 1048576 for c in ("file_size", "file_max_size", "file_free_space")}))
    assert rows(mb, "tablespace_name", "usage_percent") == [("DATA", 92.54), ("SYS", 100.0)]


def test_temp_tablespaces(one):
    got = rows(run_report("temp-tablespace-usage", one, ONE))
    assert got == sorted([
        (3, "TEMP", "filesize", 2000 * 8192), (3, "TEMP", "maxsize", 4000 * 8192), (3, "TEMP", "usedbytes", 500 * 8192),
        (3, "TEMP", "pctfree", 75), (1, "TEMP", "filesize", 10), (1, "TEMP", "maxsize", 10), (1, "TEMP", "usedbytes", 0),
        (1, "TEMP", "pctfree", 100)], key=repr)
    wide = storage.temp_usage_matrix(run_report("temp-tablespace-usage", one, ONE).filter("con_id = 3")).first()
    assert (wide.filesize, wide.maxsize, wide.usedbytes, wide.pctfree) == (15.62, 31.25, 3.91, 75.0)


def test_temp_rows_without_counterpart(one, frame):
    """Files without a known tablespace have no maxsize; a tablespace without files has only usedbytes."""
    files = frame("con_id INT, tablespace_name STRING, bytes BIGINT, maxbytes BIGINT, autoextensible STRING",
                  [(9, "GONE", 100, 200, "YES")])
    spaces = one["tablespaces"].filter("con_id = 3")
    assert rows(storage.temp_usage(files, spaces, one["sort_usage"]), "tablespace_name", "param", "value") == [
        ("GONE", "filesize", 100), ("GONE", "pctfree", 100), ("TEMP", "usedbytes", 500 * 8192)]


def test_file_reports(one):
    assert rows(run_report("datafile-overview", one, ONE)) == [(4, 5.0, 2)]
    assert [r[1] for r in rows(run_report("dbfile-iostat", one, ONE))] == ["/a", "/b"]
    assert rows(run_report("redo-log", one, ONE), "group_id", "member") == [(1, "/r1"), (1, "/r1b")]
    assert rows(run_report("fra-summary", one, ONE), "space_limit", "space_used") == [(10, 0)]


def test_configuration_reports(one):
    assert [r.patch_info for r in run_report("patch-info", one, ONE).collect()] == [
        "APPLY:SERVER:19::b", "APPLY:SERVER:19:1:first"]
    assert [r.patch_info for r in run_report("patch-info-latest", one, ONE).collect()] == ["APPLY:SERVER:19::b"]
    assert rows(run_report("alert-dest", one, ONE)) == [("ora1", "/t1/alert_ora1.log"), ("ora2", "/t2/alert_ora2.log")]
    assert rows(run_report("arl-dest-info", one, ONE)) == sorted([
        ("ora1", "D1", "status", "VALID"), ("ora1", "D1", "sequence#", "9"), ("ora1", "D1", "error", None),
        ("ora2", "D1", "status", "ERROR"), ("ora2", "D1", "sequence#", "8"), ("ora2", "D1", "error", "full")], key=repr)
    off = dict(one) | {"database": one["database"].withColumn("log_mode", F.lit("NOARCHIVELOG"))}
    assert run_report("arl-dest-info", off, ONE).count() == 0
    backups = run_report("backup-info", one, ONE).collect()
    assert [(r.operation, r.elapsed.total_seconds()) for r in backups] == [("BACKUP", 3600), ("BACKUP COMMAND", 3600)]
    assert rows(run_report("parameter-num", one, ONE), "instance_name", "name") == [
        ("ora1", "open_cursors"), ("ora1", "pga_aggregate_target"), ("ora1", "session_cached_cursors"),
        ("ora1", "sga_target"), ("ora2", "session_cached_cursors")]
    assert rows(run_report("parameter-nonnum", one, ONE)) == [("ora1", "audit", "DB")]
    assert rows(run_report("expiring-user", one, ONE).selectExpr("username", "int(expiring_secs)")) == [
        ("A", 86400), ("C", 29 * 86400 + 86399)]
    assert rows(run_report("user-privs", one, ONE), "con_id", "username", "granted_role") == [
        (1, "A", "DBA"), (1, "A", "DEV"), (1, "B", ""), (3, "C", ""), (3, "D", ""), (3, "E", "")]
    settings = dict(rows(run_report("database-settings", one, ONE), "setting", "value"))
    assert len(settings) == 17 and settings["cdb"] == "YES"
    old = config.database_settings(one["database"].drop("cdb"))
    assert "cdb" not in {r.setting for r in old.collect()}


def test_cursor_efficiency(one):
    assert rows(run_report("cursor-efficiency", one, ONE), "inst_id", "parameter", "value", "usage") == [
        (1, "open_cursors", "  300", "  17%"), (1, "session_cached_cursors", "   50", " 100%"),
        (2, "open_cursors", "  100", " 100%"), (2, "session_cached_cursors", "    0", "  n/a")]


def test_jobs_and_undo(one):
    jobs = run_report("sched-jobs", one, ONE)
    assert rows(jobs, "job_name", "last_run_duration") == [("J1", 90), ("J2", None)]
    assert config.scheduler_jobs(one["scheduler_jobs"], "DISABLED").count() == 1
    assert config.scheduler_jobs(one["scheduler_jobs"], "ALL").count() == 2
    assert run_report("db-auto-tasks", one, ONE).count() == 1
    assert rows(run_report("undo-stat", one, ONE), "begin_time", "hours") == [("01/31/2024 23:00", 2.0)]
    assert rows(run_report("idle-events", one, ONE)) == [("cpu", "Other"), ("sleep", "Idle")]


def test_sessions(one):
    listed = run_report("current-sessions", one, ONE)
    assert listed.count() == 7
    assert rows(listed.filter("sid = 10"), "blocking_instance", "blocking_session") == [(0, 0)]
    assert sessions.user_sessions(one["sessions"], "inactive").count() == 1
    assert run_report("sessions-by-user-machine", one, ONE).first().cnt == 6
    assert rows(run_report("sessions-by-sql", one, ONE)) == [("q1", 6)]
    tree = run_report("session-blocking", one, ONE)
    assert rows(tree, "id", "root", "depth", "value") == [
        ("1_10", "1_10", 0, 10), ("1_11", "1_10", 1, 11), ("1_12", "1_10", 2, 12)]
    assert rows(run_report("uncommit-tx", one, ONE), "sid", "undo_name", "blk") == [(10, "_SYSSMU7", 80.0)]


def test_statement_reports(one):
    assert rows(run_report("sqlarea-summary", one, ONE)) == [
        ("ora1", 1, 2, 400, 1, 100, 3, 20, 40), ("ora2", 3, 1, 50, 1, 50, 1, 1, 2)]
    assert rows(run_report("topsql-buffer-get", one, ONE), "con_id", "sql_id", "value") == [(1, "q1", 400), (3, "q2", 20)]
    assert rows(run_report("pin-sql", one, ONE), "sql_text", "loads") == [("select 1", 3)]
    assert rows(run_report("pin-plsql", one, ONE), "name") == [("P",)]


def test_load_and_states(one):
    """Live and persisted samples overlap; the maximum hides the repeat. Another dbid does not count."""
    assert rows(run_report("database-perf-load", one, ONE)) == [(1, "2024-01-31 19:00", 2), (1, "2024-01-31 19:10", 1)]
    own = dict(one) | {"persisted_samples": one["persisted_samples"].filter("dbid = 77")}
    got = rows(run_report("ash-time-model", own, ONE).withColumn("n", F.round(F.col("sess_cnt") * 360)), "tm", "state", "n")
    assert got == [("01-31 19:00", s, 1.0) for s in ("CLUSTER", "CPU", "IO", "WAIT")]


def test_bucket_counts_add_up(one):
    kept = one["persisted_samples"]
    whole = samples.active_by_state(kept, "2000-01-01", "2100-01-01", samples_per_bucket=1)
    assert whole.agg(F.sum("sess_cnt")).first()[0] == kept.filter("session_type = 'FOREGROUND'").count()


def test_memory(one):
    got = {r.memory_component: r for r in run_report("memory-info", one, ONE).collect()}
    assert set(got) == {
        "Fixed", "Variable", "Database Buffers", "Redo Buffers", "Shared Pool", "Large Pool", "Java Pool", "Streams Pool",
        "DB Cache (Default 8k)", "DB Keep Cache", "DB 2k Cache", "PGA Aggregate Target", "Variable: Others", "Free"}
    pick = lambda n, *c: tuple(got[n][x] for x in c)
    assert pick("Shared Pool", "parent_group", "second_group", "hasadvisory", "parameter", "default_order",
                "collection_status", "minimum_size", "maximum_size", "sgamode") == (
        "2", "1", "Y", "shared_pool_size", 1, "N", 20.0, 10239, "A")
    assert pick("DB Cache (Default 8k)", "second_group", "parameter", "default_order", "collection_status",
                "minimum_size", "sgamode") == ("3", "db_cache_size", 2, "Y", 4.0, "A")
    assert pick("DB Keep Cache", "parameter", "collection_status", "minimum_size") == ("db_keep_cache_size", "N", 0.0)
    assert pick("DB 2k Cache", "parameter", "collection_status", "parent_memory_component") == (
        "db_2k_cache_size", "B", "Database Buffers")
    assert pick("PGA Aggregate Target", "memory_size", "mc_type", "collection_status", "minimum_size", "maximum_size",
                "parent_group") == (100.0, "PGA", "Y", 10.0, 4194303, "5")
    assert pick("Variable: Others", "memory_size", "second_group", "isfixedsize") == (20.0, "5", "Y")
    assert pick("Java Pool", "collection_status") == ("Y",)
    assert pick("Large Pool", "hasadvisory", "collection_status", "sgamode") == ("N", None, "A")
    assert pick("Redo Buffers", "isfixedsize", "parent_group", "second_group") == ("Y", "4", None)
    tree = memory.memory_forest(run_report("memory-info", one, ONE))
    assert tree.count() == 14 and tree.filter("root = 'Variable'").count() == 7
    assert rows(memory.value_range(run_report("memory-info", one, ONE), "memory_size")) == [(0.0, 100.0)]


def test_dictionary(one):
    assert rows(run_report("redundent-indexes", one, ONE)) == [
        ("APP.I1", "APP.I4"), ("APP.I2", "APP.I1"), ("APP.I2", "APP.I4")]
    unique = dict(one) | {"indexes": one["indexes"].withColumn("property", F.when(F.col("`obj#`") == 2, 1).otherwise(0))}
    assert rows(run_report("redundent-indexes", unique, ONE)) == [("APP.I1", "APP.I4")]
    usable = 8192 - 66 - 48
    need = 1000 * (20 + 11)
    sparse = {r.index_name: r for r in run_report("low-density-indexes", one, ONE).collect()}
    assert set(sparse) == {"APP.I1", "APP.I2", "APP.I3", "APP.I4"}
    assert sparse["APP.I1"].extra_blocks == int(90 - need / usable)
    assert sparse["APP.I1"].density == "  3.84%"
    migrated = run_report("row-migration", one, ONE).collect()
    fit = (8192 - 66 - 24) // 202
    assert [(r.table_name, r.mrows, r.migration, r.minimize) for r in migrated] == [("APP.T100", 10, "    1.00%", fit)]
    density = run_report("table-density", one, ONE).collect()
    assert [(r.table_name, r.degree, r.density, r.new_free, r.reads_wasted) for r in density] == [
        ("APP.T101", "DEFAULT", "   .63%", 1, 25)]


def test_equal_lists_report_each_other(frame):
    columns = frame("`bo#` INT, `obj#` INT, `pos#` INT, `intcol#` INT",
                    [(1, 1, 1, 5), (1, 1, 2, 6), (1, 2, 1, 5), (1, 2, 2, 6), (2, 3, 1, 5), (1, 4, 2, 5)])
    assert rows(indexes.redundant_prefixes(columns), "redundant", "sufficient") == [(1, 2), (2, 1)]


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_redundant_prefixes_against_brute_force(frame, monkeypatch, width):
    monkeypatch.setattr(indexes, "LIST_SLICE", width)
    rng = random.Random(width)
    lists = {(t, t * 100 + i): [rng.randrange(2) for _ in range(rng.randrange(1, 6))] for t in (1, 2) for i in range(12)}
    entries = [(t, i, p + 1, c) for (t, i), cols in lists.items() for p, c in enumerate(cols)]
    gap = [(1, 999, 2, 0), (1, 999, 3, 1)]
    columns = frame("`bo#` INT, `obj#` INT, `pos#` INT, `intcol#` INT", entries + gap)
    expected = sorted(((a, b) for (t, a), x in lists.items() for (u, b), y in lists.items()
                       if t == u and a != b and y[: len(x)] == x), key=repr)
    assert rows(indexes.redundant_prefixes(columns), "redundant", "sufficient") == expected


def test_tenant_dimension(one, fleet):
    whole = dims.with_whole_database(one["containers"])
    assert (0, "Entire CDB", None) in rows(whole)
    assert dims.with_whole_database(fleet["containers"]).filter("con_id = 0").count() == 2
    facts = one["datafile"]
    named = dims.join_tenant(facts, whole, tenant_name="tenant")
    assert named.count() == 4
    assert dims.join_tenant(facts, whole, tenant_name="tenant", tenant="PDB1").count() == 3
    assert dims.join_tenant(facts, whole, tenant="All").columns[-1] == "tenant_name"
    assert AS_OF == ONE.as_of


@pytest.mark.parametrize("name", sorted(set(VIEWS) - {"instance", "datafiles", "temp-tablespace-usage"}) + ["topsql-cpu", "awr-latches"])
def test_views_show_their_columns(one, name):
    shown = view(name, run_report(name, one, ONE), one["containers"])
    assert shown.columns[: len(columns_of(name))] == columns_of(name)
    assert set(r.name for r in shown.select("name").distinct().collect()) <= {"ROOT", "PDB1"}


def test_views_filter_and_reshape(one):
    files = view("datafiles", one["datafile"], one["containers"], tenant="PDB1")
    assert files.columns == VIEWS["datafiles"] and files.count() == 3
    temp = view("temp-tablespace-usage", run_report("temp-tablespace-usage", one, ONE), one["containers"])
    assert rows(temp, "name", "usedbytes") == [("PDB1", 3.91), ("ROOT", 0.0)]
    usage = view("tablespace-usage", run_report("tablespace-usage", one, ONE), one["containers"], labelled=True)
    assert usage.columns[:2] == ["名称", "表空间_名称"]
    plain = view("topsql-cpu", run_report("topsql-cpu", one, ONE).drop("con_id"))
    assert plain.columns == ["sql_id", "value", "sql_text"]
    assert session_columns(10, False)[1] == "sid" and session_columns(19)[-1] == "wait_class"


def test_outer_join_with_many_matches(frame):
    left = frame("k INT, a STRING", [(1, "x"), (2, "y"), (None, "z")])
    right = frame("k INT, b STRING", [(1, "p"), (1, "q")])
    got = dims.left_join_many(left, right, ["k"])
    assert rows(got) == rows(left.join(right, ["k"], "left"))
