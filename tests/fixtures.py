"""Small native source tables, for one database or for a fleet of two."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetscope.plans.reports import Scope
from fleetscope.sources.schemas import schema_of

AS_OF = "2024-02-01 00:00:00"
NOW = datetime(2024, 2, 1)
ONE = Scope(as_of=AS_OF, begin="2024-01-25 00:00:00", end=AS_OF)
FLEET = Scope(as_of=AS_OF, begin="2024-01-25 00:00:00", end=AS_OF, bundle=("bundle_id",))


def hours(n):
    return NOW - timedelta(hours=n)


ROWS = {
    "containers": [(1, "ROOT", "READ WRITE"), (3, "PDB1", "READ WRITE")],
    "database": [(77, "ORA", "ARCHIVELOG", "CURRENT", "READ WRITE", "MAX", "MAX", "PRIMARY", "NONE", "NO", "NO", "NO",
                  "NO", "Linux", "NO", "NO", "NO", "ora_u", "YES")],
    "instance": [(1, 1, "ora1", "h1", "19.3.0.0.0", hours(500), "OPEN", "YES"),
                 (2, 2, "ora2", "h2", "19.3.0.0.0", hours(400), "OPEN", "YES")],
    "event_name": [("cpu", "Other"), ("cpu", "Other"), ("sleep", "Idle")],
    "tablespaces": [(1, "SYS", "PERMANENT", 8192), (3, "DATA", "PERMANENT", 8192), (3, "UNDO", "UNDO", 8192),
                    (3, "TEMP", "TEMPORARY", 8192), (1, "TEMP", "TEMPORARY", 8192)],
    "data_files": [(1, "SYS", 1, 1, 1000, 0, "NO"), (3, "DATA", 2, 2, 1000, 5000, "YES"),
                   (3, "DATA", 3, 3, 1000, 500, "YES"), (3, "UNDO", 4, 4, 2000, 9000, "NO"),
                   (3, "DATA", 5, 5, 10, None, "YES")],
    "free_space": [(3, "DATA", 2, 2, 100), (3, "DATA", 2, 2, 50), (3, "DATA", 9, 9, 777), (3, "UNDO", 4, 4, 400)],
    "temp_files": [(3, "TEMP", 1000 * 8192, 500, "YES"), (3, "TEMP", 1000 * 8192, 3000 * 8192, "YES"),
                   (1, "TEMP", 10, 99, "NO")],
    "sort_usage": [(3, "TEMP", 300), (3, "TEMP", 200)],
    "datafile": [(1, 1, "/a", 1048576, "SYSTEM", "RW", 0), (3, 2, "/b", 2097152, "ONLINE", "RW", 1),
                 (3, 3, "/c", 1048576, "ONLINE", "RW", 1), (3, 4, "/d", 1048576, "ONLINE", "RW", None)],
    "filestat": [(1, *range(11)), (2, *range(10, 21))],
    "log": [(1, 1, 512, "YES", "CURRENT"), (2, 1, 512, "NO", "INACTIVE")],
    "logfile": [(1, "/r1"), (1, "/r1b"), (3, "/r3")],
    "controlfile": [(None, "/ctl")],
    "recovery_file_dest": [("/fra", 10 * 1048576 + 5, 1048575)],
    "parameter": [(1, "db_block_size", "8192", 3, "TRUE"), (2, "db_block_size", "8192", 3, "TRUE"),
                  (1, "session_cached_cursors", "50", 3, "FALSE"), (2, "session_cached_cursors", "0", 3, "FALSE"),
                  (1, "open_cursors", "300", 3, "FALSE"), (2, "open_cursors", "100", 3, "TRUE"),
                  (1, "audit", "DB", 2, "FALSE"), (1, "odd", "x", None, "FALSE"),
                  (1, "db_file_multiblock_read_count", "16", 3, "TRUE"), (1, "sga_target", "1000", 6, "FALSE"),
                  (1, "pga_aggregate_target", "104857600", 6, "FALSE")],
    "statname": [(i, 10, "session cursor cache count") for i in (1, 2)] + [
        (i, 11, "opened cursors current") for i in (1, 2)] + [(1, 12, "other")],
    "sesstat": [(1, 5, 10, 40), (1, 6, 10, 50), (2, 5, 10, 7), (1, 5, 11, 30), (1, 5, 11, 20), (1, 6, 11, 45),
                (2, 9, 11, 100), (1, 5, 12, 9999)],
    "archive_dest": [(1, "D1", "VALID", 9, None), (2, "D1", "ERROR", 8, "full"), (1, "D2", "INACTIVE", 0, None)],
    "diag_info": [(1, "Diag Trace", "/t1"), (2, "Diag Trace", "/t2"), (1, "ADR", "/x")],
    "registry_history": [(hours(99), "APPLY", "SERVER", "19", "1", "first"), (hours(9), "APPLY", "SERVER", "19", None, "b")],
    "rman_status": [("BACKUP", "DB", "OK", hours(3), hours(2)), ("BACKUP COMMAND", "DB", "RUNNING", hours(1), None),
                    ("RESTORE", "DB", "OK", hours(9), hours(8))],
    "users": [(1, "A", "OPEN", NOW + timedelta(days=1), "U", "T"), (1, "B", "LOCKED", NOW + timedelta(days=1), "U", "T"),
              (3, "C", "EXPIRED(GRACE)", NOW + timedelta(days=29, seconds=86399), "U", "T"),
              (3, "D", "OPEN", NOW + timedelta(days=30), "U", "T"), (3, "E", "OPEN", None, "U", "T")],
    "role_privs": [(1, "A", "DBA", "YES"), (1, "A", "DEV", "NO"), (3, "B", "DBA", "YES")],
    "undostat": [(1, hours(1), 1, 2, 3, 4, 5, 7200), (1, hours(4), 1, 2, 3, 4, 5, 7200)],
    "statements": [(1, 1, "q1", "select 1", 4, 8, 200000, 0, 0, 3, 4, 40, 400, 0, 0, 0, 0, 10, 100, 200),
                   (3, 1, "q2", "select 2", 1, 2, 100, 0, 0, 1, 1, 10, 20, 0, 0, 0, 0, 1, 10, 20)],
    "statement_area": [(1, 1, 100, 1, 2, 10, 20), (1, 1, 300, 5, 1, 10, 20), (2, 3, 50, 1, 1, 1, 2)],
    "object_cache": [(1, "APP", "P", "PACKAGE", 2000, 20, "NO")],
    "transactions": [("A1", 7, "01/31", "ACTIVE", 3, 44, 10, 99)],
    "rollname": [(7, "_SYSSMU7")],
    "autotask_task": [(1, "stats", "t", "op", "ENABLED")],
    "autotask_client": [(1, "stats", "WG")],
    "window_groups": [(1, "WG", "TRUE", NOW)],
    "scheduler_jobs": [(1, "SYS", "J1", None, None, "PLSQL", NOW, "FREQ=DAILY", "TRUE", "SCHEDULED", 3, 0, NOW,
                        timedelta(minutes=1, seconds=30, milliseconds=900), NOW),
                       (1, "SYS", "J2", None, None, "PLSQL", NOW, None, "FALSE", "DISABLED", 0, 0, None, None, None)],
    # Lists [5,6], [5], [7], [5,6,9] of indexes 1-4 on table 100.
    "index_columns": [(1, 100, 1, 5), (1, 100, 2, 6), (2, 100, 1, 5), (3, 100, 1, 7), (4, 100, 1, 5), (4, 100, 2, 6),
                      (4, 100, 3, 9)],
    "indexes": [(i, 100, 0, 1, 1000, 100, 2, 10) for i in (1, 2, 3, 4)],
    "column_stats": [(100, c, 9.0) for c in (5, 6, 7, 9)],
    "tables": [(100, None, 1000, 100, 10, 200.0, 300.0, 1, 10, 1), (101, None, 100, 400, 0, 200.0, 300.0, 1, 10, 32767),
               (102, 1, 1000, 100, 10, 200.0, 300.0, 1, 10, 1)],
    "columns": [(100, 10), (100, 20), (101, 0)],
    "objects": [(i, 5, f"I{i}") for i in (1, 2, 3, 4)] + [(100, 5, "T100"), (101, 5, "T101")],
    "owners": [(5, "APP"), (0, "SYS")],
    "sga": [("Fixed Size", 1048576), ("Variable Size", 50 * 1048576), ("Database Buffers", 30 * 1048576),
            ("Redo Buffers", 1048576)],
    "sga_components": [("shared pool", 20 * 1048576, 4194304), ("large pool", 4 * 1048576, 4194304),
                       ("java pool", 4 * 1048576, 4194304), ("streams pool", 0, 4194304),
                       ("DEFAULT buffer cache", 16 * 1048576, 4194304), ("KEEP buffer cache", 8 * 1048576, 4194304),
                       ("DEFAULT 2K buffer cache", 0, 4194304), ("DEFAULT 8K buffer cache", 0, 4194304),
                       ("OSM Buffer Cache", 0, 4194304)],
    "sga_free": [(2 * 1048576,)],
    "cache_advice": [("DEFAULT", 8192, 0.5, 1.2), ("DEFAULT", 8192, 1.0, 1.0), ("KEEP", 8192, 1.0, 1.0),
                     ("KEEP", 8192, 2.0, None)],
    "shared_pool_advice": [(0.5, 1.0), (1.0, 1.0)],
    "java_pool_advice": [(0.5, 2.0), (1.0, 1.0)],
    "pga_advice": [(0.5, 60.0), (1.0, 100.0)],
}

SESSION = {
    "con_id": 3, "inst_id": 1, "serial#": 1, "username": "APP", "status": "ACTIVE", "machine": "m1", "event": "lock",
    "sql_id": "q1", "saddr": "00",
}
SESSIONS = [
    {"sid": 10, "saddr": "A1"},
    {"sid": 11, "blocking_instance": 1, "blocking_session": 10},
    {"sid": 12, "blocking_instance": 1, "blocking_session": 11, "status": "INACTIVE", "sql_id": None},
    {"sid": 13, "machine": "m2"},
    {"sid": 14, "blocking_instance": 1, "blocking_session": 999},
    {"sid": 15, "blocking_instance": 1, "blocking_session": 16},
    {"sid": 16, "blocking_instance": 1, "blocking_session": 15},
    {"sid": 17, "username": None},
]
SAMPLES = [(1, 77, 1, hours(5), "ON CPU", None, "FOREGROUND"), (1, 77, 1, hours(5), "WAITING", "User I/O", "FOREGROUND"),
           (1, 77, 2, hours(5) + timedelta(seconds=10), "WAITING", "Cluster", "FOREGROUND"),
           (1, 77, 3, hours(5) + timedelta(minutes=9, seconds=59), "WAITING", "Commit", "FOREGROUND"),
           (1, 77, 4, hours(5) + timedelta(minutes=10), "ON CPU", None, "BACKGROUND"),
           (1, 77, 5, hours(24 * 30), "ON CPU", None, "FOREGROUND")]


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    out = {name: spark.createDataFrame(rows, schema_of(name)) for name, rows in ROWS.items()}
    names = schema_of("sessions").fieldNames()
    out["sessions"] = spark.createDataFrame(
        [tuple((SESSION | s).get(n) for n in names) for s in SESSIONS], schema_of("sessions"))
    out["live_samples"] = spark.createDataFrame(SAMPLES[:3], schema_of("active_samples"))
    other = [(1, 78, 1, hours(5), "ON CPU", None, "FOREGROUND")] * 9
    out["persisted_samples"] = spark.createDataFrame(SAMPLES + other, schema_of("active_samples"))
    out["tempfile"] = out["datafile"]
    out["tempstat"] = out["filestat"]
    out["snapshot"] = spark.createDataFrame(
        [(77, s, 1, hours(100 - s), hours(99 - s)) for s in range(1, 5)], schema_of("snapshot"))
    history = spark.createDataFrame(
        [(c, 77, s, 1, n, float(s * s * w)) for c in (1, 3) for s in range(1, 5) for n, w in (("a", 1), ("b", 2), ("c", 0))],
        "con_id INT, dbid BIGINT, snap_id BIGINT, instance_number INT, stat STRING, amount DOUBLE")

    def hist(stat: str, value: str) -> DataFrame:
        return history.select("con_id", "dbid", "snap_id", "instance_number", F.col("stat").alias(stat),
                              F.col("amount").cast("bigint").alias(value))

    out |= {
        "hist_latch": hist("latch_name", "wait_time").withColumns({"level#": F.lit(1), "latch_hash": F.lit(7)}),
        "hist_bg_event_summary": hist("event_name", "time_waited_micro"),
        "hist_sgastat": hist("name", "bytes"),
        "hist_sys_time_model": hist("stat_name", "value"),
        "hist_dlm_misc": hist("name", "value"),
        "hist_enqueue_stat": hist("eq_type", "cum_wait_time"),
        "hist_filestatxs": hist("filename", "time"),
        "hist_osstat": hist("stat_name", "value"),
        "hist_sqlstat": hist("sql_id", "elapsed_time_total"),
        "hist_sysstat": hist("stat_name", "value"),
        "hist_system_event": hist("event_name", "time_waited_micro"),
    }
    return out


def fleet_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The same database twice, under two bundle ids."""
    ids = F.explode(F.array(F.lit("db1"), F.lit("db2")))
    return {n: df.select("*", ids.alias("bundle_id")) for n, df in tables(spark).items()}
