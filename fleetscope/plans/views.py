"""Display views of sections: tenant name joined, one tenant or all, the shown columns in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.functions.labels import project_existing, rename_columns
from fleetscope.operators.dims import join_tenant, major_version, with_whole_database
from fleetscope.operators.storage import temp_usage_matrix, usage_in_mb

# Columns shown per section; ``name`` is the tenant's name.
_USAGE = ["name", "tablespace_name", "file_size", "file_max_size", "file_free_space"]
_IO = ["name", "file_name", "phyrds", "singleblkrds", "readtim", "writetim", "singleblkrdtim", "avgiotim", "lstiotim",
       "miniotim", "maxiortm", "maxiowtm"]
_COUNTER = ["name", "instance_number", "stat_name", "begin_interval_time", "wait_time", "wait_time_delta", "waits_var"]
_TOP = ["name", "sql_id", "value", "sql_text"]
VIEWS = {
    "instance": ["instance_name", "host_name", "version", "startup_time", "status", "parallel"],
    "user-privs": ["name", "username", "default_tablespace", "temporary_tablespace", "granted_role", "default_role"],
    "datafiles": ["name_y", "name_x", "file#", "bytes", "status", "open_mode", "enabled", "ts#"],
    "tablespace-usage": _USAGE,
    "undo-tablespace-usage": _USAGE,
    "temp-tablespace-usage": ["name", "tablespace_name", "param", "value"],
    "sqlarea-summary": ["name", "instance_name", "total_sql", "totalsqlmem", "singleusesql", "singleusesqlmem",
                        "totalcurs", "cputime", "elapsetime"],
    "dbfile-iostat": _IO,
    "tempfile-iostat": _IO,
    "current-sessions": [
        "name", "inst_id", "sid", "serial#", "username", "status", "server", "schemaname", "osuser", "process", "machine",
        "port", "program", "sql_id", "sql_child_number", "sql_exec_start", "prev_sql_id", "prev_child_number",
        "prev_exec_start", "row_wait_obj#", "row_wait_file#", "logon_time", "blocking_session_status",
        "blocking_instance", "blocking_session", "final_blocking_session_status", "final_blocking_instance",
        "final_blocking_session", "event", "p1text", "p1", "p2text", "p2", "wait_class"],
    "uncommit-tx": ["name", "inst_id", "sid", "start_time", "username", "status", "sess_status", "ubablk"],
    "database-perf-load": ["name", "ten_min_timestr", "sess_count"],
    "ash-time-model": ["name", "tm", "state", "sess_cnt"],
    "db-auto-tasks": ["name", "client_name", "task_name", "operation_name", "status", "window_group_name", "enabled",
                      "next_start_date"],
}
# Session columns of databases without tenants, by the first release that has them.
SESSION_COLUMNS_WITHOUT_TENANT = {
    11: ["name", "inst_id", "sid", "serial#", "username", "status", "event", "p1text", "p1", "p2text", "p2", "wait_class",
         "sql_id", "row_wait_obj#", "row_wait_file#", "logon_time", "blocking_session_status", "blocking_instance",
         "blocking_session", "final_blocking_session_status", "final_blocking_instance", "final_blocking_session"],
    0: ["name", "sid", "serial#", "username", "status", "event", "p1text", "p1", "p2text", "p2", "wait_class", "sql_id",
        "row_wait_obj#", "row_wait_file#", "logon_time", "blocking_session_status", "blocking_session"],
}


def columns_of(section: str) -> list[str] | None:
    """Columns shown, or None for a section shown whole."""
    if section.startswith("topsql-"):
        return _TOP
    if section.startswith("awr-") or section.endswith("-hist"):
        return _COUNTER
    return VIEWS.get(section)


def session_columns(release: int, tenants: bool = True) -> list[str]:
    """Session columns for a major release."""
    if tenants:
        return VIEWS["current-sessions"]
    return SESSION_COLUMNS_WITHOUT_TENANT[11 if release >= 11 else 0]


#: First release with tenants.
TENANT_RELEASE = 12


def sessions_by_release(rows: DataFrame, instances: DataFrame, keys: Sequence[str] = ("bundle_id",)) -> DataFrame:
    """Sessions of databases of mixed releases in one table: each bundle shows the columns its major version has, the others are NULL.

    ``instances`` gives the version of each bundle's instances, of which the lowest counts. A bundle without a readable version shows what
    every release has. The version arrives by an equi-join with one row per bundle.
    """
    release = F.col("_release")
    versions = instances.groupBy(*keys).agg(F.min(major_version(F.col("version"))).alias("_release"))
    gates = [(release >= TENANT_RELEASE, session_columns(TENANT_RELEASE)), (release >= 11, session_columns(11, False)), (F.lit(True), session_columns(0, False))]
    shown = [c for c in dict.fromkeys(c for _, names in gates for c in names) if c in rows.columns]

    def masked(column: str) -> Column:
        cell, out = F.col(f"`{column}`"), None
        for applies, names in gates:
            value = cell if column in names else F.lit(None)
            out = F.when(applies, value) if out is None else out.when(applies, value)
        return out.cast(rows.schema[column].dataType).alias(column)

    joined = rows.join(versions, list(keys), "left") if keys else rows.withColumn("_release", versions.scalar())
    return joined.select(*keys, *map(masked, shown))


def view(section: str, rows: DataFrame, containers: DataFrame | None = None, tenant: str | None = None,
         keys: Sequence[str] = ("con_id",), labelled: bool = False) -> DataFrame:
    """Rows of a section as shown. Without ``containers`` (no tenants) names are not joined."""
    shown = rows
    own_name = "name" in rows.columns
    if containers is not None and "con_id" in rows.columns:
        tenants = with_whole_database(containers)
        if section == "datafiles":
            modes = tenants.select(*keys, "open_mode")
            renamed = rows.withColumnRenamed("name", "name_x")
            shown = join_tenant(renamed, tenants, keys, tenant=tenant, tenant_name="name_y").join(modes, list(keys))
        else:
            base = rows.drop("name") if own_name else rows
            shown = join_tenant(base, tenants, keys, tenant=tenant, tenant_name="name")
    wanted = columns_of(section)
    bundle = [c for c in keys if c == "bundle_id"]
    if wanted is not None:
        shown = project_existing(shown, [*bundle, *wanted])
    if section == "tablespace-usage":
        shown = usage_in_mb(shown)
    elif section == "undo-tablespace-usage":
        shown = usage_in_mb(shown, percent=False)
    elif section == "temp-tablespace-usage":
        shown = temp_usage_matrix(shown, [c for c in (*bundle, "name", "tablespace_name") if c in shown.columns])
    elif section == "ash-time-model":
        shown = shown.withColumn("sess_cnt", F.bround("sess_cnt", 0))
    return rename_columns(shown) if labelled else shown
