"""Configuration, security and maintenance reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.functions.labels import project_existing
from fleetscope.functions.nulls import concat_nn
from fleetscope.functions.numbers import number_text
from fleetscope.functions.times import days, interval_seconds, ntz, seconds_between
from fleetscope.operators.dims import (
    at_latest, equal_to_value, filter_equal, left_join_many, sorted_by, with_value,
)
from fleetscope.operators.reshape import metric_rows, settings_rows


def patch_text(*columns: str) -> Column:
    """Fields joined by colons; a missing field leaves its place empty."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit(":"), F.col(c)]
    return concat_nn(*parts[1:])


def patch_history(registry: DataFrame, latest_only: bool = False, keys: Sequence[str] = (),
                  fields: Sequence[str] = ("action", "namespace", "version", "id", "comments"),
                  at: str = "action_time", ordered: bool = True) -> DataFrame:
    """Patch actions, newest first; ``latest_only`` keeps those of the newest moment."""
    rows = at_latest(registry, at, keys) if latest_only else registry
    shown = rows.select(*keys, at, patch_text(*fields).alias("patch_info"))
    return sorted_by(shown, F.col(at).desc_nulls_first(), ordered=ordered)


def log_paths(instances: DataFrame, diag_info: DataFrame, link: Sequence[str] = (),
              setting: str = "Diag Trace") -> DataFrame:
    """Path of the alert log per instance."""
    keys = [*link, "inst_id"]
    folder = diag_info.filter(F.col("name") == setting).select(*keys, "value")
    path = concat_nn(F.col("value"), F.lit("/alert_"), F.col("instance_name"), F.lit(".log"))
    return instances.join(folder, keys).select(*link, "instance_name", path.alias("path"))


def archive_destinations(destinations: DataFrame, instances: DataFrame, database: DataFrame,
                         link: Sequence[str] = ()) -> DataFrame:
    """Active archive destinations as rows (instance, destination, metric, value); none unless archiving."""
    keys = [*link, "inst_id"]
    active = destinations.filter(F.col("status") != "INACTIVE")
    archiving = with_value(active, database, "log_mode", "_mode", link).filter(F.col("_mode") == "ARCHIVELOG")
    named = archiving.join(instances.select(*keys, "instance_name"), keys)
    metrics = {"status": F.col("status"), "sequence#": F.col("log_sequence").cast("string"), "error": F.col("error")}
    return metric_rows(named, [*link, "instance_name", "dest_name"], metrics)


def backup_history(operations: DataFrame, as_of, pattern: str = "BACKUP%", keys: Sequence[str] = (),
                   operation: str = "operation", start: str = "start_time", end: str = "end_time",
                   ordered: bool = True) -> DataFrame:
    """Backup operations by start, with their elapsed time; a running one counts up to ``as_of``."""
    wanted = [*keys, operation, *[c for c in ("object_type", "status") if c in operations.columns], start, end]
    rows = operations.filter(F.col(operation).like(pattern)).select(*wanted)
    closed = rows.withColumn(end, F.coalesce(F.col(end), F.lit(as_of).cast(operations.schema[end].dataType)))
    timed = closed.withColumn("elapsed", F.col(end) - F.col(start))
    return sorted_by(timed, F.col(start).asc_nulls_last(), ordered=ordered)


def changed_parameters(parameters: DataFrame, instances: DataFrame, numeric: bool, link: Sequence[str] = (),
                       numeric_types: Sequence[int] = (3, 6)) -> DataFrame:
    """Parameters not at their default, numeric or other, by instance."""
    of_type = F.col("type").isin(list(numeric_types))
    kept = parameters.filter((of_type if numeric else ~of_type) & (F.col("isdefault") == "FALSE"))
    named = instances.select(*link, F.col("instance_number").alias("inst_id"), "instance_name")
    return kept.select(*link, "inst_id", "name", "value").join(named, [*link, "inst_id"]).select(
        *link, "instance_name", "name", "value"
    )


# Account states whose password can still expire.
OPEN_STATES = ["OPEN", "EXPIRED(GRACE)"]


def expiring_users(users: DataFrame, as_of: str, horizon_days: float = 30, keys: Sequence[str] = ("con_id",),
                   expiry: str = "expiry_date", states: Sequence[str] | None = tuple(OPEN_STATES)) -> DataFrame:
    """Users whose password expires within the horizon, with the seconds left."""
    now = ntz(as_of)
    due = (F.col(expiry) > now) & (F.col(expiry) < now + days(horizon_days))
    rows = users.filter(due) if states is None else users.filter(due & F.col("account_status").isin(list(states)))
    return rows.select(*keys, "username", seconds_between(now, ntz(F.col(expiry))).alias("expiring_secs"))


def user_roles(users: DataFrame, grants: DataFrame, keys: Sequence[str] = ("con_id",),
               ordered: bool = True) -> DataFrame:
    """Users with their roles; a user without roles keeps one row with empty texts."""
    roles = grants.withColumnRenamed("grantee", "username").select(*keys, "username", "granted_role", "default_role")
    named = users.select(*keys, "username", "default_tablespace", "temporary_tablespace")
    texts = ["default_tablespace", "temporary_tablespace", "granted_role", "default_role"]
    joined = left_join_many(named, roles, [*keys, "username"]).na.fill("", texts)
    return sorted_by(joined, *keys, "username", ordered=ordered)


def cursor_efficiency(statname: DataFrame, sesstat: DataFrame, parameter: DataFrame,
                      link: Sequence[str] = ()) -> DataFrame:
    """Use of the session cursor cache and of open cursors against their limits.

    Both statistics are read in one pass over the session statistics: a sum per session, then the
    largest per instance. The cache count takes the largest single value instead of the sum.
    """
    instance = [*link, "inst_id"]
    # Parameter -> statistic, text shown for a limit of zero.
    cached = ("session_cached_cursors", "session cursor cache count")
    opened = ("open_cursors", "opened cursors current")
    names = F.when(F.col("name") == cached[1], cached[0]).when(F.col("name") == opened[1], opened[0])
    wanted = statname.filter(F.col("name").isin(cached[1], opened[1])).select(
        *instance, "statistic#", names.alias("parameter")
    )
    per_session = (
        sesstat.join(wanted, [*instance, "statistic#"])
        .groupBy(*instance, "parameter", "sid")
        .agg(F.max("value").alias("_largest"), F.sum("value").alias("_total"))
    )
    used = per_session.groupBy(*instance, "parameter").agg(
        F.max(F.when(F.col("parameter") == cached[0], F.col("_largest")).otherwise(F.col("_total"))).alias("used")
    )
    limits = parameter.select(*instance, F.col("name").alias("parameter"), F.col("value").alias("limit_text"))
    limit = F.col("limit_text").cast("decimal(20,0)")
    percent = F.try_divide(F.col("used").cast("decimal(20,0)") * 100, limit)
    shown = F.when((limit == 0) & (F.col("parameter") == cached[0]), F.lit("  n/a")).otherwise(
        F.concat(number_text(percent, 3, leading_zero=True), F.lit("%"))
    )
    return used.join(limits, [*instance, "parameter"]).select(
        *instance, "parameter", F.when(F.length("limit_text") < 5, F.lpad("limit_text", 5, " ")).otherwise(F.col("limit_text")).alias("value"), shown.alias("usage"),
        percent.cast("double").alias("usage_pct"),
    )


# Database settings shown.
DATABASE_COLUMNS = [
    "dbid", "name", "log_mode", "controlfile_type", "open_mode", "protection_mode", "protection_level",
    "database_role", "switchover_status", "supplemental_log_data_min", "supplemental_log_data_pk",
    "supplemental_log_data_ui", "force_logging", "platform_name", "flashback_on", "supplemental_log_data_fk",
    "supplemental_log_data_all", "db_unique_name", "cdb",
]


def database_settings(database: DataFrame, ids: Sequence[str] = ("dbid", "name"),
                      columns: Sequence[str] = tuple(DATABASE_COLUMNS), keys: Sequence[str] = ()) -> DataFrame:
    """Database configuration as rows (setting, value); columns an old version lacks are left out."""
    return settings_rows(project_existing(database, [*keys, *columns]), [*keys, *ids])


def maintenance_tasks(tasks: DataFrame, clients: DataFrame, windows: DataFrame,
                      keys: Sequence[str] = ("con_id",)) -> DataFrame:
    """Automatic maintenance tasks with the window group that runs them."""
    client = clients.select(*keys, "client_name", F.col("window_group").alias("window_group_name"))
    return (
        tasks.select(*keys, "client_name", "task_name", "operation_name", "status")
        .join(client, [*keys, "client_name"])
        .join(windows.select(*keys, "window_group_name", "enabled", "next_start_date"), [*keys, "window_group_name"])
        .select("client_name", "task_name", "operation_name", "status", *keys, "window_group_name", "enabled",
                "next_start_date")
    )


def scheduler_jobs(jobs: DataFrame, state: str | None = None) -> DataFrame:
    """Scheduler jobs with the last run's length in whole seconds; ``state`` filters."""
    seconds = interval_seconds(F.col("last_run_duration")).cast("bigint")
    rows = filter_equal(jobs, "state", state).withColumn("last_run_duration", seconds)
    return rows.withColumn("repeat_interval", F.col("repeat_interval").cast("string"))


def event_classes(event_names: DataFrame, columns: Sequence[str] = ("name", "wait_class")) -> DataFrame:
    """Distinct (event, wait class) pairs."""
    return event_names.select(*columns).distinct()


def undo_statistics(undostat: DataFrame, as_of: str, span_days: float = 0.16, keys: Sequence[str] = (),
                    ordered: bool = True) -> DataFrame:
    """Undo statistics of the last ``span_days``, retention also in hours."""
    now = ntz(as_of)
    counters = ["unxpstealcnt", "expstealcnt", "ssolderrcnt", "nospaceerrcnt", "maxquerylen", "tuned_undoretention"]
    recent = undostat.filter(ntz(F.col("begin_time")).between(now - days(span_days), now))
    return sorted_by(recent, *keys, "inst_id", "begin_time", ordered=ordered).select(
        *keys, "inst_id", F.date_format("begin_time", "MM/dd/yyyy HH:mm").alias("begin_time"), *counters,
        (F.col("tuned_undoretention") / 3600).alias("hours"),
    )


def current_database(rows: DataFrame, database: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Persisted rows of the present database only (``dbid`` equality)."""
    return equal_to_value(rows, "dbid", database, keys)
