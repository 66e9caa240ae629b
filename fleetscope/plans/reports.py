"""Every report by section name: which source tables it reads and how it is built."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from fleetscope.functions.labels import lower_names
from fleetscope.operators import config, counters, indexes, memory, samples, sessions, storage, topk
from fleetscope.plans import views
from fleetscope.sources import sinks
from fleetscope.sources.schemas import schema_of

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Scope:
    """Keys and times of a run.

    ``tenant`` is empty for a database without tenants; ``bundle`` is ``("bundle_id",)`` for a fleet.
    ``snap_keys`` joins counters with snapshots: name the instance where each has snapshot rows of its own.
    ``session_status`` and ``job_state`` filter the session and job reports. ``paths=False`` leaves the lists of ancestors out of forests.
    """

    as_of: str
    begin: str
    end: str
    tenant: tuple[str, ...] = ("con_id",)
    bundle: tuple[str, ...] = ()
    numeric_parameter_types: tuple[int, ...] = (3, 6)
    snap_keys: tuple[str, ...] | None = None
    session_status: str | None = None
    job_state: str | None = None
    paths: bool = True

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.bundle, *self.tenant)


@dataclass(frozen=True)
class Report:
    inputs: tuple[str, ...]
    build: Callable[[Tables, Scope], DataFrame]


REPORTS: dict[str, Report] = {}


def report(name: str, *inputs: str):
    def register(build: Callable[[Tables, Scope], DataFrame]):
        REPORTS[name] = Report(inputs, build)
        return build

    return register


def _scan(name: str, source: str) -> None:
    REPORTS[name] = Report((source,), lambda t, s: t[source])


for _section, _source in {
    "instance": "instance", "database": "database", "pdb-info": "containers", "datafiles": "datafile",
    "controlfile": "controlfile", "fra-info": "recovery_file_dest",
}.items():
    _scan(_section, _source)


@report("current-sessions", "sessions")
def _sessions(t, s):
    return sessions.user_sessions(t["sessions"], s.session_status)


@report("sessions-by-release", "sessions", "instance")
def _release_sessions(t, s):
    return views.sessions_by_release(sessions.user_sessions(t["sessions"], s.session_status), t["instance"], s.bundle)


@report("patch-info", "registry_history")
def _patches(t, s):
    return config.patch_history(t["registry_history"], keys=s.bundle)


@report("patch-info-latest", "registry_history")
def _latest_patch(t, s):
    return config.patch_history(t["registry_history"], latest_only=True, keys=s.bundle)


@report("memory-info", "sga", "sga_components", "sga_free", "parameter", "cache_advice", "shared_pool_advice",
        "java_pool_advice", "pga_advice")
def _memory(t, s):
    return memory.memory_components(
        memory.MemoryInputs(t["sga"], t["sga_components"], t["sga_free"], t["parameter"], t["cache_advice"],
                            t["shared_pool_advice"], t["java_pool_advice"], t["pga_advice"]), s.bundle)


@report("alert-dest", "instance", "diag_info")
def _alert(t, s):
    return config.log_paths(t["instance"], t["diag_info"], s.bundle)


@report("arl-dest-info", "archive_dest", "instance", "database")
def _archive(t, s):
    return config.archive_destinations(t["archive_dest"], t["instance"], t["database"], s.bundle)


@report("backup-info", "rman_status")
def _backups(t, s):
    return config.backup_history(t["rman_status"], s.as_of, keys=s.bundle)


@report("parameter-num", "parameter", "instance")
def _numeric(t, s):
    return config.changed_parameters(t["parameter"], t["instance"], True, s.bundle, s.numeric_parameter_types)


@report("parameter-nonnum", "parameter", "instance")
def _other(t, s):
    return config.changed_parameters(t["parameter"], t["instance"], False, s.bundle, s.numeric_parameter_types)


@report("expiring-user", "users")
def _expiring(t, s):
    return config.expiring_users(t["users"], s.as_of, keys=s.keys)


@report("user-privs", "users", "role_privs")
def _privileges(t, s):
    return config.user_roles(t["users"], t["role_privs"], s.keys)


@report("cursor-efficiency", "statname", "sesstat", "parameter")
def _cursors(t, s):
    return config.cursor_efficiency(t["statname"], t["sesstat"], t["parameter"], s.bundle)


@report("redo-log", "log", "logfile")
def _redo(t, s):
    return storage.redo_logs(t["log"], t["logfile"], s.bundle)


@report("tablespace-usage", "tablespaces", "data_files", "free_space")
def _permanent(t, s):
    return storage.tablespace_usage(t["tablespaces"], t["data_files"], t["free_space"], "PERMANENT", s.keys)


@report("undo-tablespace-usage", "tablespaces", "data_files", "free_space")
def _undo(t, s):
    return storage.tablespace_usage(t["tablespaces"], t["data_files"], t["free_space"], "UNDO", s.keys)


@report("temp-tablespace-usage", "temp_files", "tablespaces", "sort_usage")
def _temp(t, s):
    return storage.temp_usage(t["temp_files"], t["tablespaces"], t["sort_usage"], s.keys)


@report("datafile-overview", "datafile")
def _overview(t, s):
    return storage.file_overview(t["datafile"], s.keys, within=s.bundle)


@report("fra-summary", "recovery_file_dest")
def _recovery(t, s):
    return storage.recovery_area_mb(t["recovery_file_dest"])


@report("database-settings", "database")
def _settings(t, s):
    return config.database_settings(t["database"], keys=s.bundle)


@report("sqlarea-summary", "statement_area", "instance")
def _area(t, s):
    named = t["instance"].select(*s.bundle, F.col("instance_number").alias("inst_id"), "instance_name")
    return topk.statement_area_summary(t["statement_area"], named, s.keys, s.bundle)


def _statement_report(measure: topk.Measure) -> Report:
    return Report(("statements",), lambda t, s: topk.topk_statements(t["statements"], measure, s.keys))


for _name, _measure in topk.STATEMENT_MEASURES.items():
    REPORTS[_name] = _statement_report(_measure)


@report("topsql-all", "statements")
def _all_measures(t, s):
    return topk.topk_statements_all(t["statements"], keys=s.keys)


@report("pin-plsql", "object_cache")
def _pin_code(t, s):
    return topk.code_to_pin(t["object_cache"], s.keys, within=s.bundle)


@report("pin-sql", "statements")
def _pin_statements(t, s):
    return topk.statements_to_pin(t["statements"], s.keys, within=s.bundle)


@report("dbfile-iostat", "datafile", "filestat")
def _file_io(t, s):
    return storage.file_io(t["datafile"], t["filestat"], s.keys, [*s.bundle, "file#"])


@report("tempfile-iostat", "tempfile", "tempstat")
def _temp_io(t, s):
    return storage.file_io(t["tempfile"], t["tempstat"], s.keys, [*s.bundle, "file#"])


@report("sessions-by-user-machine", "sessions")
def _by_machine(t, s):
    return sessions.top_groups(sessions.user_sessions(t["sessions"], s.session_status), ["username", "machine"], within=s.bundle)


@report("sessions-by-event", "sessions")
def _by_event(t, s):
    return sessions.top_groups(sessions.user_sessions(t["sessions"], s.session_status), ["event"], within=s.bundle)


@report("sessions-by-sql", "sessions")
def _by_sql(t, s):
    return sessions.top_groups(sessions.user_sessions(t["sessions"], s.session_status), ["sql_id"], within=s.bundle)


@report("session-blocking", "sessions")
def _blocking(t, s):
    return sessions.blocking_forest(sessions.user_sessions(t["sessions"], s.session_status), s.bundle, s.paths)


@report("session-blocked-counts", "sessions")
def _blocked(t, s):
    return sessions.blocked_by_root(sessions.user_sessions(t["sessions"], s.session_status), s.bundle)


@report("uncommit-tx", "transactions", "rollname", "sessions", "parameter")
def _open_tx(t, s):
    return sessions.open_transactions(t["transactions"], t["rollname"], t["sessions"], t["parameter"], s.keys, s.bundle)


@report("undo-stat", "undostat")
def _undo_stat(t, s):
    return config.undo_statistics(t["undostat"], s.as_of, keys=s.bundle)


@report("database-perf-load", "live_samples", "persisted_samples", "database")
def _load(t, s):
    kept = config.current_database(t["persisted_samples"], t["database"], s.bundle)
    return samples.perf_load([t["live_samples"], kept], s.begin, s.end, s.keys)


@report("ash-time-model", "persisted_samples")
def _states(t, s):
    hours = samples.active_by_state(t["persisted_samples"], s.begin, s.end, keys=s.keys)
    return hours.orderBy("tm").withColumn("tm", F.date_format("tm", "MM-dd HH:mm"))


def _counter(name: str, source: str) -> Report:
    return Report((source, "snapshot"), lambda t, s: counters.counter_report(
        name, lower_names(t[source]), t["snapshot"], s.begin, s.end, s.keys, s.snap_keys))


# Counter section -> history table.
COUNTER_SOURCES = {
    "awr-latches": "hist_latch",
    "awr-bg-event-wait": "hist_bg_event_summary",
    "awr-sga-stat": "hist_sgastat",
    "awr-sys-time-model": "hist_sys_time_model",
    "awr-rac-misc": "hist_dlm_misc",
    "awr-enqueue-hist": "hist_enqueue_stat",
    "awr-file-statx": "hist_filestatxs",
    "os-stat-hist": "hist_osstat",
    "sql-stat-hist": "hist_sqlstat",
    "sys-stat-hist": "hist_sysstat",
    "sys-event-hist": "hist_system_event",
    "awr-time-model-rounded": "hist_sys_time_model",
}
for _name, _table in COUNTER_SOURCES.items():
    REPORTS[_name] = _counter(_name, _table)


@report("idle-events", "event_name")
def _event_classes(t, s):
    return config.event_classes(t["event_name"], [*s.bundle, "name", "wait_class"])


@report("db-auto-tasks", "autotask_task", "autotask_client", "window_groups")
def _tasks(t, s):
    return config.maintenance_tasks(t["autotask_task"], t["autotask_client"], t["window_groups"], s.keys)


@report("sched-jobs", "scheduler_jobs")
def _jobs(t, s):
    return config.scheduler_jobs(t["scheduler_jobs"], s.job_state)


@report("redundent-indexes", "index_columns", "indexes", "objects", "owners")
def _redundant(t, s):
    return indexes.redundant_indexes(t["index_columns"], t["indexes"], t["objects"], t["owners"], s.bundle)


def _block_size(t: Tables, s: Scope) -> DataFrame:
    rows = t["parameter"].filter(F.col("name") == "db_block_size")
    return rows.groupBy(*s.bundle).agg(F.max(F.col("value").cast("int")).alias("value"))


@report("low-density-indexes", "indexes", "index_columns", "column_stats", "objects", "owners", "parameter")
def _sparse_indexes(t, s):
    return indexes.low_density_indexes(t["indexes"], t["index_columns"], t["column_stats"], t["objects"], t["owners"],
                                       _block_size(t, s), s.bundle)


@report("row-migration", "tables", "columns", "objects", "owners", "parameter")
def _migration(t, s):
    return indexes.migrated_rows(t["tables"], t["columns"], t["objects"], t["owners"], _block_size(t, s), s.bundle)


@report("table-density", "tables", "objects", "owners", "parameter")
def _table_density(t, s):
    rows = t["parameter"].filter(F.col("name") == "db_file_multiblock_read_count")
    reads = rows.groupBy(*s.bundle).agg(F.max(F.col("value").cast("int")).alias("value"))
    return indexes.table_density(t["tables"], t["objects"], t["owners"], _block_size(t, s), reads, s.bundle)


def run_chart(name: str, tables: Tables, scope: Scope, k: int = 15) -> tuple[DataFrame, DataFrame]:
    """Points and legend of a counter section's chart, from its history: ``k`` series per tenant by variance, listed
    statistics besides, idle events left out where ``event_name`` is at hand. Ranking runs at once."""
    history = lower_names(tables[COUNTER_SOURCES[name]])
    classes = run_report("idle-events", tables, scope) if "event_name" in tables else None
    return counters.counter_chart(name, history, tables["snapshot"], scope.begin, scope.end, scope.keys, scope.snap_keys,
                                  event_classes=classes, k=k)


def run_report(name: str, tables: Tables, scope: Scope) -> DataFrame:
    """Build one report; a missing source table is named in the error."""
    spec = REPORTS[name]
    missing = [i for i in spec.inputs if i not in tables]
    if missing:
        raise KeyError(f"report {name} needs {', '.join(missing)}")
    return spec.build(tables, scope)


#: Sections of one schema that one plan answers: group -> (its sections, source table, tall result with a section column).
STATEMENT_GROUP = "topsql"


def _statement_sections(t: Tables, s: Scope, names: Sequence[str]) -> DataFrame:
    measures = [topk.STATEMENT_MEASURES[n] for n in names]
    tall = topk.topk_statements_all(t["statements"], measures, s.keys)
    # The order of the stored section's columns, which CSV is read by.
    return tall.select(*s.bundle, F.col("measure").alias(sinks.SECTION), *[f.name for f in schema_of(names[0]).fields if f.name in tall.columns])


def write_reports(tables: Tables, scope: Scope, folder: str, names: Iterable[str] | None = None, fmt: str = "parquet") -> dict[str, str | None]:
    """Run the reports (all whose tables are present, or the named ones) and store them: section -> the group that holds it, None
    for a folder of its own.

    Statement sections share a schema and a source: they come from one scan of ``statements`` and one aggregation, in one
    write partitioned by section. Every other section is one job.
    """
    chosen = list(names) if names is not None else [n for n, r in REPORTS.items() if all(i in tables for i in r.inputs)]
    shared = [n for n in chosen if n in topk.STATEMENT_MEASURES]
    if len(shared) > 1:
        sinks.write_tall(_statement_sections(tables, scope, shared), folder, STATEMENT_GROUP, fmt)
    else:
        shared = []
    for name in chosen:
        if name not in shared:
            sinks.write_section(run_report(name, tables, scope), folder, name, fmt)
    return {n: STATEMENT_GROUP if n in shared else None for n in chosen}


def collect_sections(tables: Tables, scope: Scope, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """All reports whose source tables are present (or the named ones), as lazy DataFrames."""
    if names is not None:
        return {n: run_report(n, tables, scope) for n in names}
    return {n: r.build(tables, scope) for n, r in REPORTS.items() if all(i in tables for i in r.inputs)}
