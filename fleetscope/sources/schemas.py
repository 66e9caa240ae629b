"""Column lists of source tables and of result sections, as Spark DDL."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the source tables that the reports read.
SOURCES = {
    "containers": "con_id INT, name STRING, open_mode STRING",
    "database": "dbid BIGINT, name STRING, log_mode STRING, controlfile_type STRING, open_mode STRING,"
    " protection_mode STRING, protection_level STRING, database_role STRING, switchover_status STRING,"
    " supplemental_log_data_min STRING, supplemental_log_data_pk STRING, supplemental_log_data_ui STRING,"
    " force_logging STRING, platform_name STRING, flashback_on STRING, supplemental_log_data_fk STRING,"
    " supplemental_log_data_all STRING, db_unique_name STRING, cdb STRING",
    "instance": "inst_id INT, instance_number INT, instance_name STRING, host_name STRING, version STRING,"
    " startup_time TIMESTAMP_NTZ, status STRING, parallel STRING",
    "snapshot": "dbid BIGINT, snap_id BIGINT, instance_number INT, begin_interval_time TIMESTAMP_NTZ,"
    " end_interval_time TIMESTAMP_NTZ",
    "event_name": "name STRING, wait_class STRING",
    "counter_history": "con_id INT, dbid BIGINT, snap_id BIGINT, instance_number INT, stat_name STRING,"
    " value DECIMAL(38,6)",
    "active_samples": "con_id INT, dbid BIGINT, sample_id BIGINT, sample_time TIMESTAMP_NTZ, session_state STRING,"
    " wait_class STRING, session_type STRING",
    "statements": "con_id INT, inst_id INT, sql_id STRING, sql_text STRING, executions BIGINT, sorts BIGINT,"
    " sharable_mem BIGINT, px_servers_executions BIGINT, invalidations BIGINT, loads BIGINT, parse_calls BIGINT,"
    " disk_reads BIGINT, buffer_gets BIGINT, application_wait_time BIGINT, concurrency_wait_time BIGINT,"
    " cluster_wait_time BIGINT, user_io_wait_time BIGINT, rows_processed BIGINT, cpu_time BIGINT, elapsed_time BIGINT",
    "statement_area": "inst_id INT, con_id INT, sharable_mem BIGINT, executions BIGINT, version_count BIGINT,"
    " cpu_time BIGINT, elapsed_time BIGINT",
    "sessions": "con_id INT, inst_id INT, sid INT, `serial#` INT, saddr STRING, username STRING, status STRING,"
    " server STRING, schemaname STRING, osuser STRING, process STRING, machine STRING, port INT, program STRING,"
    " sql_id STRING, sql_child_number INT, sql_exec_start TIMESTAMP_NTZ, prev_sql_id STRING, prev_child_number INT,"
    " prev_exec_start TIMESTAMP_NTZ, `row_wait_obj#` BIGINT, `row_wait_file#` BIGINT, logon_time TIMESTAMP_NTZ,"
    " blocking_session_status STRING, blocking_instance INT, blocking_session INT,"
    " final_blocking_session_status STRING, final_blocking_instance INT, final_blocking_session INT, event STRING,"
    " p1text STRING, p1 BIGINT, p2text STRING, p2 BIGINT, wait_class STRING",
    "transactions": "ses_addr STRING, xidusn BIGINT, start_time STRING, status STRING, ubafil BIGINT, ubablk BIGINT,"
    " used_ublk BIGINT, used_urec BIGINT",
    "rollname": "usn BIGINT, name STRING",
    "undostat": "inst_id INT, begin_time TIMESTAMP_NTZ, unxpstealcnt BIGINT, expstealcnt BIGINT, ssolderrcnt BIGINT,"
    " nospaceerrcnt BIGINT, maxquerylen BIGINT, tuned_undoretention BIGINT",
    "object_cache": "con_id INT, owner STRING, name STRING, type STRING, sharable_mem BIGINT, executions BIGINT,"
    " kept STRING",
    "tablespaces": "con_id INT, tablespace_name STRING, contents STRING, block_size INT",
    "data_files": "con_id INT, tablespace_name STRING, file_id INT, relative_fno INT, bytes BIGINT, maxbytes BIGINT,"
    " autoextensible STRING",
    "free_space": "con_id INT, tablespace_name STRING, file_id INT, relative_fno INT, bytes BIGINT",
    "temp_files": "con_id INT, tablespace_name STRING, bytes BIGINT, maxbytes BIGINT, autoextensible STRING",
    "sort_usage": "con_id INT, tablespace STRING, blocks BIGINT",
    "datafile": "con_id INT, `file#` INT, name STRING, bytes BIGINT, status STRING, enabled STRING, `ts#` INT",
    "tempfile": "con_id INT, `file#` INT, name STRING, bytes BIGINT, status STRING, enabled STRING, `ts#` INT",
    "filestat": "`file#` INT, phyrds BIGINT, phywrts BIGINT, singleblkrds BIGINT, readtim BIGINT, writetim BIGINT,"
    " singleblkrdtim BIGINT, avgiotim BIGINT, lstiotim BIGINT, miniotim BIGINT, maxiortm BIGINT, maxiowtm BIGINT",
    "tempstat": "`file#` INT, phyrds BIGINT, phywrts BIGINT, singleblkrds BIGINT, readtim BIGINT, writetim BIGINT,"
    " singleblkrdtim BIGINT, avgiotim BIGINT, lstiotim BIGINT, miniotim BIGINT, maxiortm BIGINT, maxiowtm BIGINT",
    "log": "`group#` INT, `thread#` INT, bytes BIGINT, archived STRING, status STRING",
    "logfile": "`group#` INT, member STRING",
    "controlfile": "status STRING, name STRING",
    "recovery_file_dest": "name STRING, space_limit BIGINT, space_used BIGINT",
    "parameter": "inst_id INT, name STRING, value STRING, type INT, isdefault STRING",
    "statname": "inst_id INT, `statistic#` INT, name STRING",
    "sesstat": "inst_id INT, sid INT, `statistic#` INT, value BIGINT",
    "archive_dest": "inst_id INT, dest_name STRING, status STRING, log_sequence BIGINT, error STRING",
    "diag_info": "inst_id INT, name STRING, value STRING",
    "registry_history": "action_time TIMESTAMP_NTZ, action STRING, namespace STRING, version STRING, id STRING,"
    " comments STRING",
    "rman_status": "operation STRING, object_type STRING, status STRING, start_time TIMESTAMP_NTZ,"
    " end_time TIMESTAMP_NTZ",
    "users": "con_id INT, username STRING, account_status STRING, expiry_date TIMESTAMP_NTZ,"
    " default_tablespace STRING, temporary_tablespace STRING",
    "role_privs": "con_id INT, grantee STRING, granted_role STRING, default_role STRING",
    "autotask_task": "con_id INT, client_name STRING, task_name STRING, operation_name STRING, status STRING",
    "autotask_client": "con_id INT, client_name STRING, window_group STRING",
    "window_groups": "con_id INT, window_group_name STRING, enabled STRING, next_start_date TIMESTAMP_NTZ",
    "scheduler_jobs": "con_id INT, owner STRING, job_name STRING, program_owner STRING, program_name STRING,"
    " job_type STRING, start_date TIMESTAMP_NTZ, repeat_interval STRING, enabled STRING, state STRING,"
    " run_count BIGINT, failure_count BIGINT, last_start_date TIMESTAMP_NTZ,"
    " last_run_duration INTERVAL DAY TO SECOND, next_run_date TIMESTAMP_NTZ",
    "index_columns": "`obj#` BIGINT, `bo#` BIGINT, `pos#` INT, `intcol#` INT",
    "indexes": "`obj#` BIGINT, `bo#` BIGINT, property INT, `type#` INT, rowcnt BIGINT, leafcnt BIGINT, initrans INT,"
    " `pctfree$` INT",
    "column_stats": "`obj#` BIGINT, `intcol#` INT, avgcln DOUBLE",
    "tables": "`obj#` BIGINT, `tab#` INT, rowcnt BIGINT, blkcnt BIGINT, chncnt BIGINT, avgrln DOUBLE, avgspc DOUBLE,"
    " initrans INT, `pctfree$` INT, degree INT",
    "columns": "`obj#` BIGINT, length INT",
    "objects": "`obj#` BIGINT, `owner#` INT, name STRING",
    "owners": "`user#` INT, name STRING",
    "sga": "name STRING, value BIGINT",
    "sga_components": "component STRING, current_size BIGINT, granule_size BIGINT",
    "sga_free": "current_size BIGINT",
    "cache_advice": "name STRING, block_size INT, size_factor DOUBLE, estd_physical_read_factor DOUBLE",
    "shared_pool_advice": "shared_pool_size_factor DOUBLE, estd_lc_load_time_factor DOUBLE",
    "java_pool_advice": "java_pool_size_factor DOUBLE, estd_lc_load_time_factor DOUBLE",
    "pga_advice": "pga_target_factor DOUBLE, estd_pga_cache_hit_percentage DOUBLE",
}

_TOP = "con_id INT, sql_id STRING, value DECIMAL(38,14), sql_text STRING, count_sql INT"
_COUNTER = (
    "con_id INT, dbid BIGINT, snap_id BIGINT, instance_number INT, stat_name STRING,"
    " begin_interval_time TIMESTAMP_NTZ, end_interval_time TIMESTAMP_NTZ, wait_time DECIMAL(38,6),"
    " wait_time_delta DECIMAL(38,6), waits_var DOUBLE"
)
_LATCH = _COUNTER.replace("stat_name STRING", "stat_name STRING, `level#` INT, latch_hash BIGINT")
_USAGE = "con_id INT, tablespace_name STRING, file_size BIGINT, file_max_size BIGINT, file_free_space BIGINT"
_IO = "con_id INT, file_name STRING, " + SOURCES["filestat"].split(", ", 1)[1]

# Result sections by name. A section is one CSV member of a bundle.
SECTIONS = {
    "instance": SOURCES["instance"],
    "database": SOURCES["database"],
    "pdb-info": SOURCES["containers"],
    "datafiles": SOURCES["datafile"],
    "controlfile": SOURCES["controlfile"],
    "fra-info": SOURCES["recovery_file_dest"],
    "current-sessions": SOURCES["sessions"],
    "patch-info": "action_time TIMESTAMP_NTZ, patch_info STRING",
    "memory-info": "memory_component STRING, memory_size DOUBLE, parent_memory_component STRING, parent_group STRING,"
    " second_group STRING, hasadvisory STRING, isfixedsize STRING, mc_type STRING, factor_name STRING,"
    " parameter STRING, default_order INT, collection_status STRING, minimum_size DOUBLE, maximum_size INT,"
    " sgamode STRING",
    "alert-dest": "instance_name STRING, path STRING",
    "arl-dest-info": "instance_name STRING, dest_name STRING, metric STRING, value STRING",
    "backup-info": SOURCES["rman_status"],
    "parameter-num": "instance_name STRING, name STRING, value STRING",
    "parameter-nonnum": "instance_name STRING, name STRING, value STRING",
    "expiring-user": "con_id INT, username STRING, expiring_secs DECIMAL(24,6)",
    "user-privs": "con_id INT, username STRING, default_tablespace STRING, temporary_tablespace STRING,"
    " granted_role STRING, default_role STRING",
    "cursor-efficiency": "inst_id INT, parameter STRING, value STRING, usage STRING",
    "redo-log": "group_id INT, thread_id INT, bytes BIGINT, archived STRING, status STRING, member STRING",
    "tablespace-usage": _USAGE,
    "undo-tablespace-usage": _USAGE,
    "temp-tablespace-usage": "con_id INT, tablespace_name STRING, param STRING, value BIGINT",
    "redundent-indexes": "redundant_index STRING, sufficient_index STRING",
    "sqlarea-summary": "instance_name STRING, con_id INT, total_sql BIGINT, totalsqlmem BIGINT, singleusesql BIGINT,"
    " singleusesqlmem BIGINT, totalcurs BIGINT, cputime BIGINT, elapsetime BIGINT",
    **{name: _TOP for name in (
        "topsql-exec", "topsql-sort", "topsql-shmemory", "topsql-pxexec", "topsql-invalids", "topsql-parse",
        "topsql-phr-reads", "topsql-buffer-get", "topsql-app-wait", "topsql-concurrent-wait", "topsql-cluster-wait",
        "topsql-user-iowait", "topsql-rows", "topsql-cpu", "topsql-elapse", "topsql-sort-exec", "topsql-parse-exec",
        "topsql-gets-exec", "topsql-phread-exec", "topsql-appwait-exec", "topsql-concurrwait-exec",
        "topsql-clustwait-exec", "topsql-userio-exec", "topsql-rows-exec", "topsql-cpu-exec", "topsql-elapsed-exec",
    )},
    "dbfile-iostat": _IO,
    "tempfile-iostat": _IO,
    "uncommit-tx": "con_id INT, inst_id INT, sid INT, start_time STRING, username STRING, undo_name STRING,"
    " ubafil BIGINT, ubablk BIGINT, status STRING, sess_status STRING, blk DOUBLE, used_urec BIGINT",
    "database-perf-load": "con_id INT, ten_min_timestr STRING, sess_count BIGINT",
    "ash-time-model": "con_id INT, tm STRING, state STRING, sess_cnt DOUBLE",
    "awr-latches": _LATCH,
    **{name: _COUNTER for name in (
        "awr-bg-event-wait", "awr-sga-stat", "awr-sys-time-model", "awr-rac-misc", "awr-enqueue-hist", "awr-file-statx",
        "os-stat-hist", "sql-stat-hist", "sys-stat-hist", "sys-event-hist",
    )},
    "idle-events": SOURCES["event_name"],
    "db-auto-tasks": "client_name STRING, task_name STRING, operation_name STRING, status STRING, con_id INT,"
    " window_group_name STRING, enabled STRING, next_start_date TIMESTAMP_NTZ",
    "sched-jobs": SOURCES["scheduler_jobs"].replace("INTERVAL DAY TO SECOND", "BIGINT"),
}


def schema_of(name: str) -> T.StructType:
    """Schema of a result section or source table."""
    ddl = SECTIONS.get(name) or SOURCES[name]
    return T.StructType.fromDDL(ddl)
