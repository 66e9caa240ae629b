"""Session reports: list, distributions, blocking forest, open transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.functions.nulls import concat_nn
from fleetscope.operators.dims import filter_equal, sorted_by, with_value
from fleetscope.operators.forest import forest, with_children_only
from fleetscope.operators.subtree import subtree_sums
from fleetscope.operators.topk import top_overall, top_per_group

INT_COLUMNS = ["inst_id", "sid", "blocking_instance", "blocking_session", "serial#"]
BLOCKER_COLUMNS = ["blocking_instance", "blocking_session"]


def user_sessions(sessions: DataFrame, status: str | None = None, user: str = "username",
                  ints: Sequence[str] = tuple(INT_COLUMNS), blockers: Sequence[str] = tuple(BLOCKER_COLUMNS)) -> DataFrame:
    """Sessions of users, by status if given; ids as integers, no blocker as 0."""
    rows = filter_equal(sessions.filter(F.col(user).isNotNull()), "status", status.upper() if status else None)
    present = [c for c in ints if c in rows.columns]
    casts = {c: F.col(c).cast("int") for c in present}
    for c in set(blockers) & set(present):
        casts[c] = F.coalesce(casts[c], F.lit(0))
    return rows.withColumns(casts)


def top_groups(df: DataFrame, keys: Sequence[str], k: int = 10, within: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most frequent key combinations; a combination with a NULL does not count.

    ``within`` ranks inside each of its groups (one chart per bundle) instead of overall.
    """
    counted = df.dropna(subset=list(keys)).groupBy(*within, *keys).agg(F.count(F.lit(1)).alias("cnt"))
    if within:
        return top_per_group(counted, within, "cnt", k, keys, rank="place")
    return top_overall(counted, "cnt", k, keys)


def session_info(name: str = "name") -> Column:
    """Text shown for a session in the blocking forest (fixed wording)."""
    return concat_nn(
        F.col(name), F.lit(",实例:"), F.col("inst_id"), F.lit(",sid/serial#:"), F.col("sid"), F.lit(","),
        F.col("serial#"), F.lit(",\n用户名:"), F.col("username"), F.lit("状态:"), F.col("status"),
        F.lit("\n等待:"), F.col("event"), F.lit("SQL:"), F.col("sql_id"),
    )


def blocking_nodes(sessions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Session nodes: ``uid`` = instance_sid, ``pid`` = the blocker's uid or NULL."""
    blocker = F.concat_ws("_", "blocking_instance", "blocking_session")
    return sessions.select(
        *keys,
        F.concat_ws("_", "inst_id", "sid").alias("uid"),
        F.when(F.coalesce("blocking_session", F.lit(0)) != 0, blocker).alias("pid"),
        "sid",
        (session_info() if "name" in sessions.columns else session_info_without_name()).alias("info"),
    )


def session_info_without_name() -> Column:
    return concat_nn(F.col("inst_id"), F.lit(","), F.col("sid"), F.lit(","), F.col("serial#"))


def blocking_forest(sessions: DataFrame, keys: Sequence[str] = (), with_path: bool = True) -> DataFrame:
    """Who blocks whom: trees of sessions whose root blocks at least one other session. Without paths, chains may be of any length."""
    nodes = blocking_nodes(sessions, keys)
    tree = with_children_only(forest(nodes, "uid", "pid", keys, with_path), keys)
    info = nodes.select(*keys, F.col("uid").alias("id"), F.col("info").alias("name"), F.col("sid").alias("value"))
    return tree.join(info, [*keys, "id"])


def blocked_by_root(sessions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sessions that hold up others without waiting themselves: (id, name, value, blocked, chain): how many wait behind them, and how long the
    longest chain is. No paths are made, so a chain of any length is served."""
    nodes = blocking_nodes(sessions, keys).withColumn("_one", F.lit(1).cast("bigint"))
    tree = subtree_sums(nodes, "uid", "pid", "_one", keys)
    chains = tree.groupBy(*keys, F.col("root").alias("id")).agg(F.max("depth").alias("chain"))
    roots = tree.filter((F.col("depth") == 0) & (F.col("subtree_size") > 1)).select(*keys, "id", (F.col("subtree_size") - 1).alias("blocked"))
    info = nodes.filter("pid is null").select(*keys, F.col("uid").alias("id"), F.col("info").alias("name"), F.col("sid").alias("value"))
    return roots.join(chains, [*keys, "id"]).join(info, [*keys, "id"])


def open_transactions(transactions: DataFrame, undo_segments: DataFrame, sessions: DataFrame, parameter: DataFrame,
                      keys: Sequence[str] = ("con_id",), link: Sequence[str] = (), kb: float = 1024,
                      ordered: bool = True) -> DataFrame:
    """Uncommitted transactions with session, undo segment and undo KB."""
    # Instances of one database share the block size.
    block = parameter.filter(F.col("name") == "db_block_size").groupBy(*link).agg(
        F.max(F.col("value").cast("bigint")).alias("value")
    )
    tx = transactions.select(*link, "ses_addr", "xidusn", "start_time", "ubafil", "ubablk", "status", "used_ublk",
                             "used_urec")
    undo = undo_segments.select(*link, F.col("usn").alias("xidusn"), F.col("name").alias("undo_name"))
    owner = sessions.select(*dict.fromkeys([*link, *keys]), "inst_id", "sid", "username",
                            F.col("saddr").alias("ses_addr"), F.col("status").alias("sess_status"))
    joined = tx.join(undo, [*link, "xidusn"]).join(owner, [*link, "ses_addr"])
    sized = with_value(joined, block, "value", "_block", link)
    shown = sized.select(
        *keys, "inst_id", "sid", "start_time", "username", "undo_name", "ubafil", "ubablk", "status", "sess_status",
        (F.col("used_ublk") * F.col("_block") / kb).alias("blk"), "used_urec",
    )
    return sorted_by(shown, *keys, "inst_id", "sid", ordered=ordered)
