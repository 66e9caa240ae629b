"""Adjacency list to forest by pointer doubling.

Each node points to an ancestor; every round replaces the pointer by the pointer's pointer, so a
chain of depth d takes about log2(d) rounds. Nodes that reached their root leave the working set,
so hot roots do not become hot join keys. A round in which no node finishes proves that only
cycles (and what hangs below them) are left, because a node of depth d has ancestors of every
smaller depth. Each round ends as Parquet in the shared checkpoint folder, so a lost executor does not
replay earlier rounds and the planner's estimates don't multiply from round to round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NullType

from fleetscope.session import saved, shared_folder


def forest(nodes: DataFrame, id_column: str, parent_column: str, keys: Sequence[str] = (),
           with_path: bool = True, folder: str | None = None) -> DataFrame:
    """Rows (keys, id, parent, root, depth[, path]) of every node reachable from a root.

    A root has a NULL parent. Orphans, cycles and their descendants have no row. Ids must be unique
    within ``keys``, else ValueError; NULL ids are nobody's parent and may repeat. The nodes are read
    once, when the forest is built. ``path`` lists ids from the root to the node; in deep trees leave
    it out, because a chain of d nodes holds d * d / 2 ids. The result reads what the rounds wrote below ``folder``; who names one may remove it later.
    """
    group, folder = list(keys), folder or shared_folder(nodes.sparkSession, "forest")
    untyped = isinstance(nodes.schema[parent_column].dataType, NullType)  # Parquet has no such column
    parent = F.col(parent_column).cast(nodes.schema[id_column].dataType) if untyped else F.col(parent_column)
    base = saved(nodes.select(*group, F.col(id_column).alias("id"), parent.alias("parent")), "forest", f"{folder}/nodes")
    repeated = base.filter(F.col("id").isNotNull()).groupBy(*group, "id").agg(F.count(F.lit(1)).alias("rows"))
    if not repeated.filter("rows > 1").isEmpty():
        raise ValueError(f"{id_column} repeats within {group}: a forest needs unique ids")
    path = [F.array("id").alias("path")] if with_path else []
    roots = base.filter(F.col("parent").isNull()).select(
        *group, "id", "parent", F.col("id").alias("root"), F.lit(0).alias("depth"), *path
    )
    # ``up`` is the ancestor reached so far, ``depth`` the steps to it, ``path`` the ids below it.
    open_nodes = base.filter(F.col("parent").isNotNull()).select(
        *group, "id", "parent", F.col("parent").alias("up"), F.lit(1).alias("depth"), *path
    )
    finished = [roots]
    lookup = roots.select(*group, F.col("id").alias("up"), F.lit(True).alias("_done"), F.col("root").alias("_up"),
                          F.col("depth").alias("_depth"), *([F.col("path").alias("_path")] if with_path else []))
    pending = open_nodes
    while True:
        own = pending.select(*group, F.col("id").alias("up"), F.lit(False).alias("_done"), F.col("up").alias("_up"),
                             F.col("depth").alias("_depth"),
                             *([F.col("path").alias("_path")] if with_path else []))
        # Small files unpack to far more memory, so neither side is sent to the driver whatever its size on disk.
        joined = pending.hint("merge").join(lookup.unionByName(own), [*group, "up"])
        longer = [F.concat("_path", "path").alias("path")] if with_path else []
        step = saved(
            joined.select(*group, "id", "parent", "_done", F.col("_up").alias("up"),
                          (F.col("depth") + F.col("_depth")).alias("depth"), *longer),
            "forest", f"{folder}/round-{len(finished)}")
        done = step.filter("_done").withColumnRenamed("up", "root").drop("_done")
        pending = step.filter(~F.col("_done")).drop("_done")
        finished.append(done.select(roots.columns))
        if done.isEmpty() or pending.isEmpty():
            break
        lookup = lookup.unionByName(
            done.select(*group, F.col("id").alias("up"), F.lit(True).alias("_done"), F.col("root").alias("_up"),
                        F.col("depth").alias("_depth"), *([F.col("path").alias("_path")] if with_path else []))
        )
    return reduce(DataFrame.unionByName, finished)


def with_children_only(tree: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Drop roots without a child. Below a root every node stays, so only roots are looked up."""
    parents = tree.filter(F.col("parent").isNotNull()).select(*keys, F.col("parent").alias("id")).distinct()
    roots = tree.filter(F.col("depth") == 0).join(parents, [*keys, "id"], "left_semi")
    return tree.filter(F.col("depth") > 0).unionByName(roots.select(tree.columns))
