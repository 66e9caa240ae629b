"""Intervals and sums of subtrees, without paths: pointer doubling towards the root, for the sums first and then for the intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType, LongType

from fleetscope.operators.forest import forest
from fleetscope.session import removed, saved, shared_folder

#: Slices into which the children of one node are cut, so that a node with very many of them is no single group.
CHILD_SLICES = 256


def _sum_type(kind: DataType) -> DataType:
    """Type of the running sums. Decimals keep their scale; the sum of two has one digit more, which still fits."""
    return DecimalType(37, kind.scale) if isinstance(kind, DecimalType) else LongType() if isinstance(kind, IntegralType) else kind


def _sums(tree: DataFrame, keys: Sequence[str], deepest: int, folder: str) -> DataFrame:
    """(keys, id, nodes, total): what a node and all below it count. In a round of reach r each row of depth r or more holds the sums of what is less
    than r steps below it and hands them to its ancestor r steps above. Sums of one receiver combine before they shuffle, so a
    node with very many children is no hot key."""
    kind = tree.schema["total"].dataType
    summed = (F.sum("nodes").alias("nodes"), F.sum("total").cast(kind).alias("total"))
    parts, reach = [tree.select(*keys, "id", "nodes", "total")], 1
    rest = tree.filter("depth >= 1").select(*keys, "id", F.col("parent").alias("up"), "depth", "nodes", "total")
    while reach <= deepest:
        handed = saved(rest.groupBy(*keys, "up").agg(*summed).withColumnRenamed("up", "id"), "subtree", f"{folder}/handed-{reach}")
        parts.append(handed)
        beyond = rest.select(*keys, F.col("id").alias("up"), F.col("up").alias("_up"))
        got = handed.select(*keys, "id", F.col("nodes").alias("_nodes"), F.col("total").alias("_total"))
        rest = rest.filter(F.col("depth") >= 2 * reach).hint("merge").join(beyond, [*keys, "up"]).hint("merge").join(got, [*keys, "id"], "left").select(
            *keys, "id", F.col("_up").alias("up"), "depth", (F.col("nodes") + F.coalesce("_nodes", F.lit(0))).alias("nodes"),
            (F.col("total") + F.coalesce("_total", F.lit(0).cast(kind))).cast(kind).alias("total"))
        reach *= 2
        if reach <= deepest:
            rest = saved(rest, "subtree", f"{folder}/sums-{reach}")
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, "id").agg(*summed)


def _steps_from_parent(sized: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows below a root with ``entry``: the steps from the parent's entry to their own, past the children before them and all below those."""
    family = [*keys, "parent"]
    rows = sized.filter("depth >= 1").select(*family, "id", "depth", "nodes", F.pmod(F.xxhash64("id"), F.lit(CHILD_SLICES)).alias("_slice"))
    earlier = W.partitionBy(*family).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    within = W.partitionBy(*family, "_slice").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy(*family, "_slice").agg(F.sum("nodes").alias("_whole")).select(*family, "_slice", F.sum("_whole").over(earlier).alias("_carried"))
    before = F.coalesce("_own", F.lit(0)) + F.coalesce("_carried", F.lit(0))
    return rows.withColumn("_own", F.sum("nodes").over(within)).hint("merge").join(carried, [*family, "_slice"]).select(
        *family, "id", "depth", (before * 2 + 1).alias("entry"))


def _entries(sized: DataFrame, keys: Sequence[str], deepest: int, folder: str) -> DataFrame:
    """(keys, id, entry): a node's place in the tour of its tree. In a round of reach r the rows of depth r or more hold the steps from their ancestor r
    steps above, and those above them are done."""
    done = sized.filter("depth = 0").select(*keys, "id", F.lit(1).cast("bigint").alias("entry"))
    rest, reach = _steps_from_parent(sized, keys).withColumnRenamed("parent", "up"), 1
    if deepest:
        rest = saved(rest, "subtree", f"{folder}/steps")
    while reach <= deepest:
        ahead = done.select(*keys, F.col("id").alias("up"), F.lit(None).cast(rest.schema["up"].dataType).alias("_up"), F.col("entry").alias("_entry")).unionByName(
            rest.select(*keys, F.col("id").alias("up"), F.col("up").alias("_up"), F.col("entry").alias("_entry")))
        step = rest.hint("merge").join(ahead, [*keys, "up"]).select(
            *keys, F.col("_up").alias("up"), "id", "depth", (F.col("entry") + F.col("_entry")).alias("entry"))
        step = saved(step, "subtree", f"{folder}/entries-{reach}")
        reach *= 2
        done = done.unionByName(step.filter(F.col("depth") < reach).select(done.columns))
        rest = step.filter(F.col("depth") >= reach)
    return done


def subtree_sums(nodes: DataFrame, id_column: str, parent_column: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, id, parent, root, depth, entry, exit, subtree_size, subtree_sum) of every node reachable from a root.

    ``entry`` and ``exit`` number a tree's steps from 1: a node lies below another of the same root exactly if its interval lies within the
    other's, so questions about subtrees are range conditions. ``subtree_sum`` adds ``value`` (whole numbers or decimals, NULL counts as 0) over
    the node and all below it. Work is log2(depth) rounds; no row holds a path. Orphans, cycles and what hangs
    below them have no row, as in ``forest``. The rows are stored when the function returns; what the rounds wrote is gone.
    """
    group, spark, kind = list(keys), nodes.sparkSession, nodes.schema[value].dataType
    folder = shared_folder(spark, "subtree")
    tree = forest(nodes, id_column, parent_column, group, with_path=False, folder=f"{folder}/forest")
    values = nodes.select(*group, F.col(id_column).alias("id"), F.coalesce(F.col(value), F.lit(0).cast(kind)).cast(_sum_type(kind)).alias("total"))
    tree = saved(tree.hint("merge").join(values, [*group, "id"]).withColumn("nodes", F.lit(1).cast("bigint")), "subtree", f"{folder}/tree")
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    sized = tree.drop("nodes", "total").hint("merge").join(_sums(tree, group, deepest, folder), [*group, "id"])
    sized = saved(sized, "subtree", f"{folder}/sized")
    total = F.col("total").cast(kind) if isinstance(kind, IntegralType) else F.col("total")
    result = saved(sized.hint("merge").join(_entries(sized, group, deepest, folder), [*group, "id"]).select(
        *group, "id", "parent", "root", "depth", "entry", (F.col("entry") + F.col("nodes") * 2 - 1).alias("exit"),
        F.col("nodes").alias("subtree_size"), total.alias("subtree_sum")), "subtree")
    removed(spark, folder)
    return result
