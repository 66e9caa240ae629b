"""The next id in ascending order, for every id of a table, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Bits by which ids are grouped, groups of groups and so on; the last level has at most 2**8 groups, and one for null.
LEVELS = (10, 14, 16, 16)


def _parent(bits: int) -> Column:
    return F.shiftright("key", bits)


def following(ids: DataFrame, id_col: str) -> DataFrame:
    """Return (id, next_id) for the distinct ids of ``ids``: the next larger id, for the last one the first. A null id comes before all others;
    a single id follows itself.

    Ids are cut into groups by their upper bits, groups into larger groups. Windows run within a group (at most 1,024 ids, or 65,536 groups), and
    the last of a group gets the first of the group after it, so no window grows with the table.
    """
    levels = [ids.select(F.col(id_col).cast("bigint").alias("key")).distinct().withColumn("first", F.struct(F.col("key").alias("id")))]
    for bits in LEVELS:
        levels.append(levels[-1].groupBy(_parent(bits).alias("key")).agg(F.min("first").alias("first")))
    order = F.col("key").asc_nulls_first()
    top = W.orderBy(order)
    above = levels.pop().select("key", F.lead("first").over(top).alias("after"), F.first("first").over(top.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("start"))
    above = above.select("key", F.coalesce("after", "start").alias("after"))  # a struct: a null id in it is an id
    for bits, level in zip(reversed(LEVELS), reversed(levels)):
        within = W.partitionBy("parent").orderBy(order)
        level = level.withColumn("parent", _parent(bits)).withColumn("after", F.lead("first").over(within)).alias("l")
        up = above.select(F.col("key").alias("up"), F.col("after").alias("beyond")).alias("u")
        above = level.join(up, F.col("l.parent").eqNullSafe(F.col("u.up"))).select("key", F.coalesce("after", "beyond").alias("after"))
    return above.select(F.col("key").alias("id"), F.col("after.id").alias("next_id"))
