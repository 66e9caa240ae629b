"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetscope.llm.frames import KEY, row_key

#: Leading hex digits of a row's hash that cut a source into ranges (65,536); a window sees one range of one source.
RANGE_DIGITS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3) -> DataFrame:
    """(source, source_size) -> with ``target``: weights repeat over sources in order of code points, null last, and share the
    sum of all sizes; a target stops at ``most`` times its source, the excess is shared again by weight until none is above.

    In the order of limit by weight, the sources that stop come first: a source stops if its limit is at most the
    share that what is left of the sum gives it. Windows here run over one row for each source.
    """
    whole = W.orderBy(F.col("source").asc_nulls_last())
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(whole) - 1, F.lit(len(weights))) + 1).cast("int"))
    listed = sizes.withColumn("weight", picked).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    listed = listed.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                               / F.sum("weight").over(onward))
    stops = F.col("cap") <= F.col("level") * F.col("weight")
    level = F.max(F.when(~stops, F.col("level"))).over(everything)  # of the first that goes on; later ones are lower
    return listed.withColumn("stops", stops).withColumn(
        "target", F.when(F.col("stops"), F.col("cap")).otherwise(level * F.col("weight"))).select("source", "source_size", "target")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3), most: float = 3, seed: int = 17, range_digits: int = RANGE_DIGITS,
) -> DataFrame:
    """Return (doc_id, text_hash, size, source_size, target, taken, starts) for every row.

    Rows of a source stand in the order of a hash of their id: a random order that reruns repeat. The hash's leading digits cut a source
    into ranges; their sums give each range's start, and a window within the range the row's. The source is run
    through as often as its target holds it whole, and the last time up to the exact word: ``taken`` counts the words
    of a row that fall within, ``starts`` how many runs reach the row. No text is shuffled, and no window holds
    more than a range of a source.

    A null text has size 0 and is taken 0 times, as are blank texts; a null source is a source of its own. Rows that
    repeat an id stand next to each other, in the order of their text's hash.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).alias("source"),
                       word_count(F.col(text_col)).alias("size"))
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(seed))))).withColumn(
        "part", F.substring("key", 1, range_digits))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, most)
    targets = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    ahead = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("part_start"))
    plan = parts.join(targets, F.col("p_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    within = W.partitionBy("source", "part").orderBy("key", "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    budget = F.floor("target").cast("bigint")
    runs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    left = budget - runs * F.col("source_size")
    start = F.col("part_start") + F.col("inside")
    last = F.least(F.greatest(left - start, F.lit(0)), F.col("size"))
    return placed.select(
        "doc_id", "text_hash", "size", "source_size", "target", (runs * F.col("size") + last).alias("taken"),
        F.when(F.col("size") > 0, runs + (last > 0).cast("bigint")).otherwise(0).alias("starts"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a document stands there once for each run that reaches it, whole; the
    document at a source's cut is not divided, so a source exceeds its budget by less than one document."""
    plan = mix(docs, id_col, text_col, source_col, **how).where("starts > 0")
    plan = plan.groupBy("doc_id", "text_hash").agg(F.max("starts").alias("starts"))
    plan = plan.select(F.struct(F.col("doc_id").alias("id"), "text_hash").alias("__planned"), F.col("starts").alias("__starts"))
    keyed = docs.withColumn(KEY, row_key(id_col, text_col))
    same = (F.col(f"{KEY}.id").eqNullSafe(F.col("__planned.id")) & (F.col(f"{KEY}.text_hash") == F.col("__planned.text_hash")))
    joined = keyed.join(plan, same).withColumn("__run", F.explode(F.sequence(F.lit(1), F.col("__starts"))))
    return joined.drop(KEY, "__planned", "__starts", "__run")
