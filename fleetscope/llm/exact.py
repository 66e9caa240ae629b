"""Exact duplicates by sorting contents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetscope.llm.frames import KEY, WHITE, keep_rows
from fleetscope.session import checkpointed

_RUNS = "id bigint, text_hash bigint, sha string, first boolean, task int, run bigint, opens boolean, closes boolean"


def normalised(text: Column) -> Column:
    """The text without any ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal texts in one sorted range: each row is compared in full with the row before."""
    task = TaskContext.get().partitionId()
    run, before, sha, held = -1, None, "", None
    for batch in batches:
        shas, firsts, runs = [], [], []
        for text in batch.column(2).to_pylist():
            firsts.append(text != before)
            if firsts[-1]:
                run, before = run + 1, text
                sha = hashlib.sha256(text.encode()).hexdigest()
            shas.append(sha)
            runs.append(run)
        if held is not None:
            yield _labelled(held, task, None)
        held = (batch, shas, firsts, runs)
    if held is not None:
        yield _labelled(held, task, run)


def _labelled(held: tuple, task: int, last: int | None) -> pa.RecordBatch:
    batch, shas, firsts, runs = held
    n = len(runs)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(shas, pa.string()), pa.array(firsts, pa.bool_()), pa.array([task] * n, pa.int32()),
         pa.array(runs, pa.int64()), pa.array([r == 0 for r in runs], pa.bool_()), pa.array([r == last for r in runs], pa.bool_())],
        ["id", "text_hash", "sha", "first", "task", "run", "opens", "closes"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (doc_id, text_hash, keep_id, group_size, kept, text_sha256) for every row.

    Rows are range-partitioned by sampled splitters and sorted outside memory within each range; equal
    normalised texts then lie next to each other and a full comparison with the row before finds them. Splitters hold the first 32
    characters, a content hash, the length and the id, so they stay small whatever the texts, texts with a long
    common beginning are spread, and a group of copies of any size is cut into several ranges. A run that goes on over a
    border is joined with its first part through the first and last runs of the ranges (at most two a range).

    Of equal texts the row with the most code points stays, then the smallest id, a null id first; of rows that repeat an
    id with equal texts one stays. A null text counts as empty, and empty texts are equal to each other.
    """
    norm = normalised(F.col("text"))
    ranged = (
        docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("head", F.substring(norm, 1, 32)).withColumn("content", F.xxhash64(norm))
        .withColumn("shorter", -F.length("text"))
        .repartitionByRange("head", "content", "shorter", "id", "text_hash")
        .withColumn("norm", norm).drop("text")
        .sortWithinPartitions("head", "content", "norm", "shorter", "id", "text_hash")
    )
    runs = checkpointed(ranged.select("id", "text_hash", "norm").mapInArrow(_runs, _RUNS))

    sizes = runs.groupBy("task", "run").agg(
        F.max("sha").alias("sha"), F.max(F.when(F.col("first"), F.col("id"))).alias("leader"), F.count("*").alias("n"),
        F.max("opens").alias("opens"), F.max("closes").alias("closes"))
    sizes = checkpointed(sizes)
    # A range's first run may continue the last run of the range before; both touch a border, all others are whole.
    across = W.partitionBy("sha")
    border = sizes.where("opens or closes").select(
        "task", "run", F.first("task").over(across.orderBy("task")).alias("head_task"),
        F.first("run").over(across.orderBy("task")).alias("head_run"),
        F.first("leader").over(across.orderBy("task")).alias("keep_id"), F.sum("n").over(across).alias("group_size"))
    inner = sizes.where("not (opens or closes)").select(
        "task", "run", F.col("task").alias("head_task"), F.col("run").alias("head_run"), F.col("leader").alias("keep_id"), F.col("n").alias("group_size"))
    groups = inner.unionByName(border)
    return runs.join(groups, ["task", "run"]).select(
        F.col("id").alias("doc_id"), "text_hash", "keep_id", "group_size",
        (F.col("first") & (F.col("task") == F.col("head_task")) & (F.col("run") == F.col("head_run"))).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all columns of ``docs``."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept")
    return keep_rows(docs, kept.select(F.struct(F.col("doc_id").alias("id"), "text_hash").alias(KEY)), id_col, text_col)
