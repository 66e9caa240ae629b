"""Small frame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetscope.session import removed, saved  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, the class [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
KEY = "__row_key"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows: a task turns no more texts into Python objects at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def row_key(id_col: str, text_col: str) -> Column:
    """A row's id with a hash of its text: tells rows apart that repeat an id with another text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"))


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose ``row_key`` is in the column KEY of ``keys``, one for each key, with the columns of ``docs``.

    Keys are made distinct where they are small; rows shuffle once, on plain columns without nulls, so that the join and the
    choice of one row a key share a partitioning and an order."""
    parts = [f"{KEY}_{i}" for i in range(3)]

    def split(rows: DataFrame, key: Column) -> DataFrame:
        return rows.withColumns(dict(zip(parts, (F.coalesce(key["id"].cast("bigint"), F.lit(0)), key["id"].isNull(), key["text_hash"]))))

    wanted = split(keys.select(KEY), F.col(KEY)).select(parts).distinct()
    return split(docs, row_key(id_col, text_col)).join(wanted, parts, "left_semi").dropDuplicates(parts).drop(*parts)
