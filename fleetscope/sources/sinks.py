"""Writers for sections: CSV or Parquet folders, partitioned by bundle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fleetscope.sources.bundles import CSV_OPTIONS
from fleetscope.sources.schemas import schema_of

CSV_WRITE = {**CSV_OPTIONS, "header": "true", "compression": "gzip"}


def write_section(df: DataFrame, folder: str, section: str, fmt: str = "parquet") -> None:
    """One section under ``folder/section``, in a folder per bundle.

    The rebalance hint gathers a bundle's rows into few files and splits a bundle that is much
    larger than the others, so neither tiny files nor one huge task come up.
    """
    if "bundle_id" in df.columns:
        writer = df.hint("rebalance", "bundle_id").write.mode("overwrite").partitionBy("bundle_id")
    else:
        writer = df.hint("rebalance").write.mode("overwrite")
    target = f"{folder}/{section}"
    if fmt == "csv":
        writer.options(**CSV_WRITE).csv(target)
    else:
        writer.format(fmt).save(target)


def write_sections(sections: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Every section; each write is one distributed job."""
    for name, df in sections.items():
        write_section(df, folder, name, fmt)


#: Column of a tall result that names the section a row belongs to.
SECTION = "section"


def write_tall(df: DataFrame, folder: str, group: str, fmt: str = "parquet") -> None:
    """Many sections of one schema from one job: rows carry their section's name and go to a folder per section and bundle.

    The result is computed once, whatever the number of sections; ``read_section`` finds them below ``folder/group``.
    """
    parts = [SECTION, *(c for c in ("bundle_id",) if c in df.columns)]
    writer = df.hint("rebalance", *parts).write.mode("overwrite").partitionBy(*parts)
    if fmt == "csv":
        writer.options(**CSV_WRITE).csv(f"{folder}/{group}")
    else:
        writer.format(fmt).save(f"{folder}/{group}")


def _raw(spark: SparkSession, schema: T.StructType, folder: str) -> DataFrame:
    text = ", ".join(f"`{f.name}` STRING" for f in schema.fields) + ", bundle_id STRING"
    return spark.read.schema(text).option("header", "true").option("multiLine", "true").option("escape", '"').csv(folder)


def read_section(spark: SparkSession, folder: str, section: str, fmt: str = "parquet", group: str | None = None) -> DataFrame:
    """A stored section with its fixed schema; CSV types are never inferred. ``group`` names the tall result that holds it."""
    target = f"{folder}/{section}" if group is None else f"{folder}/{group}/{SECTION}={section}"
    if fmt != "csv":
        return spark.read.format(fmt).load(target)
    schema = schema_of(section)
    raw = _raw(spark, schema, target)
    return raw.select("bundle_id", *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])
