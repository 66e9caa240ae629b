"""Peak load and state classes over a stream of activity samples.

Each micro-batch is reduced to counts per second (or per bucket and state) and written below the number of its
batch; a repeated batch replaces its own rows. The results are read from these counts by adding them up, so they hold every
sample, however late it comes, open buckets included, and no state grows with the stream. ``compact`` adds up the counts of many
batches once they have become many files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetscope.functions.times import bucket_start
from fleetscope.operators.samples import wait_state

Reduce = Callable[[DataFrame], DataFrame]


def load_counts(keys: Sequence[str] = ("con_id",), ts: str = "sample_time", fine: str = "1 second") -> Reduce:
    """Samples to counts per ``fine`` step."""

    def reduce(samples: DataFrame) -> DataFrame:
        return samples.groupBy(*keys, bucket_start(F.col(ts), fine).alias("step")).agg(F.count(F.lit(1)).alias("samples"))

    return reduce


def peak_load(counts: DataFrame, keys: Sequence[str] = ("con_id",), coarse: str = "10 minutes") -> DataFrame:
    """Largest number of samples per step within each ``coarse`` bucket, from stored counts."""
    steps = counts.groupBy(*keys, "step").agg(F.sum("samples").alias("samples"))
    return steps.groupBy(*keys, bucket_start(F.col("step"), coarse).alias("bucket")).agg(
        F.max("samples").alias("sess_count")
    )


def state_counts(keys: Sequence[str] = ("con_id",), ts: str = "sample_time", state: Column | None = None,
                 bucket: str = "1 hour", foreground: Column | None = None) -> Reduce:
    """Samples to counts per bucket and state class."""
    wanted = F.col("session_type") == "FOREGROUND" if foreground is None else foreground
    label = wait_state() if state is None else state

    def reduce(samples: DataFrame) -> DataFrame:
        return samples.filter(wanted).groupBy(
            *keys, bucket_start(F.col(ts), bucket).alias("tm"), label.alias("state")
        ).agg(F.count(F.lit(1)).alias("samples"))

    return reduce


def active_by_state(counts: DataFrame, keys: Sequence[str] = ("con_id",), samples_per_bucket: int = 360) -> DataFrame:
    """Mean active sessions per bucket and state class, from stored counts."""
    return counts.groupBy(*keys, "tm", "state").agg(
        (F.sum("samples") / F.lit(samples_per_bucket)).alias("sess_cnt")
    )


def sample_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet",
                  files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, reduce: Reduce, out: str, state_folder: str) -> DataFrame:
    """Reduce what the source holds now, stop, and return all stored counts. A restart continues from ``state_folder``."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    # An empty part fixes the schema of a stream that has not delivered anything yet.
    write(spark.createDataFrame([], stream.schema), -1)
    run = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", state_folder)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def compact(counts: DataFrame) -> DataFrame:
    """Stored counts with one row per key: write them to a folder of their own and read both from then on."""
    return counts.groupBy(*[c for c in counts.columns if c != "samples"]).agg(F.sum("samples").alias("samples"))
