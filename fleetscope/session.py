"""Session helpers: a local test session and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "fleetscope") -> SparkSession:
    """Session for tests and the bench. A cluster job brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder for ``DataFrame.checkpoint``.

    A cluster names it in ``spark.checkpoint.dir``, on storage every executor reaches, so that
    checkpointed data survive the loss of an executor. Only a local session without that
    setting gets a folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="fleetscope-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """New folder name below the checkpoint folder, for tables that one job writes and reads back."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def saved(df: DataFrame, purpose: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back: it survives executors, is
    computed once and takes less disk than a checkpoint when rows hold texts. A caller that removes the rows later names the folder.

    The planner then knows how large the rows are. Rows of a checkpoint keep the estimate of the plan that made them, and an estimate of a join
    is a product: where each round of a loop joins the one before, it squares every time, and after some 20 rounds that one number fills the driver."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder below the shared one, through Spark's file systems, once nothing reads it any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def mounted_path(folder: str) -> str | None:
    """The folder as a plain path if it is on a file system, else None (object store, HDFS)."""
    if folder.startswith("file:"):
        return "/" + folder.removeprefix("file:").lstrip("/")
    return folder if folder.startswith("/") else None
