"""Training-data pipeline over the documents table: filter, deduplicate, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetscope.llm import exact, minhash, mixing, packing, quality
from fleetscope.llm.frames import removed, saved, table
from fleetscope.llm.queries import tokenizer_path
from fleetscope.session import shared_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the ordinal classifier keeps; it is fitted on the labelled rows of ``docs``.

    A null text is judged as an empty one. Repeated rows stay or go together. An empty table stays empty; without a label all rows stay. Texts
    of any length are read whole. Columns of any name pass through."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space: the one with the most code points, then the smallest id.

    Null and empty texts are equal to each other. Of rows that repeat id and text one stays; a null id comes before all others. An empty table
    stays empty, and columns of any name pass through."""
    return exact.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id; shingles of five words, similarity 0.8 or more.

    Null, empty and blank texts have no shingles and all stay, repeated rows once. A null id stays only if its whole group has none. Long
    texts are compared whole. An empty table stays empty, and columns of any name pass through."""
    return minhash.drop_near_duplicates(docs, words=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target reaches them, whole.

    Texts without words have size 0 and go. Null sources are one source. Rows that repeat id and text count once each in the sizes, and stand there
    as often as the mix repeats that text. An empty table stays empty, and columns of any name pass through."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids, in sequences of 4096.

    Null and empty texts are the end id alone; long texts are cut over sequences; repeated rows are packed as often as they stand there. An
    empty table gives no pieces. Columns besides id and text are left out."""
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("mixing", mixture),
    ("packing", packed),
]

#: The classifier and the tokenizer cannot be written in SQL; tests/llm/test_plain.py holds every stage's rows and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table; each stage's rows are written as Parquet in the shared folder and read again. Once a stage has
    been written, the rows it was made from are removed; the last stage's stay."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = shared_folder(spark, f"pipeline-{name}")
        docs = saved(stage(spark, docs, sf_dir), name, folder)
        if before:
            removed(spark, before)
        before = folder
    return docs
