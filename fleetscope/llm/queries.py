"""The operators as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetscope.llm import conversations, embeddings, exact, fingerprints, html, lines, minhash, mixing, packing, quality, sharding, urls, whitening
from fleetscope.llm.frames import table
from fleetscope.llm.oracle import SQL

__all__ = ["QUERIES", "SQL"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, folder, "documents"), words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path(), with_ids=False)


@query
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


@query
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.drop_repeated_lines(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents"), [f"shard-{i:03d}" for i in range(64)])


@query
def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


@query
def op11_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprints.compared_with_edits(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return conversations.repair_report(conversations.damaged(turns), turns)


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))
