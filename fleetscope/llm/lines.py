"""Line deduplication over the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.llm.frames import WHITE, ascii_lower


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def line_hash(key: Column) -> Column:
    """96 bits: two hashes of different families, so that different lines do not meet even among 1e12."""
    return F.struct(F.xxhash64(key).alias("h"), F.hash(key).alias("g"))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3,
) -> DataFrame:
    """Return (doc_id, n_lines, n_dropped, text): texts without the lines that many documents share.

    Lines are exploded with their positions and reduced to hashes before any shuffle; a hash in at least ``min_docs`` documents is
    dropped everywhere except in the largest id that holds it. Positions to drop return to their document, and its other lines are put
    together by position: work and memory grow with a document's lines, not with their square. Line texts never leave their document. A
    very common line is one row per document and place, joined on the side that Spark splits, and one row per task where documents are counted.

    Null and empty texts have one empty line. Rows that repeat an id count as one document and each get their text; a null id is a document of
    its own, smaller than all others. Ids are compared only for the largest, so there are no ties. Lines shorter than ``min_chars`` code points
    always stay. A very long text is split in its task and takes a few times its size there.
    """
    own = ["id", "text_hash"]
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    keys = source.select(*own, F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).select(*own, "at", line_key(F.col("line")).alias("key"))
    held = keys.where(F.length("key") >= min_chars).select(*own, "at", line_hash(F.col("key")).alias("hash"))
    common = held.select("id", "hash").distinct().groupBy("hash").agg(F.count("*").alias("docs"), F.max("id").alias("last_id")).where(F.col("docs") >= min_docs)
    drops = held.join(common.select("hash", "last_id"), "hash").where(~F.col("id").eqNullSafe(F.col("last_id")))
    drops = drops.groupBy(*own).agg(F.collect_set("at").alias("drops")).select(F.col("id").alias("drop_id"), F.col("text_hash").alias("drop_hash"), "drops")
    joined = source.join(drops, (F.col("text_hash") == F.col("drop_hash")) & F.col("id").eqNullSafe(F.col("drop_id")), "left")
    parted = joined.select("id", F.split("text", "\n", -1).alias("lines"), "drops")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda at: F.get("lines", at)))
    return parted.select("id", F.size("lines").cast("bigint").alias("n_lines"), kept.alias("kept")).select(
        F.col("id").alias("doc_id"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
