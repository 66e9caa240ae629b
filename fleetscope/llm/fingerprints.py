"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.llm.frames import WHITE, ascii_lower
from fleetscope.llm.ids import following

#: Hex digits of a shingle's hash that are kept: 60 bits, a bigint without sign.
DIGITS = 15
#: Shingles of so many words, and one of so many is retained.
WORDS, SCALE = 5, 8


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; none for null, empty and blank texts."""
    trimmed = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def shingle_hashes(words: Column, size: int = WORDS) -> Column:
    """Leading hex digits of the md5 of every run of ``size`` words; fewer words are one run, none give none."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1)))
    hashed = F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(words, i, size), " ")), 1, DIGITS))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(hashed)


def _threshold(scale: int) -> str:
    return f"{16**DIGITS // scale:0{DIGITS}x}"


def with_sketch(rows: DataFrame, text_col: str, out: str, size: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Add the sketch ``out`` (array<bigint>, ascending, distinct): every shingle hash below 1/``scale`` of the hash range, or the
    smallest hash if none is below. Steps are columns of their own, so that hashes are made once."""
    words, hashes, low = f"__{out}_words", f"__{out}_hashes", f"__{out}_low"
    found = rows.withColumn(words, words_of(F.col(text_col))).withColumn(hashes, shingle_hashes(F.col(words), size))
    found = found.withColumn(low, F.filter(hashes, lambda h: h < F.lit(_threshold(scale))))
    least = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<string>"))
    kept = F.when(F.size(low) > 0, F.col(low)).otherwise(least)
    return found.withColumn(out, F.array_sort(F.array_distinct(F.transform(kept, lambda h: F.conv(h, 16, 10).cast("bigint"))))).drop(words, hashes, low)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the union of two sets from their sketches alone, in any order and grouping."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: h < F.lit(16**DIGITS // scale))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first set that is in the second, whatever their sizes. A set without shingles is contained in another such set only."""
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(sketch: Column) -> Column:
    """The hashes in ascending order, ``DIGITS`` hex digits each."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Return (doc_id, n_chars, sketch, fingerprint) for every row; built-ins only, no shuffle.

    A text's set holds its runs of ``size`` words, A-Z lower-cased; a text of fewer words is one run, and texts that are null, empty or blank
    have an empty set. The sketch retains every hash below a fixed share of the hash range, so it grows with the text, and the
    sketches of a paragraph and a book compare: of the paragraph's hashes below the threshold, those that the book shares are in the book's sketch too.
    Sketches of parts merge into the sketch of the whole (``merged``). A set with no hash below the threshold keeps its
    smallest one, so that short texts are not without a sketch; equal sets always have equal sketches. Repeated rows each get theirs.
    A very long text takes about ten times its size in its task.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_sketch(source, "text", "sketch", size, scale).select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "sketch", as_text(F.col("sketch")).alias("fingerprint"))


def compared_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Return (doc_id, n_chars, edited_text, sketch, edited_sketch, near_edited, near_next) for every row.

    The edited text has the last floor(n_chars/2) code points replaced by the first as many, or all, of the next document by ascending id, the
    first one's for the last. ``near_edited`` and ``near_next`` are the containments of the document in its edited text and in the next
    document, estimated from sketches.

    Texts shuffle once by id; of the next document, only the code points needed and its sketch travel on. Rows that repeat an id have
    the same next document; an id with several texts is represented by the text with the smallest hash. A null id comes first.
    Null texts count as empty. Hot ids are on the side of the joins that Spark splits, and are reduced to one row before they travel on.
    """
    # Null ids are told apart by a column of their own, so that joins and groups agree on plain keys and share exchanges.
    source = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("own"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("own_text"))
    half = lambda text: F.floor(F.length(text) / 2).cast("int")
    needs = source.groupBy("own", "no_id").agg(F.max(half(F.col("own_text"))).alias("need"))
    ids = following(source.select(F.when(~F.col("no_id"), F.col("own")).alias("id")), "id")
    keyed = lambda name, own, no_id: (F.coalesce(name, F.lit(0)).alias(own), F.col(name).isNull().alias(no_id))
    wanted = ids.select(*keyed("id", "own", "no_id"), F.col("next_id")).join(needs, ["own", "no_id"]).select(
        F.col("own").alias("head_of"), F.col("no_id").alias("head_of_null"), "need", *keyed("next_id", "own", "no_id"))

    sketched = with_sketch(source, "own_text", "sketch", size, scale)
    heads = sketched.join(wanted, ["own", "no_id"]).select(
        "head_of", "head_of_null", F.xxhash64("own_text").alias("text_hash"),
        F.struct(F.substring(F.col("own_text"), F.lit(1), F.col("need")).alias("head"), F.col("sketch").alias("next_sketch")).alias("next"))
    heads = heads.groupBy("head_of", "head_of_null").agg(F.min_by("next", "text_hash").alias("next"))
    joined = sketched.join(heads, (F.col("own") == F.col("head_of")) & (F.col("no_id") == F.col("head_of_null")))
    n = F.length("own_text")
    cut = half(F.col("own_text"))
    edited = F.concat(F.substring(F.col("own_text"), F.lit(1), n - cut), F.substring(F.col("next.head"), F.lit(1), cut))
    both = joined.select(F.when(~F.col("no_id"), F.col("own")).alias("doc_id"), n.cast("bigint").alias("n_chars"), edited.alias("edited_text"), "sketch", F.col("next.next_sketch").alias("next_sketch"))
    return with_sketch(both, "edited_text", "edited_sketch", size, scale).select(
        "doc_id", "n_chars", "edited_text", "sketch", "edited_sketch", containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
