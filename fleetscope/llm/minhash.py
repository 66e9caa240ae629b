"""Near duplicates by a join of MinHash signatures over an inverted index of their coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.llm.frames import KEY, keep_rows, removed, saved, slices
from fleetscope.llm.graph import components
from fleetscope.llm.words import lower_words, mixed, shingle_set, word_hashes
from fleetscope.session import checkpointed, shared_folder

_SKETCH = "id bigint, text_hash bigint, n_shingles bigint, set_hi bigint, set_lo bigint, signature array<int>, parity array<bigint>"


def _coordinates(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, (2, count), dtype=np.uint64)
    return seeds[0] | np.uint64(1), seeds[1]


def signature(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the set, its upper 32 bits."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 8192):
        block = shingles[start:start + 8192]
        np.minimum(low, (block[None, :] * factors[:, None] + offsets[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def parity(shingles: np.ndarray) -> np.ndarray:
    """256 bits, each the parity of the set's elements that fall on it, as four numbers. An element that only one of two sets has flips
    one bit, so two sets differ in at least as many elements as their bits differ."""
    bits = np.bincount((shingles & np.uint64(255)).astype(np.intp), minlength=256) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, coordinates: int) -> DataFrame:
    """Per row: id, text hash, set size, 128-bit digest of the shingle set, signature (null for an empty set)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = _coordinates(coordinates)
        hashes = word_hashes()
        for batch in slices(batches):
            sizes, his, los, signatures, parities = [], [], [], [], []
            for data in batch.column(2).cast(pa.binary()).to_pylist():
                shingles = shingle_set(hashes.of(lower_words(data or b"")), words)
                sizes.append(len(shingles))
                his.append(shingles.sum(dtype=np.uint64).astype(np.int64))
                los.append(mixed(shingles).sum(dtype=np.uint64).astype(np.int64))
                signatures.append(signature(shingles, factors, offsets) if len(shingles) else None)
                parities.append(parity(shingles))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(his, pa.int64()),
                 pa.array(los, pa.int64()), pa.array(signatures, pa.list_(pa.int32())), pa.array(parities, pa.list_(pa.int64()))],
                ["id", "text_hash", "n_shingles", "set_hi", "set_lo", "signature", "parity"])

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return source.mapInArrow(rows, _SKETCH)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose full shingle sets meet the similarity: 100 * shared >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in slices(batches):
            a, b, left, right = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for x, y in zip(left, right):
                p, q = (shingle_set(hashes.of(lower_words(t.encode())), words) for t in (x, y))
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            chosen = [i for i, k in enumerate(keep) if k]
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in chosen], pa.int64()),
                                              "b": pa.array([b[i] for i in chosen], pa.int64())})

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    return checkpointed(both.mapInArrow(confirm, "a bigint, b bigint"))


def _colliding(pairs: DataFrame, lists: DataFrame, matches: int, percent: int) -> DataFrame:
    """Of distinct pairs, those whose sizes allow the similarity and whose signatures agree in ``matches`` coordinates."""
    first = lists.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("posted.key").alias("keys_a"))
    second = lists.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("posted.key").alias("keys_b"))
    return (
        pairs.join(first, "a").join(second, "b")
        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .where(F.size(F.array_intersect("keys_a", "keys_b")) >= matches)
        .select("a", "b")
    )


def _bits(left: list[Column], right: list[Column]) -> Column:
    """Number of bits set in ``left`` that are not set in ``right``."""
    return reduce(lambda x, y: x + y, [F.bit_count(a.bitwiseAND(F.bitwise_not(b))) for a, b in zip(left, right)])


def _cross_pairs(lists: DataFrame, groups: DataFrame, matches: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of nodes from different groups that share a posting of their prefixes.

    Groups meet first, then their members. Two sets of the similarity differ in at most (n_a + n_b) * (100 - percent) / (100 + percent)
    elements, so pairs - of groups, by the bits all their members have or none has, and of nodes - whose parities differ in
    more bits cannot reach it. This drops texts that only share a long common passage before they become pairs.
    """
    prefix = F.slice("posted", F.lit(1), F.size("posted") - matches + 1)
    entries = (
        lists.join(groups.withColumnRenamed("root", "group"), "node", "left")
        .select("node", "n", F.coalesce("group", "node").alias("group"), *[F.col("parity")[i].alias(f"p{i}") for i in range(4)],
                F.size("posted").alias("m"), F.posexplode(prefix).alias("at", "posting"))
        .select("node", "n", "group", "at", "p0", "p1", "p2", "p3", F.col("posting.key").alias("key"), (F.col("m") - F.col("at") - 1).alias("rest"))
    )
    entries = checkpointed(entries)
    sizes = entries.where("at = 0").groupBy("group").agg(F.count("*").alias("size"))
    per_group = entries.groupBy("key", "group").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"),
        *[F.bit_and(f"p{i}").alias(f"all{i}") for i in range(4)], *[F.bit_or(f"p{i}").alias(f"any{i}") for i in range(4)]).join(sizes, "group")
    one, two = (per_group.select("key", *[F.col(c).alias(f"{c}_{s}") for c in per_group.columns if c != "key"]) for s in "ab")
    named = lambda kind, s: [F.col(f"{kind}{i}_{s}") for i in range(4)]
    met = one.join(two, "key").where(
        (F.col("group_a") < F.col("group_b")) & (100 * F.col("most_a") >= percent * F.col("least_b"))
        & (100 * F.col("most_b") >= percent * F.col("least_a")) & (F.least("rest_a", "rest_b") + 1 >= matches)
        & ((100 + percent) * (_bits(named("all", "a"), named("any", "b")) + _bits(named("all", "b"), named("any", "a")))
           <= (100 - percent) * (F.col("most_a") + F.col("most_b")))).select("key", "group_a", "group_b", "size_a", "size_b")
    # The smaller group comes first: its members join before any condition can rule a pair out, those of the larger one with it.
    # With a single node on one side, each member of the other side is one pair, whatever the number of values they share.
    swap = F.col("size_a") > F.col("size_b")
    met = met.select(
        F.when(swap, F.col("group_b")).otherwise(F.col("group_a")).alias("group_a"),
        F.when(swap, F.col("group_a")).otherwise(F.col("group_b")).alias("group_b"),
        F.when(F.least("size_a", "size_b") == 1, F.lit(-1)).otherwise(F.col("key")).alias("key")).distinct()
    columns = ["node", "n", "p0", "p1", "p2", "p3", "group"]
    once = entries.groupBy("node").agg(*[F.first(c).alias(c) for c in columns[1:]])
    reach = entries.select("key", *columns, "rest").unionByName(once.select(F.lit(-1).cast("bigint").alias("key"), *columns, F.col("n").cast("int").alias("rest")))
    members = lambda s: reach.select("key", *[F.col(c).alias(f"{c}_{s}") for c in reach.columns if c != "key"])
    differ = _bits(named("p", "a"), named("p", "b")) + _bits(named("p", "b"), named("p", "a"))
    return (
        met.join(members("a"), ["key", "group_a"]).join(members("b"), ["key", "group_b"])
        .where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((F.col("key") < 0) | (F.least("rest_a", "rest_b") + 1 >= matches))
               & ((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))))
        .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
    coordinates: int = 64, matches: int = 36,
) -> DataFrame:
    """Return (doc_id, text_hash, n_shingles, component_id, kept) for every row.

    1. A task turns a text into its set of ``words``-word shingles, a digest of the set and a MinHash signature. Rows with equal
       sets form one node, so copies never meet as pairs.
    2. Nodes are posted under each (coordinate, value) of their signature. A value that one node has alone
       is skipped; a node left with fewer than ``matches`` postings has no partner and is skipped too.
    3. First pairs: each node with the smallest and the most central node of each of its lists, so a list of any length gives at most two
       pairs a node. Pairs that agree in ``matches`` coordinates are confirmed on full sets and merged into groups.
    4. Other pairs: lists are cut to prefixes - of m postings, rarest first, m - matches + 1 must hold a shared one - and
       joined between different groups only, and only where the remaining positions can still reach ``matches`` and the parities of
       the sets allow the similarity. These pairs too are counted and confirmed. Members of one group are never paired again.

    A pair at the similarity limit agrees in fewer than 36 of 64 coordinates with probability 1e-5, any pair above it
    more rarely; confirmed links are exact. Null, empty and blank texts have no shingles and no links.
    Rows that repeat an id with different texts are told apart by their text. A null id never is a
    component_id unless all ids of the group are null; only then is its row kept.
    """
    rows = checkpointed(sketches(docs, id_col, text_col, words, coordinates))
    nodes = (
        rows.where("n_shingles > 0").groupBy("set_hi", "set_lo", "n_shingles")
        .agg(F.min("id").alias("first_id"), F.min(F.struct("id", "text_hash")).alias("sample"), F.first("signature").alias("signature"),
             F.first("parity").alias("parity"))
    )
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))

    postings = nodes.select("node", F.col("n_shingles").alias("n"), F.posexplode("signature").alias("at", "value")).select(
        "node", "n", F.shiftleft(F.col("at").cast("bigint"), 32).bitwiseOR(F.col("value").cast("bigint").bitwiseAND(0xFFFFFFFF)).alias("key"))
    shared = (
        postings.groupBy("key").agg(F.count("*").alias("df"), F.min("node").alias("low"))
        .where("df > 1")
    )
    lists = (
        postings.join(shared, "key").groupBy("node")
        .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "key", "low"))).alias("posted"))
        .where(F.size("posted") >= matches)
    )
    lists = checkpointed(lists)

    sample = nodes.join(lists.select("node"), "node", "left_semi").select("node", "sample")
    texts = docs.select(F.struct(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash")).alias("own"), F.col(text_col).alias("text"))
    texts = texts.join(sample, F.col("own.id").eqNullSafe(F.col("sample.id")) & (F.col("own.text_hash") == F.col("sample.text_hash")))
    kept_texts = shared_folder(docs.sparkSession, "near-texts")
    texts = saved(texts.select("node", "text"), "near-texts", kept_texts)

    # A node whose values are the most common ones is the centre of its copies: most of them link with it.
    posted = lists.select("node", F.aggregate("posted", F.lit(0).cast("bigint"), lambda s, p: s + p["df"]).alias("weight"), F.explode("posted.key").alias("key"))
    centres = posted.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("centre"))
    central = posted.join(centres, "key").groupBy("node").agg(F.collect_set("centre").alias("centres"))
    leading = F.explode(F.array_union(F.array_distinct("posted.low"), "centres"))
    stars = lists.join(central, "node").select("node", leading.alias("other")).where("node <> other")
    stars = stars.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    links = _verified(_colliding(stars, lists, matches, percent), texts, words, percent)
    groups = components(links)

    others = _cross_pairs(lists.join(nodes.select("node", "parity"), "node"), groups, matches, percent)
    more = _verified(_colliding(others, lists, matches, percent), texts, words, percent)
    found = components(links.unionByName(more))
    removed(docs.sparkSession, kept_texts)  # both sets of links are stored

    member = nodes.join(found, "node", "left").select("set_hi", "set_lo", "n_shingles", "first_id", F.coalesce("root", "node").alias("root"))
    best = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = member.join(best, "root").select("set_hi", "set_lo", "n_shingles", "component_id")
    linked = rows.where("n_shingles > 0").join(member, ["set_hi", "set_lo", "n_shingles"])
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("id"))
    names = ["id", "text_hash", "n_shingles", "component_id"]
    return linked.select(names).unionByName(alone.select(names)).select(
        F.col("id").alias("doc_id"), "text_hash", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group of near duplicates, with all columns of ``docs``; rows without shingles stay."""
    kept = near_duplicates(docs, id_col, text_col, **how).where("kept")
    return keep_rows(docs, kept.select(F.struct(F.col("doc_id").alias("id"), "text_hash").alias(KEY)), id_col, text_col)
