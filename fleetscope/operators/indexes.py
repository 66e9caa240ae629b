"""Dictionary reports: redundant indexes, low-density indexes, migrated rows, table density."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fleetscope.functions.nulls import concat_nn
from fleetscope.functions.numbers import number_text
from fleetscope.operators.dims import with_value
from fleetscope.session import saved, shared_folder

# Owners whose indexes are not reported, types of ordinary indexes, block overheads.
SYSTEM_OWNERS = ["SYS", "DVSYS", "MDSYS", "XDB"]
INDEX_TYPES = [1, 4, 6]
# Positions per slice of a column list.
LIST_SLICE = 4096
BLOCK_HEADER, SLOT_BYTES, LEAST_ROW, INDEX_ROW_HEADER, TABLE_HEADER = 66, 24, 11, 11, 71


def _key(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def list_slices(columns: DataFrame, keys: Sequence[str] = (), table: str = "bo#", index: str = "obj#", pos: str = "pos#",
                column: str = "intcol#") -> DataFrame:
    """(keys, table, member, slice, cols, carried, head, n, end): the lists, a row for each slice of at most LIST_SLICE positions.

    ``cols`` holds the slice's columns in order, as far as the list's positions run from 1 without a gap or a repeat; nothing behind that can
    lead or follow another list. ``carried`` is a hash of the slices before. ``n`` is the length of a list whose positions are 1..n, else NULL. The
    first row of a list is its ``head``; ``end`` is the last one of a list that may lead others: one with a length and without NULL columns.
    """
    owner = [*keys, table]
    width = LIST_SLICE
    entries = columns.select(
        *owner, F.col(index).alias("member"), F.floor((F.col(pos) - 1) / width).cast("int").alias("slice"),
        F.struct(F.col(pos).cast("bigint").alias("at"), F.col(column).alias("col")).alias("entry"))
    cut = entries.groupBy(*owner, "member", "slice").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    start, size, places = F.col("slice").cast("bigint") * width, F.size("entries").cast("bigint"), F.col("entries.at")
    # The first entry that is not in its place, or shares it with the next one, ends the run.
    in_place = F.transform(places, lambda at, i: F.coalesce((at == start + i + 1) & ((i + 1 == size) | (F.get(places, i + 1) != at)), F.lit(False)))
    cut = cut.withColumn("_regular", F.coalesce(places == F.sequence(start + 1, start + size), F.lit(False)))
    run = F.when(F.col("_regular"), F.col("entries.col")).otherwise(F.slice(F.col("entries.col"), F.lit(1), (F.array_position(in_place, F.lit(False)) - 1).cast("int")))
    cut = cut.select(
        *owner, "member", "slice", run.alias("cols"), "_regular", (F.col("_regular") & (size == width)).alias("_complete"), size.alias("_size"),
        F.array_max(places).alias("_last"), F.exists("entries.col", lambda c: c.isNull()).alias("_null")).withColumn("_hash", _key("slice", "cols"))
    earlier = W.partitionBy(*owner, "member").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*owner, "member").orderBy("slice").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    linked = cut.select(
        *owner, "member", "slice", "cols", F.coalesce(F.bit_xor("_hash").over(earlier), F.lit(0).cast("bigint")).alias("carried"),
        F.count(F.lit(1)).over(earlier).alias("_before"), F.coalesce(F.min("_complete").over(earlier), F.lit(True)).alias("_full"), F.max("slice").over(whole).alias("_end"),
        (F.min("_regular").over(whole) & (F.min("slice").over(whole) >= 0)).alias("_regular"), F.sum("_size").over(whole).alias("_count"),
        F.max("_last").over(whole).alias("_last"), F.max("_null").over(whole).alias("_null"))
    n = F.when(F.col("_regular") & (F.col("_count") == F.col("_last")), F.col("_count"))
    opened = F.coalesce(F.col("_full") & (F.col("slice") == F.col("_before")), F.lit(False))
    return linked.select(
        *owner, "member", "slice", F.when(opened, F.col("cols")).otherwise(F.slice("cols", 1, 0)).alias("cols"), "carried", (F.col("_before") == 0).alias("head"),
        n.alias("n"), (n.isNotNull() & ~F.col("_null") & (F.col("slice") == F.col("_end"))).alias("end"))


def _confirmed(firsts: DataFrame, lists: DataFrame, owner: Sequence[str], folder: str) -> DataFrame:
    """(owner, first, other, n, same): lists with a prefix of the first's length and hash, and whether slice by slice it is the first's list.
    ``n`` is the other's length. ``firsts``: (_key, owner, first, need)."""
    place = (F.col("slice").cast("bigint") * LIST_SLICE + F.col("_i") + 1).alias("need")
    prefixes = lists.select(*owner, "member", "slice", "cols", "carried", F.posexplode("cols").alias("_i", "_col")).select(
        _key(*owner, place, "carried", F.slice("cols", F.lit(1), F.col("_i") + 1)).alias("_key"), place, F.col("member").alias("other"))
    # Small files unpack to far more memory, so neither side of these joins is sent to the driver whatever its size on disk.
    found = firsts.hint("merge").join(prefixes, ["_key", "need"]).filter("first <> other").drop("_key")
    found = saved(found, "lists", f"{folder}/found-{uuid.uuid4().hex}")
    model = lists.select(*owner, F.col("member").alias("first"), F.col("slice").alias("_slice"), F.col("cols").alias("_cols"))
    against = lists.select(*owner, F.col("member").alias("other"), "slice", "cols", "n")
    # As a difference the slices are no join key: both joins deal out the lists alike, and Spark does it once.
    both = found.hint("merge").join(model, [*owner, "first"]).filter(F.size("_cols") > 0).hint("merge").join(against, [*owner, "other"]).filter(F.col("slice") - F.col("_slice") == 0)
    fits = F.slice("cols", F.lit(1), F.size("_cols")) == F.col("_cols")
    return both.groupBy(*owner, "first", "other", "need").agg(F.sum(F.when(fits, F.size("_cols")).otherwise(0)).alias("_equal"), F.first("n").alias("n")).select(
        *owner, "first", "other", "n", "need", (F.col("_equal") == F.col("need")).alias("same"))


@dataclass(frozen=True)
class ListRelations:
    """Lists of tables and which lead which; both are stored."""

    #: As ``list_slices`` returns it.
    lists: DataFrame
    #: (keys, table, first, other, equal): the other list is equal to the first or begins with it. Of equal lists the one with the smallest id is first.
    leads: DataFrame
    owner: tuple[str, ...]


def list_relations(columns: DataFrame, keys: Sequence[str] = (), table: str = "bo#", index: str = "obj#", pos: str = "pos#",
                   column: str = "intcol#") -> ListRelations:
    """Compares the lists of each table: first by a hash of the whole list that meets the same hash of a prefix, then entry by entry.

    The columns are read once. Of lists with equal hashes the one with the smallest id stands for all, so rows are at most the entries, however many
    lists are equal. One that differs after all (two lists with the same hash) is compared on its own.
    """
    owner, spark = (*keys, table), columns.sparkSession
    folder = shared_folder(spark, "lists")
    lists = saved(list_slices(columns, keys, table, index, pos, column), "lists", f"{folder}/slices")
    ends = lists.filter("end").select(_key(*owner, "n", "carried", "cols").alias("_key"), *owner, "member", F.col("n").alias("need"))
    # Stored, so that the join reads plain shuffles and Spark can split a prefix that very many lists share.
    firsts = saved(ends.groupBy("_key", *owner, "need").agg(F.min("member").alias("first")), "lists", f"{folder}/firsts")
    found = saved(_confirmed(firsts, lists, owner, folder), "lists", f"{folder}/compared")
    equal = (F.col("n") == F.col("need")).alias("equal")
    leads = found.filter("same").select(*owner, "first", "other", F.coalesce(equal, F.lit(False)).alias("equal"))
    differing = found.filter("not same and n = need").select(*owner, F.col("other").alias("member")).distinct()
    if not differing.isEmpty():
        more = _confirmed(ends.join(differing, [*owner, "member"]).withColumnRenamed("member", "first"), lists, owner, folder).filter("same")
        more = saved(more.select(*owner, "first", "other", F.coalesce(equal, F.lit(False)).alias("equal")), "lists", f"{folder}/more")
        follower = more.filter("equal and first < other").groupBy(*owner, "other").agg(F.min("first").alias("first")).withColumn("equal", F.lit(True))
        longer = more.filter("not equal").join(follower.select(*owner, F.col("other").alias("first")), [*owner, "first"], "left_anti")
        leads = leads.unionByName(follower.select(leads.columns)).unionByName(longer.select(leads.columns))
    return ListRelations(lists, leads, owner)


def list_classes(compared: ListRelations) -> DataFrame:
    """(keys, table, member, class_id, n): lists of a table that are equal share the smallest of their ids. ``n`` is the length, NULL where
    positions are not 1..n: such a list is a class of its own."""
    owner = compared.owner
    followers = compared.leads.filter("equal").select(*owner, F.col("other").alias("member"), "first")
    return compared.lists.filter("head").select(*owner, "member", "n").hint("merge").join(followers, [*owner, "member"], "left").select(
        *owner, "member", F.coalesce("first", "member").alias("class_id"), "n")


def class_prefixes(compared: ListRelations) -> DataFrame:
    """(keys, table, class_id, longer): the class's list leads the longer list of another class."""
    owner = compared.owner
    followers = compared.leads.filter("equal").select(*owner, F.col("other").alias("longer"))
    return compared.leads.filter("not equal").select(*owner, F.col("first").alias("class_id"), F.col("other").alias("longer")).hint("merge").join(
        followers, [*owner, "longer"], "left_anti")


def redundant_classes(columns: DataFrame, keys: Sequence[str] = (), table: str = "bo#", index: str = "obj#", pos: str = "pos#",
                      column: str = "intcol#") -> DataFrame:
    """One row per list: its class, the class's size, and how many classes and lists of them it leads.

    A list is redundant if its class has another member or leads a longer list. Rows grow with the lists, not with the
    pairs among equal ones.
    """
    owner = [*keys, table]
    compared = list_relations(columns, keys, table, index, pos, column)
    classes = list_classes(compared)
    sizes = classes.groupBy(*owner, "class_id").agg(F.count(F.lit(1)).alias("class_size"))
    led = class_prefixes(compared).join(sizes.withColumnsRenamed({"class_id": "longer", "class_size": "_size"}), [*owner, "longer"])
    led = led.groupBy(*owner, "class_id").agg(F.count(F.lit(1)).alias("covering_classes"), F.sum("_size").alias("covering_lists"))
    zero = F.lit(0).cast("bigint")
    return classes.drop("n").join(sizes, [*owner, "class_id"]).join(led, [*owner, "class_id"], "left").select(
        *owner, "member", "class_id", "class_size", F.coalesce("covering_classes", zero).alias("covering_classes"), F.coalesce("covering_lists", zero).alias("covering_lists"))


def redundant_prefixes(columns: DataFrame, candidates: DataFrame | None = None, keys: Sequence[str] = (),
                       table: str = "bo#", index: str = "obj#", pos: str = "pos#",
                       column: str = "intcol#") -> DataFrame:
    """Pairs (redundant, sufficient): the first index's list leads the second's, on one table.

    Two equal lists report each other. ``candidates`` (keys, index) limits the redundant side. A list
    whose positions are not 1..n is never redundant. Lists are compared with one list of each class of equal ones
    (``list_relations``) and pairs written out for its members last.
    """
    owner = [*keys, table]
    leads = list_relations(columns, keys, table, index, pos, column).leads.withColumnRenamed("first", "class_id")
    followers = leads.filter("equal").select(*owner, "class_id", F.col("other").alias("redundant"))
    short = leads.select(*owner, "class_id", F.col("class_id").alias("redundant")).distinct().unionByName(followers)
    if candidates is not None:
        wanted = candidates.select(*keys, F.col(index).alias("redundant"))
        short = short.hint("merge").join(wanted, [*keys, "redundant"], "left_semi")
    several = followers.select(*owner, "class_id", F.col("class_id").alias("sufficient")).distinct()
    enough = leads.select(*owner, "class_id", F.col("other").alias("sufficient")).unionByName(several)
    return short.hint("merge").join(enough, [*owner, "class_id"]).filter("redundant <> sufficient").select(*owner, "redundant", "sufficient")


def object_names(objects: DataFrame, owners: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, obj#, owner#, owner, object name) of dictionary objects."""
    user = owners.select(*keys, F.col("user#").alias("owner#"), F.col("name").alias("owner_name"))
    return objects.select(*keys, "obj#", "owner#", F.col("name").alias("object_name")).join(user, [*keys, "owner#"])


def full_name(owner: str = "owner_name", name: str = "object_name") -> Column:
    return concat_nn(F.col(owner), F.lit("."), F.col(name))


def redundant_indexes(columns: DataFrame, indexes: DataFrame, objects: DataFrame, owners: DataFrame,
                      keys: Sequence[str] = ()) -> DataFrame:
    """Names of redundant and sufficient indexes; unique indexes and system owners are left out."""
    named = object_names(objects, owners, keys)
    plain = indexes.filter(F.col("property").bitwiseAND(1) == 0).select(*keys, "obj#")
    users = named.filter(~F.col("owner_name").isin(SYSTEM_OWNERS)).select(*keys, "obj#")
    pairs = redundant_prefixes(columns, plain.join(users, [*keys, "obj#"]), keys)
    first = named.select(*keys, F.col("obj#").alias("redundant"), full_name().alias("redundant_index"))
    second = named.select(*keys, F.col("obj#").alias("sufficient"), full_name().alias("sufficient_index"))
    return (
        pairs.join(first, [*keys, "redundant"])
        .join(second, [*keys, "sufficient"])
        .select(*keys, "redundant_index", "sufficient_index")
    )


def usable_bytes(block: Column, initrans: Column) -> Column:
    """Bytes of a block left for rows."""
    return (block - BLOCK_HEADER - initrans * SLOT_BYTES).cast("double")


def row_bytes(average: Column) -> Column:
    """Bytes a row takes in a block."""
    return F.greatest(average + 2, F.lit(LEAST_ROW)).cast("double")


def rows_per_block(usable: Column, row: Column) -> Column:
    return F.floor(F.try_divide(usable, row))


def spare_percent(usable: Column, row: Column, fewer: int) -> Column:
    """Percent of a block left free when it holds ``fewer`` rows than fit, but at least one."""
    kept = F.greatest(rows_per_block(usable, row) - fewer, F.lit(1))
    return F.ceil(F.try_divide((usable - kept * row) * 100, usable))


def index_density(rows: Column, width: Column, leaves: Column, usable: Column) -> Column:
    """Percent of the leaf space that entries need; ``width`` is the sum of column lengths plus one each."""
    return F.try_divide(rows * (width + INDEX_ROW_HEADER) * 100, leaves * usable)


def extra_blocks(rows: Column, width: Column, leaves: Column, usable: Column, free: Column) -> Column:
    """Leaf blocks beyond need; one division, so whole results stay whole."""
    surplus = (F.lit(100) - free) * leaves * usable - rows * (width + INDEX_ROW_HEADER) * 100
    return F.floor(F.try_divide(surplus, usable * 100))


def is_sparse(rows: Column, width: Column, leaves: Column, usable: Column, free: Column) -> Column:
    """Entries fill less than half of what the free-space setting allows, and blocks are to gain."""
    thin = rows * (width + INDEX_ROW_HEADER) * 50 < leaves * usable * (F.lit(50) - free)
    return thin & (extra_blocks(rows, width, leaves, usable, free) > 0)


def low_density_indexes(indexes: DataFrame, columns: DataFrame, column_stats: DataFrame, objects: DataFrame,
                        owners: DataFrame, block_size: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sparse indexes with density and superfluous blocks, most blocks first."""
    kept = indexes.filter((F.col("leafcnt") > 1) & F.col("type#").isin(INDEX_TYPES)).select(
        *keys, "obj#", "bo#", "rowcnt", "leafcnt", "initrans", "pctfree$"
    )
    stats = column_stats.select(*keys, F.col("obj#").alias("bo#"), "intcol#", "avgcln")
    widths = (
        columns.select(*keys, "obj#", "bo#", "intcol#")
        .join(stats, [*keys, "bo#", "intcol#"])
        .groupBy(*keys, "obj#")
        .agg(F.sum(F.col("avgcln") + 1).alias("width"))
    )
    sized = with_value(kept.join(widths, [*keys, "obj#"]), block_size, "value", "block", keys)
    measured = sized.withColumn("usable", usable_bytes(F.col("block"), F.col("initrans")))
    part = (F.col("rowcnt"), F.col("width"), F.col("leafcnt"), F.col("usable"))
    named = object_names(objects, owners, keys).filter(F.col("owner#") != 0)
    density = F.concat(F.substring(number_text(index_density(*part), 3, 2), 2, 100), F.lit("%"))
    return (
        measured.filter(is_sparse(*part, F.col("pctfree$")))
        .join(named, [*keys, "obj#"])
        .select(
            *keys, full_name().alias("index_name"), density.alias("density"),
            extra_blocks(*part, F.col("pctfree$")).alias("extra_blocks"),
            index_density(*part).alias("density_pct"),
        )
        .orderBy(F.col("extra_blocks").desc_nulls_first(), F.col("density").asc_nulls_last())
    )


def _table_base(tables: DataFrame, block_size: DataFrame, keys: Sequence[str]) -> DataFrame:
    sized = with_value(tables.filter(F.col("tab#").isNull()), block_size, "value", "block", keys)
    measured = sized.withColumns({
        "usable": usable_bytes(F.col("block"), F.col("initrans")), "row": row_bytes(F.col("avgrln")),
    })
    return measured.withColumn("fit", rows_per_block(F.col("usable"), F.col("row")))


def migration_settings(free: Column, usable: Column, row: Column) -> dict[str, Column]:
    """Free/used settings and rows per block that stop rows from migrating."""
    return {
        "new_free": F.lit(1) + F.greatest(free, spare_percent(usable, row, 1)),
        "new_used": F.lit(98) - F.greatest(free, spare_percent(usable, row, 2)),
        "minimize": rows_per_block(usable, row),
    }


def longest_rows(columns: DataFrame, keys: Sequence[str] = (), table: str = "obj#",
                 length: str = "length") -> DataFrame:
    """Largest possible row per table; tables with a column of unbounded length are left out."""
    summed = columns.groupBy(*keys, table).agg(F.sum(length).alias("max_row"), F.min(length).alias("_least"))
    return summed.filter(F.col("_least") > 0).drop("_least")


def migrated_rows(tables: DataFrame, columns: DataFrame, objects: DataFrame, owners: DataFrame,
                  block_size: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Tables with migrated rows and the settings that would avoid them, most rows first."""
    base = _table_base(tables.filter((F.col("chncnt") > 0) & (F.col("rowcnt") > 0)), block_size, keys)
    fits = F.col("max_row") < F.col("block") - (F.col("initrans") * SLOT_BYTES + TABLE_HEADER)
    kept = base.join(longest_rows(columns, keys), [*keys, "obj#"]).filter(fits)
    named = object_names(objects, owners, keys).filter(F.col("owner#") != 0)
    share = F.try_divide(F.col("chncnt") * 100, F.col("rowcnt"))
    settings = migration_settings(F.col("pctfree$"), F.col("usable"), F.col("row"))
    return (
        kept.join(named, [*keys, "obj#"])
        .select(
            *keys, full_name().alias("table_name"), F.col("chncnt").alias("mrows"),
            F.concat(number_text(share, 4, 2), F.lit("%")).alias("migration"),
            *[c.alias(n) for n, c in settings.items()], share.alias("migration_pct"),
        )
        .orderBy(F.col("mrows").desc_nulls_first())
    )


def wasted_reads(blocks: Column, rows: Column, fit: Column, multiblock: Column) -> Column:
    """Multi-block reads that dense storage would save."""
    return F.ceil(F.try_divide(blocks - F.try_divide(rows, fit), multiblock))


def table_density(tables: DataFrame, objects: DataFrame, owners: DataFrame, block_size: DataFrame,
                  multiblock_reads: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sparsely filled tables: density, new settings, wasted reads."""
    sparse = tables.filter((F.col("chncnt") == 0) & (F.col("avgspc") > F.col("avgrln")))
    base = with_value(_table_base(sparse, block_size, keys), multiblock_reads, "value", "reads", keys)
    wasted = wasted_reads(F.col("blkcnt"), F.col("rowcnt"), F.col("fit"), F.col("reads"))
    kept = base.filter(F.col("blkcnt") > F.col("reads")).withColumn("reads_wasted", wasted)
    named = object_names(objects, owners, keys).filter(F.col("owner#") != 0)
    density = F.try_divide(F.col("rowcnt") * 100, F.col("fit") * F.col("blkcnt"))
    degree = F.when(F.col("degree") == 32767, "DEFAULT").otherwise(
        F.coalesce(F.col("degree"), F.lit(1)).cast("string")
    )
    return (
        kept.filter(F.col("reads_wasted") > 0)
        .join(named, [*keys, "obj#"])
        .select(
            *keys, full_name().alias("table_name"), F.lpad(degree, 7, " ").alias("degree"),
            F.concat(F.substring(number_text(density, 3, 2), 2, 100), F.lit("%")).alias("density"),
            F.lit(1).alias("new_free"),
            (F.lit(99) - spare_percent(F.col("usable"), F.col("row"), 1)).alias("new_used"),
            "reads_wasted", density.alias("density_pct"),
        )
        .orderBy("table_name", F.col("new_used").desc_nulls_first(), "degree")
    )
