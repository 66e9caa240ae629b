"""Memory components: a list from four sources, classified by rules, with advisory status."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.functions.nulls import substr_nn
from fleetscope.operators.classify import first_match, words_capitalised
from fleetscope.operators.dims import with_value
from fleetscope.operators.forest import forest
from fleetscope.operators.subtree import subtree_sums

MB = 1048576

# Texts, limits and ordered patterns of the memory report.
READS = "Relative Change in physical reads"
LOADS = "Relative change in parse time loadings"
HITS = "Cache hit percentage"
PGA = "PGA Aggregate Target"
BUFFERS, VARIABLE = "Database Buffers", "Variable"
NAMED_POOLS = ["shared pool", "large pool", "java pool", "streams pool"]
AUTO_POOLS = ["Shared Pool", "Java Pool", "Large Pool"]
PARENT_GROUPS = [("Fixed", "1"), ("Variable", "2"), ("Database Buffers", "3"), ("Redo Buffers", "4"), (PGA, "5")]
# pattern, second group, advice factor, parameter, default order
COMPONENT_RULES = [
    ("% 2k%", "1", READS, "db_2k_cache_size", 6),
    ("%4k%", "2", READS, "db_4k_cache_size", 7),
    ("%8k%", "3", READS, "db_8k_cache_size", 8),
    ("%16k%", "4", READS, "db_16k_cache_size", 9),
    ("%32k%", "5", READS, "db_32k_cache_size", 10),
    ("%Keep%", "6", READS, "db_keep_cache_size", 4),
    ("%Recycle%", "7", READS, "db_recycle_cache_size", 5),
    ("%Shared%", "1", LOADS, "shared_pool_size", 1),
    ("%Large%", "2", None, "large_pool_size", None),
    ("%Java%", "3", LOADS, "java_pool_size", 11),
    ("%Streams%", "4", None, "streams_pool_size", None),
    ("%Other%", "5", None, None, None),
    ("%Free%", "6", None, None, None),
    ("%PGA%", None, HITS, "pga_aggregate_target", 3),
    (BUFFERS, "0", None, None, None),
    (VARIABLE, "0", None, None, None),
]
BLOCK_PATTERNS = ["% 2k%", "%4k%", "%8k%", "%16k%", "%32k%"]
DEFAULT_CACHE = ("db_cache_size", 2)
FIXED_RULES = [("Fixed%", "Y"), ("Variable:%", "Y"), ("Redo%", "Y")]
MIN_PGA, MAX_PGA, MAX_OTHER = 10, 4096 * 1024 - 1, 10 * 1024 - 1


@dataclass(frozen=True)
class MemoryInputs:
    sga: DataFrame
    components: DataFrame
    free: DataFrame
    parameter: DataFrame
    cache_advice: DataFrame
    shared_advice: DataFrame
    java_advice: DataFrame
    pga_advice: DataFrame

    def setting(self, name: str, keys: Sequence[str]) -> DataFrame:
        """One numeric setting, one row per ``keys``; instances agree on it."""
        rows = self.parameter.filter(F.col("name") == name)
        return rows.groupBy(*keys).agg(F.max(F.col("value").cast("decimal(20,0)")).alias("setting"))


def kilo_text(size: Column) -> Column:
    """``8192`` as ``8``."""
    return (size / 1024).cast("bigint").cast("string")


def default_cache_name(block: Column) -> Column:
    return F.concat(F.lit("DB Cache (Default "), kilo_text(block), F.lit("k)"))


def dynamic_name(component: Column, block: Column) -> Column:
    """Report name of a dynamically sized component."""
    short = component
    for old, new in [("DEFAULT ", ""), ("blocksize buffer cache", "cache"), ("buffer cache", "cache")]:
        short = F.replace(short, F.lit(old), F.lit(new))
    return (
        F.when(component == "DEFAULT buffer cache", default_cache_name(block))
        .when(F.instr(component, "cache") == 0, words_capitalised(component))
        .otherwise(F.concat(F.lit("DB "), words_capitalised(short)))
    )


def residual(total: DataFrame, free: DataFrame, named: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``value`` of ``total`` minus free size minus the sum of named parts (one row per ``keys``)."""
    with_free = with_value(total.select(*keys, "value"), free, "current_size", "_free", keys)
    both = with_value(with_free, named, "value_sum", "_named", keys)
    return both.select(*keys, (F.col("value") - F.col("_free") - F.col("_named")).alias("residual"))


def component_list(inputs: MemoryInputs, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct (component, size in MB, parent) rows from all sources."""
    columns = [*keys, "memory_component", "memory_size", "parent_memory_component"]
    no_parent = F.lit(None).cast("string")

    def row(df: DataFrame, name: Column, size: Column, parent: Column) -> DataFrame:
        return df.select(*keys, name.alias(columns[-3]), size.cast("double").alias(columns[-2]),
                         parent.alias(columns[-1]))

    fixed = row(inputs.sga, F.replace(F.col("name"), F.lit(" Size"), F.lit("")), F.round(F.col("value") / MB, 2),
                no_parent)
    name = F.col("component")
    sized = with_value(inputs.components, inputs.setting("db_block_size", keys), "setting", "_block", keys)
    space = F.instr(name, " ")
    block_tag = F.coalesce(substr_nn(name, space + 1, F.instr(name, "K") - space), F.lit("XX"))
    own_block = F.concat(kilo_text(F.col("_block")), F.lit("K"))
    dynamic = row(
        sized.filter((name != "OSM Buffer Cache") & (block_tag != own_block)),
        dynamic_name(name, F.col("_block")), F.col("current_size") / MB,
        F.when(F.instr(name, "cache") == 0, VARIABLE).otherwise(BUFFERS),
    )
    pga = row(inputs.setting("pga_aggregate_target", keys).filter("setting is not null"), F.lit(PGA),
              F.col("setting") / MB, no_parent)
    named = inputs.components.filter(name.isin(NAMED_POOLS)).groupBy(*keys).agg(
        F.sum("current_size").alias("value_sum"))
    left = residual(inputs.sga.filter(F.col("name") == "Variable Size"), inputs.free, named, keys)
    others = row(left, F.lit("Variable: Others"), F.round(F.col("residual") / MB, 2), F.lit(VARIABLE))
    free = row(inputs.free, F.lit("Free"), F.col("current_size") / MB, F.lit(VARIABLE))
    return fixed.union(dynamic).union(pga).union(others).union(free).distinct()


def advice_status(inputs: MemoryInputs, keys: Sequence[str] = ()) -> DataFrame:
    """(component, status): N where every advice row is flat, else Y; only with a row at factor 1."""
    def flat(column: str, *values: int) -> Column:
        return F.coalesce(F.col(column).isin(*values), F.lit(True))

    def verdict(df: DataFrame, group: Sequence[str], factor: str, is_flat: Column) -> DataFrame:
        return df.groupBy(*group).agg(
            F.every(is_flat).alias("_flat"), F.some(F.col(factor) == 1).alias("_current")
        )

    caches = verdict(inputs.cache_advice, [*keys, "name", "block_size"], "size_factor",
                     flat("estd_physical_read_factor", 1))
    caches = with_value(caches, inputs.setting("db_block_size", keys), "setting", "_block", keys)
    cache_name = (
        F.when((F.col("name") == "DEFAULT") & (F.col("block_size") == F.col("_block")),
               default_cache_name(F.col("block_size")))
        .when(F.col("name") != "DEFAULT", F.concat(F.lit("DB "), words_capitalised(F.col("name")), F.lit(" Cache")))
        .otherwise(F.concat(F.lit("DB "), kilo_text(F.col("block_size")), F.lit("k Cache")))
    )
    parts = [caches.select(*keys, cache_name.alias("memory_component"), "_flat", "_current")]
    pools = [
        ("Shared Pool", inputs.shared_advice, "shared_pool_size_factor", flat("estd_lc_load_time_factor", 1)),
        ("Java Pool", inputs.java_advice, "java_pool_size_factor", flat("estd_lc_load_time_factor", 1)),
        (PGA, inputs.pga_advice, "pga_target_factor", flat("estd_pga_cache_hit_percentage", 100, 0)),
    ]
    for name, advice, factor, is_flat in pools:
        part = verdict(advice, keys, factor, is_flat)
        parts.append(part.select(*keys, F.lit(name).alias("memory_component"), "_flat", "_current"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.union(part)
    return (
        merged.groupBy(*keys, "memory_component")
        .agg(F.some("_current").alias("_current"), F.some("_flat").alias("_flat"))
        .filter("_current")
        .select(*keys, "memory_component", F.when(F.col("_flat"), "N").otherwise("Y").alias("advice_status"))
    )


def memory_components(inputs: MemoryInputs, keys: Sequence[str] = ()) -> DataFrame:
    """The memory report: components with groups, advisory status, limits and mode."""
    name, size, parent = F.col("memory_component"), F.col("memory_size"), F.col("parent_memory_component")
    is_default = name.like("%Default%")
    of_block = F.lit(False)
    for pattern in BLOCK_PATTERNS:
        of_block = of_block | name.like(pattern)
    default_cache = of_block & is_default

    def rule(place: int) -> Column:
        return first_match(name, [(r[0], r[place]) for r in COMPONENT_RULES])

    top = first_match(name, PARENT_GROUPS)
    nested = F.when(parent == VARIABLE, "2").when(parent == BUFFERS, "3")
    listed = component_list(inputs, keys).withColumns({
        "parent_group": F.when(parent.isNull(), top).otherwise(nested),
        "second_group": rule(1),
        "hasadvisory": F.when(rule(2).isNotNull(), "Y").otherwise("N"),
        "isfixedsize": first_match(name, FIXED_RULES, "N"),
        "mc_type": first_match(name, [("PGA%", "PGA")], "SGA"),
        "factor_name": rule(2),
        "parameter": F.when(default_cache, DEFAULT_CACHE[0]).otherwise(rule(3)),
        "default_order": F.when(default_cache, DEFAULT_CACHE[1]).otherwise(rule(4)),
    })
    granule = inputs.components.groupBy(*keys).agg((F.max("granule_size") / MB).alias("granule"))
    rich = with_value(listed, granule, "granule", "_granule", keys, required=False)
    rich = with_value(rich, inputs.setting("sga_target", keys), "setting", "_target", keys, required=False)
    rich = rich.join(advice_status(inputs, keys), [*keys, "memory_component"], "left")
    advised = F.col("hasadvisory") == "Y"
    status, is_pga = F.col("advice_status"), name == PGA
    smallest = (
        F.when(name.isin("Shared Pool", "Java Pool"), size)
        .when(is_default, F.col("_granule"))
        .when(is_pga, F.lit(float(MIN_PGA)))
        .otherwise(F.lit(0.0))
    )
    return rich.withColumns({
        "collection_status": F.when(advised & (size == 0) & status.isNull(), "B")
        .when(advised & (size != 0) & (status == "N"), "N")
        .when(advised, "Y"),
        "minimum_size": F.when(advised, smallest),
        "maximum_size": F.when(advised, F.when(is_pga, MAX_PGA).otherwise(MAX_OTHER)),
        "sgamode": F.when((F.col("_target") > 0) & (name.isin(AUTO_POOLS) | is_default), "A").otherwise("M"),
    }).drop("_granule", "_target", "advice_status").orderBy(
        *keys, F.col("parent_group").asc_nulls_last(), F.col("second_group").asc_nulls_last()
    )


def memory_forest(report: DataFrame, keys: Sequence[str] = (), with_path: bool = True) -> DataFrame:
    """Components as a forest by parent name, with their size as ``value``; without paths if they aren't shown."""
    tree = forest(report, "memory_component", "parent_memory_component", keys, with_path)
    sizes = report.select(*keys, F.col("memory_component").alias("id"), F.col("memory_size").alias("value"))
    return tree.join(sizes, [*keys, "id"])


def memory_sums(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Components with the size of all below them, as a sunburst needs it; sizes in whole kilobytes."""
    sized = report.withColumn("_kb", F.round(F.col("memory_size") * 1024).cast("bigint"))
    return subtree_sums(sized, "memory_component", "parent_memory_component", "_kb", keys)


def value_range(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest value of a column (the colour scale of a chart)."""
    return df.groupBy(*keys).agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))
