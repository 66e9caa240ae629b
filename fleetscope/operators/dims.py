"""Joins of facts with dimensions and one-row relations.

No join here carries a broadcast hint. Spark broadcasts a side only when its estimated or
measured size is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise falls back to a
shuffled join, so a dimension that grows with the fleet stays safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The row that stands for the whole container database.
WHOLE_DATABASE = (0, "Entire CDB")


def with_value(df: DataFrame, one_row: DataFrame, column: str, alias: str, keys: Sequence[str] = (),
               required: bool = True) -> DataFrame:
    """Add ``alias`` from a relation that holds one row, or one row per ``keys``.

    Without keys the value is a scalar subquery, evaluated once and inlined; with keys it is an
    equi-join. ``required`` drops rows for which the relation has no value.
    """
    if keys:
        side = one_row.select(*keys, F.col(column).alias(alias))
        out = df.join(side, list(keys), "left")
    else:
        out = df.withColumn(alias, one_row.select(column).scalar())
    return out.filter(F.col(alias).isNotNull()) if required else out


def equal_to_value(df: DataFrame, column: str, one_row: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose ``column`` equals the value of a one-row relation (per ``keys``)."""
    if keys:
        return df.join(one_row.select(*keys, column), [*keys, column], "left_semi")
    return df.filter(F.col(column) == one_row.select(column).scalar())


def with_whole_database(containers: DataFrame, id_column: str = "con_id", name_column: str = "name",
                        row: tuple = WHOLE_DATABASE) -> DataFrame:
    """Tenant dimension plus the literal row for the whole database, once per other key."""
    others = [c for c in containers.columns if c not in (id_column, name_column)]
    keys = [c for c in others if c == "bundle_id"]
    types = {f.name: f.dataType for f in containers.schema.fields}
    literal = [F.lit(row[0]).cast(types[id_column]).alias(id_column),
               F.lit(row[1]).cast(types[name_column]).alias(name_column)]
    if keys:
        extra = containers.select(*keys).distinct().select(*keys, *literal)
    else:
        extra = containers.sparkSession.range(1).select(*literal)
    return containers.unionByName(extra, allowMissingColumns=True)


def join_tenant(df: DataFrame, containers: DataFrame, keys: Sequence[str] = ("con_id",),
                name_column: str = "name", tenant: str | None = None,
                tenant_name: str | None = None) -> DataFrame:
    """Inner join with the tenant dimension; ``tenant`` keeps one tenant by name.

    The name arrives as ``tenant_name``, or as ``name_column`` when the fact has no such column.
    """
    out_name = tenant_name or (name_column if name_column not in df.columns else f"tenant_{name_column}")
    side = containers.select(*keys, F.col(name_column).alias(out_name))
    if tenant not in (None, "All"):
        side = side.filter(F.col(out_name) == tenant)
    return df.join(side, list(keys), "inner")


def left_join_many(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left outer join in which one key may hold very many rows of the right side.

    A left join cannot split a hot key of its right side over several tasks; an inner join can.
    So matches come from an inner join and the rest from an anti join with the distinct keys.
    """
    matched = left.join(right, list(keys), "inner")
    alone = left.join(right.select(*keys).distinct(), list(keys), "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def sorted_by(df: DataFrame, *order: Column | str, ordered: bool = True) -> DataFrame:
    """Sort for display. The remaining columns break ties, so equal keys spread over partitions.

    ``ordered=False`` leaves the global sort out where a report is stored, not shown.
    """
    if not ordered:
        return df
    named = {o for o in order if isinstance(o, str)}
    ties = [f.name for f in df.schema.fields if f.name not in named and f.dataType.typeName() not in ("map", "variant")]
    return df.orderBy(*order, *[F.col(f"`{c}`") for c in ties])


def filter_equal(df: DataFrame, column: str, value: str | None, everything: str = "ALL") -> DataFrame:
    """Keep rows with ``column == value``; ``everything`` (any case) or None keeps all rows."""
    if value is None or value.upper() == everything.upper():
        return df
    return df.filter(F.col(column) == value)


def at_latest(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows at the latest value of ``column`` (per ``keys``)."""
    if keys:
        latest = df.groupBy(*keys).agg(F.max(column).alias(column))
        return df.join(latest, [*keys, column], "left_semi")
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())


def major_version(version: Column) -> Column:
    """Leading number of a dotted version text; NULL when it is not a number."""
    return F.split(version, r"\.")[0].try_cast("int")
