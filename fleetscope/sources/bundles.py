"""Bundles: one tar.gz of CSV sections per database.

Reading lists the archives, opens each by its path on an executor and reads it as a stream, member after member; rows leave
in Arrow batches and columns are typed on the JVM. An archive is never held, whatever its size. A gzip stream can only be read from its start,
so one archive is one task. ``ingest_bundles`` therefore reads every archive once and stores all sections as Parquet, and
``write_bundles`` cuts a large bundle into several archives of the same ``bundle_id``.
"""

from __future__ import annotations

import csv
import gzip
import io
import os
import sys
import tarfile
import uuid
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce
from typing import BinaryIO

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fleetscope.session import mounted_path
from fleetscope.sources.schemas import schema_of

# The functions below travel to the executors with their code, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_ROWS = 4096
LONGEST_CELL = 2**31 - 1  # what an Arrow string can hold
CELLS = pa.schema([
    ("bundle_id", pa.string()), ("section", pa.string()), ("row_no", pa.int64()),
    ("cells", pa.map_(pa.string(), pa.string())),
])
CELLS_DDL = "bundle_id STRING, section STRING, row_no BIGINT, cells MAP<STRING, STRING>"
CSV_OPTIONS = {
    "quoteAll": "true", "escape": '"', "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSS",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSS", "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def section_of_member(member: str) -> str | None:
    """``x.csv`` and ``./x.csv`` (and a bare ``x``) name section ``x``."""
    name = member.removeprefix("./")
    return None if "/" in name or not name else name.removesuffix(".csv")


def _rows(stream: BinaryIO, wanted: frozenset[str] | None) -> Iterator[tuple[str, int, list[tuple[str, str]]]]:
    csv.field_size_limit(LONGEST_CELL)  # statement texts exceed the module's own limit of 131,072
    with tarfile.open(fileobj=stream, mode="r|gz") as archive:
        for member in archive:
            archive.members = []  # else the list of members grows with the archive
            section = section_of_member(member.name)
            if not member.isfile() or section is None or (wanted is not None and section not in wanted):
                continue
            # Members are read front to back; a text wrapper would ask the stream to seek.
            lines = csv.reader(line.decode("utf-8") for line in archive.extractfile(member))
            header = [h.strip().lower() for h in next(lines, [])]
            for number, cells in enumerate(lines):
                if cells:
                    yield section, number, [(h, c) for h, c in zip(header, cells) if c != ""]


def _open(place: str | bytes) -> BinaryIO:
    """An archive by its path, or its content where only Spark's readers reach it."""
    if isinstance(place, bytes):
        return io.BytesIO(place)
    return open("/" + place.removeprefix("file:").lstrip("/"), "rb")


def _explode(wanted: frozenset[str] | None):
    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, place in zip(batch["bundle_id"].to_pylist(), batch["place"]):
                columns: list[list] = [[], [], [], []]
                with _open(place.as_py()) as stream:
                    for section, number, cells in _rows(stream, wanted):
                        for column, item in zip(columns, (bundle, section, number, cells)):
                            column.append(item)
                        if len(columns[0]) == BATCH_ROWS:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, type=f.type) for c, f in zip(columns, CELLS)], schema=CELLS)
                            columns = [[], [], [], []]
                if columns[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(columns, CELLS)], schema=CELLS)

    return explode


def bundle_cells(spark: SparkSession, path: str, sections: Iterable[str] | None = None) -> DataFrame:
    """Rows (bundle_id, section, row_no, cells) of all bundles under ``path``; empty cells are absent, other sections are skipped in the stream.

    Spark lists the archives and deals them out by size. On a mounted path each task opens its archives itself and memory doesn't grow with
    them. In another store only Spark's reader reaches them: there an archive passes through one cell, which ends at 2 GB.
    """
    wanted = None if sections is None else frozenset(sections)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path)
    place = F.col("content") if mounted_path(path) is None else F.col("path")
    named = files.select(F.regexp_extract("path", r"([^/]+?)(?:\.part-[^/]*)?\.tar\.gz$", 1).alias("bundle_id"), place.alias("place"))
    return named.mapInArrow(_explode(wanted), CELLS_DDL)


# Other names under which bundles carry a column.
ALIASES = {"stat_name": ("latch_name", "event_name", "state_name")}


def _cell(name: str) -> Column:
    return F.coalesce(*[F.col("cells")[n] for n in (name, *ALIASES.get(name, ()))])


def _typed(cell: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return cell
    if isinstance(kind, T.IntegralType):
        # Whole numbers may arrive as 5.0 where the writer's column had gaps.
        return cell.try_cast("decimal(38,6)").try_cast(kind)
    return cell.try_cast(kind)


#: Column with the cells that don't parse, by column name.
REJECTS = "rejects"


def typed_section(cells: DataFrame, section: str, extra: bool = False, rejects: bool = False) -> DataFrame:
    """One section with its fixed schema plus ``bundle_id``; no rows give an empty typed table.

    ``extra`` keeps columns outside the schema in a map. A cell that is no value of its column's type is NULL; ``rejects`` keeps its text in a map by
    column, empty where all cells parse, so that nothing is lost in silence (``rejected_cells`` lists them).
    """
    schema = schema_of(section)
    columns = [_typed(_cell(f.name), f.dataType).alias(f.name) for f in schema.fields]
    if extra:
        known = [n for f in schema.fields for n in (f.name, *ALIASES.get(f.name, ()))]
        columns.append(F.map_filter("cells", lambda k, _: ~k.isin(known)).alias("extra"))
    if rejects:
        typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
        odd = [F.when(_cell(f.name).isNotNull() & _typed(_cell(f.name), f.dataType).isNull(), F.struct(F.lit(f.name), _cell(f.name))) for f in typed]
        columns.append((F.map_from_entries(F.array_compact(F.array(*odd))) if odd else F.create_map().cast("map<string,string>")).alias(REJECTS))
    return cells.filter(F.col("section") == section).select("bundle_id", *columns)


def rejected_cells(section: DataFrame) -> DataFrame:
    """(bundle_id, column, cell) of every cell of a section, read with ``rejects``, that does not parse."""
    return section.select("bundle_id", F.explode(REJECTS).alias("column", "cell"))


def read_bundle_section(spark: SparkSession, path: str, section: str, extra: bool = False, rejects: bool = False) -> DataFrame:
    """One section of all bundles under ``path``; other members are skipped inside the archive."""
    return typed_section(bundle_cells(spark, path, [section]), section, extra, rejects)


def ingest_bundles(spark: SparkSession, path: str, out: str) -> None:
    """Read every bundle once and store all members as Parquet, one folder per section; unknown ones keep their name."""
    cells = bundle_cells(spark, path)
    cells.hint("rebalance", "section").write.mode("overwrite").partitionBy("section").parquet(out)


def read_ingested(spark: SparkSession, out: str, section: str, extra: bool = False, rejects: bool = False) -> DataFrame:
    """One section of an ingested fleet; reads that section's folder only."""
    return typed_section(spark.read.schema(CELLS_DDL).parquet(out), section, extra, rejects)


def csv_line(df: DataFrame, skip: Iterable[str] = ("bundle_id",)) -> Column:
    columns = [c for c in df.columns if c not in set(skip)]
    return F.to_csv(F.struct(*columns), CSV_OPTIONS)


def csv_header(df: DataFrame, skip: Iterable[str] = ("bundle_id",)) -> str:
    return ",".join(f'"{c}"' for c in df.columns if c not in set(skip))


def section_lines(sections: Mapping[str, DataFrame], part_bytes: int) -> DataFrame:
    """All sections as text rows (bundle_id, part, section, place, size, line).

    Place 0 is the CSV header with the member's size in bytes, place 1 a data line. Sections of up to
    ``part_bytes`` share the bundle's archive (part ''); a larger one is cut by line hash into
    slices, each a part of its own.
    """
    data = reduce(DataFrame.unionByName, [
        df.select("bundle_id", F.lit(name).alias("section"), csv_line(df).alias("line"))
        for name, df in sections.items()
    ])
    member = ["bundle_id", "section"]
    bytes_of = F.sum(F.octet_length("line") + 1)
    slices = data.groupBy(*member).agg(F.ceil(bytes_of / part_bytes).cast("int").alias("slices"))
    number = F.pmod(F.xxhash64("line"), F.col("slices"))
    part = F.when(F.col("slices") > 1, F.concat_ws("-", F.lit(".part"), F.col("section"), number)).otherwise("")
    placed = data.join(slices, member).select("bundle_id", part.alias("part"), "section", "line")
    headers = F.create_map(*[F.lit(x) for name, df in sections.items() for x in (name, csv_header(df))])
    heads = placed.groupBy("bundle_id", "part", "section").agg(bytes_of.alias("size")).withColumn(
        "line", headers[F.col("section")])
    heads = heads.withColumn("size", F.col("size") + F.octet_length("line") + 1)
    columns = ["bundle_id", "part", "section", "place", "size", "line"]
    return heads.withColumn("place", F.lit(0)).select(columns).unionByName(
        placed.withColumns({"place": F.lit(1), "size": F.lit(0).cast("bigint")}).select(columns)
    )


def _pad(written: int, block: int) -> bytes:
    return b"\0" * (-written % block)


def _archive(folder: str):
    """Stream sorted text rows into one archive per bundle; memory does not grow with the bundle."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, out, hidden, member = None, None, "", (0, 0)
        finished: list[tuple[str, str]] = []

        def close_member() -> None:
            size, written = member
            if written != size:
                raise ValueError(f"bundle {bundle}: a member has {written} bytes instead of {size}")
            out.write(_pad(written, tarfile.BLOCKSIZE))

        def close_bundle() -> None:
            if out is None:
                return
            close_member()
            out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
            out.close()
            # Renaming last makes a repeated task replace the archive as a whole.
            target = os.path.join(folder, f"{bundle[0]}{bundle[1]}.tar.gz")
            os.replace(hidden, target)
            finished.append((bundle[0], target))

        for batch in batches:
            for name, part, section, place, size, line in zip(*[c.to_pylist() for c in batch.columns]):
                if (name, part) != bundle:
                    close_bundle()
                    bundle = (name, part)
                    hidden = os.path.join(folder, f".{name}{part}.{uuid.uuid4().hex}")
                    out, member = gzip.open(hidden, "wb"), (0, 0)
                if place == 0:
                    close_member()
                    info = tarfile.TarInfo(f"{section}.csv")
                    info.size = size
                    out.write(info.tobuf(tarfile.GNU_FORMAT))
                    member = (size, 0)
                data = line.encode("utf-8") + b"\n"
                out.write(data)
                member = (member[0], member[1] + len(data))
        close_bundle()
        if finished:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in finished]), pa.array([f[1] for f in finished])], names=["bundle_id", "path"])

    return write


def write_bundles(sections: Mapping[str, DataFrame], folder: str, part_bytes: int = 256 << 20) -> DataFrame:
    """Write tar.gz archives per ``bundle_id`` and return (bundle_id, path) of each.

    ``folder`` must be a mounted path that all executors share. Rows pass through a task as a
    sorted stream, one archive after the other. A section above ``part_bytes`` goes to archives of
    its own, named ``<bundle>.part-<section>-<n>.tar.gz``, so a large bundle is written by many
    tasks; reading puts the parts together again. The sections must give the same rows each time
    they are evaluated, since sizes precede contents; a mismatch raises.
    """
    os.makedirs(folder, exist_ok=True)
    rows = section_lines(sections, part_bytes).repartition("bundle_id", "part").sortWithinPartitions(
        "bundle_id", "part", "section", "place")
    return rows.mapInArrow(_archive(folder), "bundle_id STRING, path STRING")
