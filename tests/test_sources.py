import io
import tarfile

import pytest
from pyspark.sql import functions as F

from fleetscope.plans.reports import collect_sections
from fleetscope.sources import bundles, jdbc, sinks
from fleetscope.sources.schemas import SECTIONS, schema_of
from tests.fixtures import FLEET, fleet_tables


def write_tar(path, members):
    with tarfile.open(path, "w:gz") as archive:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            data = text.encode("utf-8")
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))


def test_reading_bundles(spark, tmp_path):
    write_tar(tmp_path / "db1.tar.gz", {
        "pdb-info.csv": "CON_ID,NAME,OPEN_MODE,NOTE\n1,ROOT,,a\n3.0,\"a \"\"b\"\", c\nd\",READ WRITE,\n",
        "patch-info.csv": "ACTION_TIME,PATCH_INFO\n2024-01-02 03:04:05,first\n2024-01-02 03:04:05.678,第二\n",
    })
    write_tar(tmp_path / "db2.tar.gz", {"./pdb-info.csv": "con_id,name\n7,X\n", "sub/pdb-info.csv": "con_id\n9\n"})
    got = bundles.read_bundle_section(spark, str(tmp_path), "pdb-info", extra=True).orderBy("bundle_id", "con_id").collect()
    assert [tuple(r) for r in got] == [
        ("db1", 1, "ROOT", None, {"note": "a"}), ("db1", 3, 'a "b", c\nd', "READ WRITE", {}), ("db2", 7, "X", None, {})]
    patches = bundles.read_bundle_section(spark, str(tmp_path), "patch-info").orderBy("action_time").collect()
    assert [(str(r.action_time), r.patch_info) for r in patches] == [
        ("2024-01-02 03:04:05", "first"), ("2024-01-02 03:04:05.678000", "第二")]
    missing = bundles.read_bundle_section(spark, str(tmp_path), "user-privs")
    assert missing.count() == 0 and missing.columns[0] == "bundle_id"
    bundles.ingest_bundles(spark, str(tmp_path), str(tmp_path / "fleet"))
    again = bundles.read_ingested(spark, str(tmp_path / "fleet"), "pdb-info")
    assert again.count() == 3
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(section" in plan


def test_long_cells_and_unknown_members(spark, tmp_path):
    name = "x" * 200_000
    write_tar(tmp_path / "db1.tar.gz", {"pdb-info.csv": f"con_id,name\n1,{name}\n", "new-part.csv": "a,b\n1,2\n"})
    assert [tuple(r) for r in bundles.read_bundle_section(spark, str(tmp_path), "pdb-info").select("con_id", "name").collect()] == [(1, name)]
    bundles.ingest_bundles(spark, str(tmp_path), str(tmp_path / "fleet"))
    stored = spark.read.schema(bundles.CELLS_DDL).parquet(str(tmp_path / "fleet"))
    assert [tuple(r) for r in stored.filter("section = 'new-part'").select("bundle_id", "cells").collect()] == [("db1", {"a": "1", "b": "2"})]


def test_cells_that_do_not_parse_are_rejects(spark, tmp_path):
    write_tar(tmp_path / "my db 100%.tar.gz", {"pdb-info.csv": "con_id,name,open_mode\n1,A,x\nseven,B,y\n,C,z\n"})
    rows = bundles.read_bundle_section(spark, str(tmp_path), "pdb-info", rejects=True)
    assert sorted((r.name, r.con_id, r.rejects) for r in rows.collect()) == [("A", 1, {}), ("B", None, {"con_id": "seven"}), ("C", None, {})]
    assert [tuple(r) for r in bundles.rejected_cells(rows).collect()] == [("my db 100%", "con_id", "seven")]


def test_an_archive_is_read_as_a_stream(spark, tmp_path):
    import tracemalloc

    lines, many = 400_000, 300
    path = tmp_path / "big.tar.gz"
    with tarfile.open(path, "w:gz", compresslevel=1) as archive:
        for number in range(many):
            info = tarfile.TarInfo(f"other-{number}.csv")
            info.size = 4
            archive.addfile(info, io.BytesIO(b"a\n1\n"))
        data = b"con_id,name\n" + b"".join(b"%d,name of tenant %d\n" % (i, i) for i in range(lines))
        info = tarfile.TarInfo("pdb-info.csv")
        info.size = len(data)
        archive.addfile(info, io.BytesIO(data))
    size = path.stat().st_size
    del data
    tracemalloc.start()
    try:
        with open(path, "rb") as stream:
            assert sum(1 for _ in bundles._rows(stream, frozenset(["pdb-info"]))) == lines
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1_500_000 < size
    cells = bundles.bundle_cells(spark, str(tmp_path), ["pdb-info"])
    assert cells.count() == lines
    assert "content" not in cells._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_counter_sections_under_other_column_names(spark, tmp_path):
    for number, name in enumerate(["latch_name", "event_name", "state_name", "stat_name"]):
        write_tar(tmp_path / f"db{number}.tar.gz", {
            "awr-latches.csv": f"con_id,snap_id,{name},begin_interval_time,wait_time_delta\n"
                               f"1,5,x{number},2024-01-02 03:00:00.125,7.5\n"})
    got = bundles.read_bundle_section(spark, str(tmp_path), "awr-latches").orderBy("bundle_id").collect()
    assert [(r.stat_name, r.snap_id, float(r.wait_time_delta)) for r in got] == [(f"x{i}", 5, 7.5) for i in range(4)]


def test_bundle_round_trip(spark, tmp_path):
    names = ["pdb-info", "tablespace-usage", "patch-info", "user-privs", "sched-jobs", "expiring-user", "awr-latches",
             "topsql-gets-exec"]
    sections = collect_sections(fleet_tables(spark), FLEET, names)
    written = bundles.write_bundles(sections, str(tmp_path)).collect()
    assert sorted(r.bundle_id for r in written) == ["db1", "db2"]
    with tarfile.open(tmp_path / "db1.tar.gz") as archive:
        assert sorted(archive.getnames()) == sorted(f"{n}.csv" for n in names)
    cells = bundles.bundle_cells(spark, str(tmp_path)).cache()
    for name in names:
        back = bundles.typed_section(cells, name)
        columns = [f"`{c}`" for c in back.columns]
        kinds = {f.name: f.dataType for f in schema_of(name).fields}
        sent = sections[name].select([
            F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in back.columns])
        # Empty text and NULL are one in CSV.
        sent = sent.replace("", None)
        assert sent.select(columns).exceptAll(back.select(columns)).count() == 0, name
        assert back.count() == sent.count(), name
    cells.unpersist()


def test_large_sections_go_to_parts(spark, frame, tmp_path):
    df = frame("bundle_id STRING, con_id INT, name STRING, open_mode STRING",
               [("b", i, f"tenant {i}", "READ") for i in range(300)])
    few = frame("bundle_id STRING, instance_name STRING, path STRING", [("b", "i", "/x")])
    written = bundles.write_bundles({"pdb-info": df, "alert-dest": few}, str(tmp_path), part_bytes=2000).collect()
    assert len(written) > 3 and {r.bundle_id for r in written} == {"b"}
    back = bundles.read_bundle_section(spark, str(tmp_path), "pdb-info")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert bundles.read_bundle_section(spark, str(tmp_path), "alert-dest").count() == 1


def test_line_breaks_survive(spark, frame, tmp_path):
    df = frame("bundle_id STRING, con_id INT, name STRING, open_mode STRING",
               [("b", 1, "two\nlines", 'q"uote'), ("b", 2, "é,", None), ("b", 3, " sp ", "\\")])
    bundles.write_bundles({"pdb-info": df}, str(tmp_path)).collect()
    back = bundles.read_bundle_section(spark, str(tmp_path), "pdb-info")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    for fmt in ("csv", "parquet"):
        sinks.write_sections({"pdb-info": df}, str(tmp_path / fmt), fmt)
        stored = sinks.read_section(spark, str(tmp_path / fmt), "pdb-info", fmt).select(df.columns)
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, df.collect()))


def test_member_names():
    assert [bundles.section_of_member(m) for m in ("x.csv", "./x.csv", "x", "a/x.csv", "./")] == ["x", "x", "x", None, None]


def test_section_schemas_parse():
    for name in SECTIONS:
        assert schema_of(name).fields


def test_jdbc_options():
    plain = jdbc.reader_options("jdbc:x", "v_session", {"user": "u"})
    assert plain["fetchsize"] == "1000" and plain["user"] == "u" and "partitionColumn" not in plain
    parallel = jdbc.reader_options("jdbc:x", "hist", partition_column="snap_id", lower=1, upper=9, partitions=4)
    assert parallel["numPartitions"] == "4"
    with pytest.raises(ValueError):
        jdbc.reader_options("jdbc:x", "hist", partition_column="snap_id")


def test_bound_dates_reach_the_scan(spark, small):
    scan = jdbc.between_dates(spark.read.parquet(f"{small}/orders.parquet"), "o_orderdate", "1997-01-01", "1997-02-01")
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual" in scan._jdf.queryExecution().executedPlan().toString()
