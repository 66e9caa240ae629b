"""Statement sections in one write, classes of equal lists, subtree sums and release gates."""

import random
import re
from decimal import Decimal

import pytest

from fleetscope.operators import indexes, subtree
from fleetscope.plans import reports, testbed, views
from fleetscope.sources import sinks
from fleetscope.operators.topk import STATEMENT_MEASURES


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_statement_sections_read_their_source_once(spark, small):
    scope = reports.Scope(as_of="2010-01-01", begin="1990-01-01", end="2010-01-01")
    tables = {"statements": testbed.statements(spark, small)}
    plan = final_plan(reports._statement_sections(tables, scope, list(STATEMENT_MEASURES)))
    assert len(re.findall("FileScan parquet", plan)) == 1


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_written_sections_equal_single_reports(spark, small, tmp_path, fmt):
    scope = reports.Scope(as_of="2010-01-01", begin="1990-01-01", end="2010-01-01", bundle=("bundle_id",))
    rows = testbed.statements(spark, small, (testbed.whole("l_linenumber") % 2).cast("string").alias("bundle_id"))
    tables = {"statements": rows.withColumn("con_id", testbed.F.ascii("con_id")).withColumn("sql_id", testbed.text("sql_id"))}
    names = ["topsql-cpu", "topsql-sort-exec", "pin-sql"]
    where = reports.write_reports(tables, scope, str(tmp_path), names, fmt)
    assert where == {"topsql-cpu": "topsql", "topsql-sort-exec": "topsql", "pin-sql": None}
    for name in names[:2]:
        found = sinks.read_section(spark, str(tmp_path), name, fmt, where[name]).selectExpr("string(bundle_id) AS bundle_id", "string(con_id) AS con_id", "string(sql_id) AS sql_id", "double(value) AS value")
        want = reports.run_report(name, tables, scope).selectExpr("bundle_id", "string(con_id) AS con_id", "string(sql_id) AS sql_id", "double(value) AS value")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


LIST = "`bo#` int, `obj#` int, `pos#` int, `intcol#` int"


def list_rows(lists):
    return [(table, name, pos + 1, col) for (table, name), cols in lists.items() for pos, col in enumerate(cols)]


def test_classes_agree_with_pairs(frame):
    rng = random.Random(5)
    lists = {(i % 3, i): tuple(rng.choice((1, 2)) for _ in range(rng.randint(1, 4))) for i in range(60)}
    columns = frame(LIST, list_rows(lists))
    pairs = {(r.redundant, r.sufficient) for r in indexes.redundant_prefixes(columns).collect()}
    want = {(i, j) for (s, i), a in lists.items() for (t, j), b in lists.items() if s == t and i != j and b[:len(a)] == a}
    assert pairs == want
    for r in indexes.redundant_classes(columns).collect():
        member = getattr(r, "member")
        same = sorted(j for (t, j), b in lists.items() if t == r["bo#"] and b == lists[t, member])
        assert r.class_id == same[0] and r.class_size == len(same)
        assert r.class_size - 1 + r.covering_lists == len([1 for i, _ in want if i == member])


def test_equal_lists_stay_linear(spark):
    columns = spark.range(4000).selectExpr("1 AS `bo#`", "int(id) AS `obj#`", "explode(array(1, 2, 3)) AS `pos#`").withColumn("intcol#", testbed.F.col("`pos#`") * 10)
    found = indexes.redundant_classes(columns)
    assert found.groupBy("class_id", "class_size").count().collect() == [(0, 4000, 4000)]
    assert "16000000" not in final_plan(found)


def test_lists_with_gaps_are_never_redundant(frame):
    columns = frame(LIST, [(1, 1, 2, 7), (1, 2, 1, 7), (1, 2, 2, 8), (1, 3, 2, 7), (1, 4, 1, 7)])
    assert {(r.redundant, r.sufficient) for r in indexes.redundant_prefixes(columns).collect()} == {(4, 2)}
    assert {r["member"]: r.class_size for r in indexes.redundant_classes(columns).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_columns_are_read_once(spark, frame):
    lists = {(1, i): (1, 2, 3)[:1 + i % 3] for i in range(12)}
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    columns = frame(LIST, list_rows(lists)).mapInArrow(counted, LIST)
    for find, rows in ((indexes.redundant_prefixes, 84), (indexes.redundant_classes, 12)):
        before = read.value
        assert find(columns).count() == rows
        assert read.value - before == len(list_rows(lists))


@pytest.mark.parametrize("width", [2, 4096])
def test_lists_with_one_hash_are_told_apart(frame, monkeypatch, width):
    monkeypatch.setattr(indexes, "LIST_SLICE", width)
    monkeypatch.setattr(indexes, "_key", lambda *columns: testbed.F.pmod(testbed.F.hash(*columns), testbed.F.lit(2)).cast("bigint"))
    rng = random.Random(width)
    lists = {(i % 2, i): tuple(rng.choice((1, 2)) for _ in range(rng.randint(1, 4))) for i in range(30)}
    columns = frame(LIST, list_rows(lists))
    want = sorted((i, j) for (s, i), a in lists.items() for (t, j), b in lists.items() if s == t and i != j and b[:len(a)] == a)
    assert sorted((r.redundant, r.sufficient) for r in indexes.redundant_prefixes(columns).collect()) == want
    for r in indexes.redundant_classes(columns).collect():
        same = sorted(j for (t, j), b in lists.items() if t == r["bo#"] and b == lists[t, r.member])
        assert (r.class_id, r.class_size) == (same[0], len(same))
        assert r.class_size - 1 + r.covering_lists == len([1 for i, _ in want if i == r.member])


@pytest.mark.parametrize("width", [1, 2, 4096])
def test_lists_with_repeats_and_nulls(frame, monkeypatch, width):
    monkeypatch.setattr(indexes, "LIST_SLICE", width)
    lists = {1: [(1, 7)], 2: [(1, 7), (2, 8)], 3: [(1, 7), (1, 7), (2, 8), (2, 8)], 4: [(1, None)], 5: [(1, None)], 6: [(1, 7), (2, 8), (2, 9), (3, 7)],
             7: [(0, 7), (1, 7)], 8: [(None, 7), (1, 7), (2, 8)], 9: [(1, 7), (2, 8), (4, 9)], 10: [(1, 7), (2, None), (3, 9)], 11: [(1, 7), (2, 8), (3, 9)]}
    columns = frame(LIST, [(1, name, at, col) for name, entries in lists.items() for at, col in entries] + [(None, 12, 1, 7), (None, 13, 1, 7)])
    pairs = sorted((r.redundant, r.sufficient) for r in indexes.redundant_prefixes(columns).collect())
    assert pairs == [(1, 2), (1, 6), (1, 9), (1, 10), (1, 11), (2, 9), (2, 11)]
    classes = indexes.redundant_classes(columns).collect()
    assert sorted((r.member, r.class_size, r.covering_lists) for r in classes) == [(i, 1, {1: 5, 2: 2}.get(i, 0)) for i in range(1, 12)]


NODE = "k string, id string, parent string, value bigint"


def test_subtree_sums_equal_brute_force(frame):
    rng, rows = random.Random(3), []
    for k in "ab":
        for i in range(60):
            rows.append((k, f"n{i}", None if i < 2 else f"n{rng.randrange(i)}", rng.choice((None, i, 1000 * i))))
    rows += [("a", "lost", "nobody", 1), ("a", "x", "y", 1), ("a", "y", "x", 1), ("b", "only", None, 7)]
    found = {(r.k, r.id): r for r in subtree.subtree_sums(frame(NODE, rows), "id", "parent", "value", ["k"]).collect()}
    children = {}
    for k, i, p, _ in rows:
        children.setdefault((k, p), []).append(i)
    value = {(k, i): v or 0 for k, i, _, v in rows}

    def below(k, i):
        return [i, *(d for c in children.get((k, i), []) for d in below(k, c))]

    known = {(k, d) for k, i, p, _ in rows if p is None for d in below(k, i)}
    assert set(found) == known
    for (k, i), r in found.items():
        under = below(k, i)
        assert r.subtree_size == len(under) and r.subtree_sum == sum(value[k, d] for d in under)
        inside = {j for (kk, j), o in found.items() if kk == k and o.root == r.root and r.entry <= o.entry and o.exit <= r.exit}
        assert inside == set(under) and r.exit - r.entry == 2 * len(under) - 1


def test_a_long_chain_needs_no_paths(spark):
    n = 300
    chain = spark.range(n).selectExpr("string(id) AS id", "CASE WHEN id > 0 THEN string(id - 1) END AS parent", "id AS value")
    found = subtree.subtree_sums(chain, "id", "parent", "value")
    assert found.filter("subtree_size + depth <> 300").isEmpty() and found.filter(f"depth = 0 AND subtree_sum <> {n * (n - 1) // 2}").isEmpty()
    assert found.count() == n


def test_a_hub_with_very_many_children(spark):
    hub = spark.range(20000).selectExpr("id", "CASE WHEN id > 0 THEN 0L END AS parent", "1L AS value")
    found = subtree.subtree_sums(hub, "id", "parent", "value").cache()
    assert found.filter("depth = 0").select("subtree_size", "subtree_sum", "entry", "exit").collect() == [(20000, 20000, 1, 40000)]
    assert found.filter("depth = 1").select("entry").distinct().count() == 19999


def test_sums_keep_their_types_and_scale(frame):
    rows = [(i, i // 3 if i else None, i) for i in range(30)]
    tree = frame("id int, parent int, whole int", rows).selectExpr("*", "cast(whole / 8 as decimal(20, 10)) as exact")
    found = {r.id: r.subtree_sum for r in subtree.subtree_sums(tree, "id", "parent", "exact").collect()}
    whole = subtree.subtree_sums(tree, "id", "parent", "whole")
    assert dict(whole.dtypes)["subtree_sum"] == "int"
    assert found == {r.id: Decimal(r.subtree_sum) / 8 for r in whole.collect()}
    assert found[0] == Decimal(435) / 8


def test_no_node_is_no_row(frame):
    assert subtree.subtree_sums(frame(NODE, [("a", "x", "y", 1), ("a", "y", "x", 1)]), "id", "parent", "value", ["k"]).count() == 0
    assert subtree.subtree_sums(frame(NODE, []), "id", "parent", "value", ["k"]).count() == 0


def test_each_bundle_shows_its_releases_columns(frame):
    rows = frame("bundle_id string, name string, inst_id int, sid int, machine string, final_blocking_session int, extra int",
                 [(b, "n", 1, 2, "m", 3, 9) for b in ("new", "mid", "old", "odd", "none")])
    instances = frame("bundle_id string, version string", [("new", "19.3.0"), ("mid", "11.2"), ("mid", "12.1"), ("old", "10.2"), ("odd", "beta")])
    found = {r.bundle_id: (r.inst_id, r.sid, r.machine, r.final_blocking_session) for r in views.sessions_by_release(rows, instances).collect()}
    assert found == {"new": (1, 2, "m", 3), "mid": (1, 2, None, 3), "old": (None, 2, None, None), "odd": (None, 2, None, None), "none": (None, 2, None, None)}
