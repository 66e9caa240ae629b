import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import topk
from fleetscope.operators.topk import STATEMENT_MEASURES, Measure
from fleetscope.sources.schemas import schema_of


def test_registry_has_26_measures():
    assert len(STATEMENT_MEASURES) == 26
    assert sum(m.per is None for m in STATEMENT_MEASURES.values()) == 15


def test_ties_fall_to_the_statement(frame):
    df = frame("con_id INT, sql_id STRING, sql_text STRING, executions BIGINT, sorts BIGINT",
               [(1, f"q{i}", "t", 1, 5) for i in (6, 2, 4, 0, 1, 3, 5)])
    out = topk.topk_statements(df, Measure("sorts", "sorts")).orderBy("count_sql").collect()
    assert [(r.sql_id, r.count_sql) for r in out] == [(f"q{i}", i + 1) for i in range(5)]


def test_guard_and_sum_of_ratios(frame):
    df = frame("con_id INT, sql_id STRING, sql_text STRING, executions BIGINT, sorts BIGINT",
               [(1, "a", "t", 2, 10), (1, "a", "t", 4, 10), (1, "b", "t", 0, 50), (1, "c", "t", 1, 0)])
    ratio = topk.topk_statements(df, STATEMENT_MEASURES["topsql-sort-exec"]).collect()
    assert [(r.sql_id, r.value) for r in ratio] == [("a", 7.5)]
    overall = topk.topk_statements(df, STATEMENT_MEASURES["topsql-sort"], keys=()).collect()
    assert [(r.sql_id, r.value) for r in overall] == [("a", 20)]


def statements(spark, tenants, count):
    rng = random.Random(7)
    names = schema_of("statements").fieldNames()
    rows = []
    for i in range(count):
        row = {n: rng.choice([0, 0, rng.randrange(1, 50), rng.randrange(1, 10**6)]) for n in names}
        row |= {"con_id": rng.choice(tenants), "inst_id": 1, "sql_id": f"q{rng.randrange(count // 2)}", "sql_text": "t"}
        rows.append(tuple(row[n] for n in names))
    return spark.createDataFrame(rows, schema_of("statements"))


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_one_pass_equals_single_measures(spark, buckets):
    """One bucket has no k-th maximum, so every statement stays; the result is the same."""
    df = statements(spark, [1, 1, 1, 1, 2, None], 300).cache()
    together = topk.topk_statements_all(df, buckets=buckets).withColumn("value", F.col("value").cast("double"))
    got = {(r.measure, r.con_id, r.count_sql): (r.sql_id, r.value) for r in together.collect()}
    for name in ("topsql-exec", "topsql-cpu", "topsql-gets-exec", "topsql-elapsed-exec"):
        alone = topk.topk_statements(df, STATEMENT_MEASURES[name]).collect()
        assert {k[1:]: v for k, v in got.items() if k[0] == name} == {
            (r.con_id, r.count_sql): (r.sql_id, pytest.approx(float(r.value))) for r in alone}
    overall = topk.topk_statements_all(df, keys=(), buckets=buckets).filter("measure = 'topsql-cpu'").collect()
    alone = topk.topk_statements(df, STATEMENT_MEASURES["topsql-cpu"], keys=()).collect()
    assert sorted((r.sql_id, int(r.value)) for r in overall) == sorted((r.sql_id, r.value) for r in alone)
    df.unpersist()


def test_tenant_key_and_no_key_agree_on_one_tenant(spark):
    df = statements(spark, [1], 100)
    for name in ("topsql-rows", "topsql-parse-exec"):
        keyed = topk.topk_statements(df, STATEMENT_MEASURES[name]).collect()
        plain = topk.topk_statements(df, STATEMENT_MEASURES[name], keys=()).collect()
        assert sorted((r.sql_id, r.value) for r in keyed) == sorted((r.sql_id, r.value) for r in plain)


def test_rank_is_cut_before_the_shuffle(spark):
    """A hot tenant sends k rows per task: the plan has a partial group limit below the exchange."""
    df = topk.topk_statements(statements(spark, [1], 20), STATEMENT_MEASURES["topsql-exec"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_pin_lists(frame):
    cache = frame(
        "con_id INT, owner STRING, name STRING, type STRING, sharable_mem BIGINT, executions BIGINT, kept STRING",
        [(1, "APP", "P1", "PACKAGE", 2000, 11, "NO"), (1, "APP", "P1", "PACKAGE", 3000, 11, "NO"),
         (1, "SYS", "P2", "PACKAGE", 9000, 99, "NO"), (1, "APP", "P3", "TABLE", 9000, 99, "NO"),
         (1, "APP", "P4", "FUNCTION", 1000, 99, "NO"), (1, "APP", "P5", "FUNCTION", 4000, 10, "NO"),
         (1, "APP", "P6", "PROCEDURE", 1500, 12, "YES"), (1, None, "P7", "PROCEDURE", 1500, 12, "NO")])
    assert [(r.name, r.sharable_mem) for r in topk.code_to_pin(cache).collect()] == [("P1", 5000)]
    sql = frame("con_id INT, sql_text STRING, sharable_mem BIGINT, invalidations BIGINT, loads BIGINT",
                [(1, "a", 200000, 1, 5), (1, "a", 200000, 0, 2), (1, "b", 190000, 0, 9), (1, "c", 300000, 9, 9)])
    assert [tuple(r) for r in topk.statements_to_pin(sql).collect()] == [(1, "a", 400000, 1, 7)]


def test_ratio_sums_do_not_depend_on_partitions(spark, frame):
    """Sums near 5e17 of quotients that doubles cannot hold: one value whatever the partitioning."""
    ddl = "con_id INT, sql_id INT, sql_text STRING, cpu_time BIGINT, executions BIGINT"
    rows = [(1, 1, "s", 10**15 + 7919 * i, 3 + i % 4) for i in range(2000)]
    cpu = topk.Measure("cpu", "cpu_time", "executions")
    values = set()
    for parts in (1, 3, 7, 16):
        df = frame(ddl, rows).repartition(parts, "cpu_time")
        values.add(topk.topk_statements(df, cpu).first().value)
        values.add(float(topk.topk_statements_all(df, [cpu]).first().value))
    assert len(values) == 1


def odd_statements(frame):
    """Two keys with NULL parts, NULL statements and texts, rows that come twice, no or NULL executions, one statement with half of all rows."""
    rng = random.Random(11)
    rows = [(rng.choice(["a", None]), rng.choice([1, 2, None]), rng.choice([None, *range(60)]), rng.choice(["t", None]),
             rng.choice([None, 0, 1, 3, 7]), rng.choice([None, -5, 0, rng.randrange(1, 10**6)])) for _ in range(800)]
    hot = [("a", 1, 5, "t", 3, 10 + i) for i in range(900)]
    return frame("bundle_id STRING, con_id INT, sql_id INT, sql_text STRING, executions BIGINT, cpu_time BIGINT", [*rows, *rows[:99], *hot])


def plain_first(rows, per, k=5):
    """The first ``k`` of each tenant by sums of positive values in whole millionths of millionths, NULL last among equals."""
    sums = {}
    for bundle, con, sql, words, executions, value in rows:
        if (executions or 0) > 0:
            found = sums.setdefault((bundle, con), {}).setdefault((sql, words), [])
            found += [Fraction(value, executions if per else 1)] if (value or 0) > 0 else []
    nulls_last = lambda item: tuple((x is None, x or 0) for x in item)
    first = {}
    for tenant, of in sums.items():
        known = [(-round(float(sum(v)), 6), nulls_last(item), item) for item, v in of.items() if v]
        first |= {(*tenant, place): (*item, -value) for place, (value, _, item) in enumerate(sorted(known, key=lambda x: x[:2])[:k], 1)}
    return first


@pytest.mark.parametrize("advisory", ["64m", "1k"])
def test_odd_statements_equal_plain_sums(spark, frame, advisory):
    """With parts of 1 kB the large statement's rows are split among tasks."""
    df = odd_statements(frame)
    rows, name = [tuple(r) for r in df.collect()], "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    chosen = [Measure("cpu", "cpu_time"), Measure("cpu a run", "cpu_time", "executions")]
    spark.conf.set(name, advisory)
    try:
        found = topk.topk_statements_all(df.repartition(7), chosen, keys=("bundle_id", "con_id")).collect()
    finally:
        spark.conf.unset(name)
    for m in chosen:
        got = {(r.bundle_id, r.con_id, r.count_sql): (r.sql_id, r.sql_text, float(r.value)) for r in found if r.measure == m.name}
        want = plain_first(rows, m.per)
        assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
        assert all(v[2] == pytest.approx(want[k][2], abs=2e-6) for k, v in got.items())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_scan_keeps_no_sums(spark):
    """Rows gather by statement first: the stage that reads them has no aggregation, and its parts may be split."""
    plan = plan_of(topk.topk_statements_all(statements(spark, [1], 20)))
    gathered = [i for i, line in enumerate(plan) if "REBALANCE_PARTITIONS_BY_COL" in line]
    assert gathered
    for i in gathered:
        depth = len(plan[i]) - len(plan[i].lstrip(" :+-"))
        below = [line for line in plan[i + 1:] if len(line) - len(line.lstrip(" :+-")) > depth][:4]
        assert not any("Aggregate" in line for line in below) and "partial_sum" in plan[i - 2] + plan[i - 1]


def test_sums_are_dealt_out_once(spark):
    """The maxima and the join read one shuffle of the sums, without a further one for the join."""
    df = topk.topk_statements_all(statements(spark, [1, 2, None], 60))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final
    dealt = [line for line in final.splitlines() if "hashpartitioning(_tenant" in line and "pmod(xxhash64" in line]
    assert sum("ReusedExchange" in line for line in dealt) == 1 and sum("REPARTITION_BY_COL" in line for line in dealt) == 2
