from pyspark.sql import functions as F

from fleetscope.functions import labels, numbers, times
from fleetscope.functions.nulls import concat_nn, greatest_nn, substr_nn, try_ratio
from fleetscope.operators.classify import words_capitalised
from fleetscope.operators.dims import major_version


def one(df, *columns):
    return list(df.select(*columns).first())


def test_null_text_counts_as_empty(frame):
    df = frame("a STRING, b STRING, c STRING", [("a", None, "c")])
    assert one(df, concat_nn(F.col("a"), F.lit(":"), F.col("b"), F.lit(":"), F.col("c"))) == ["a::c"]


def test_greatest_is_null_with_a_null(frame):
    df = frame("a INT, b INT", [(3, None), (3, 5)])
    assert [r[0] for r in df.select(greatest_nn(F.col("a"), F.col("b"))).collect()] == [None, 5]


def test_substring_of_length_below_one_is_null(frame):
    df = frame("s STRING, n INT", [("abc", 0), ("abc", -2), ("abc", 2)])
    rows = df.select(substr_nn(F.col("s"), F.lit(1), F.col("n"))).collect()
    assert [r[0] for r in rows] == [None, None, "ab"]


def test_division_by_zero_is_null(frame):
    df = frame("a INT, b INT", [(1, 0), (1, 4)])
    assert [r[0] for r in df.select(try_ratio(F.col("a"), F.col("b"))).collect()] == [None, 0.25]


def test_number_text(frame):
    df = frame("v DOUBLE", [(5.0,), (999.6,), (0.5,), (-0.5,), (12.345,), (None,)])
    rows = df.select(numbers.number_text(F.col("v"), 3, leading_zero=True), numbers.number_text(F.col("v"), 3, 2)).collect()
    assert [tuple(r) for r in rows] == [
        ("   5", "   5.00"), ("####", " 999.60"), ("   1", "    .50"), ("  -1", "   -.50"), ("  12", "  12.35"),
        (None, None),
    ]


def test_rounding_kinds(frame):
    df = frame("v BIGINT", [(131072,)])
    assert one(df, numbers.to_mb(F.col("v")), numbers.whole_mb(F.col("v"))) == [0.12, 0]
    assert one(df, F.round(F.col("v") / 1048576, 2)) == [0.13]


def test_percent_of_an_empty_size_is_null(frame):
    df = frame("f DOUBLE, s DOUBLE", [(1.0, 0.0), (1.0, 3.0)])
    assert [r[0] for r in df.select(numbers.used_percent(F.col("f"), F.col("s"))).collect()] == [None, 66.67]


def test_interval_seconds_keep_sign_and_fraction(spark):
    df = spark.sql("SELECT INTERVAL '1 00:01:30.5' DAY TO SECOND AS a, INTERVAL '-2383 00:00:01' DAY TO SECOND AS b")
    assert [float(x) for x in one(df, times.interval_seconds(F.col("a")), times.interval_seconds(F.col("b")))] == [
        86490.5, -(2383 * 86400 + 1)]


def test_day_fraction(spark):
    assert str(spark.range(1).select(times.days(0.16)).first()[0]) == "3:50:24"


def test_labels():
    assert labels.label("con_id") == "容器ID"
    assert labels.label("Memory_Size") == "内存_大小"
    assert labels.label("sql_text") == "sql_text"


def test_projection_skips_absent_columns(frame):
    df = frame("a INT, `b#` INT", [(1, 2)])
    assert labels.project_existing(df, ["b#", "zz", "a"]).columns == ["b#", "a"]


def test_major_version(frame):
    df = frame("v STRING", [("19.3.0",), ("x.1",), (None,)])
    assert [r[0] for r in df.select(major_version(F.col("v"))).collect()] == [19, None, None]


def test_words_capitalised(frame):
    df = frame("v STRING", [("shared IO pool",), ("in-memory area",), ("2K cache",)])
    assert [r[0] for r in df.select(words_capitalised(F.col("v"))).collect()] == [
        "Shared Io Pool", "In-Memory Area", "2k Cache"]
