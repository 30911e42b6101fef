"""Predicates and expressions on hand-made rows (FLT-*, PRJ-*)."""

import datetime as dt

from pyspark.sql import functions as F

from rankspark.functions import expressions as X
from rankspark.functions import predicates as P


def _vals(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_like_has_no_escape_character(spark):
    df = spark.createDataFrame([("a\\xb",), ("axb",), ("a%b",), ("a\\%b",), ("a\\zzb",)], "q string")
    # Backslash is an ordinary character: 'a\xb' matches only itself.
    assert sorted(_vals(df.where(P.like("q", "a\\xb")), "q")) == ["a\\xb"]
    # 'a\%b' = 'a', backslash, anything, 'b'.
    assert sorted(_vals(df.where(P.like("q", "a\\%b")), "q")) == ["a\\%b", "a\\xb", "a\\zzb"]
    assert sorted(_vals(df.where(P.like("q", "a_b")), "q")) == ["a%b", "axb"]


def test_like_is_case_sensitive_and_ilike_is_not(spark):
    df = spark.createDataFrame([("Hot Gear",), ("hot gear",), ("bolt",)], "q string")
    assert _vals(df.where(P.like("q", "%gear%")), "q") == ["hot gear"]
    assert sorted(_vals(df.where(P.ilike("q", "%GEAR%")), "q")) == ["Hot Gear", "hot gear"]


def test_not_like_and_any_like(spark):
    df = spark.createDataFrame([("/a#x", "k"), ("/tag/1", "k"), ("/ok", "k"), ("/z", "gear")], "page string, q string")
    assert _vals(df.where(P.not_like("page", "%#%", "%tag%")), "page") == ["/ok", "/z"]
    assert sorted(_vals(df.where(P.any_like(["q", "page"], "%a%")), "page")) == ["/a#x", "/tag/1", "/z"]


def test_last_days_is_inclusive_string_floor_without_upper_bound(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-02-01",)], "date string")
    got = _vals(df.where(P.last_days(dt.date(2024, 1, 31), 30)), "date")
    assert got == ["2024-01-01", "2024-01-02", "2024-02-01"]
    got = _vals(df.where(P.last_days("2024-01-31", 29)), "date")
    assert got == ["2024-01-02", "2024-02-01"]


def test_date_range_half_open_and_between_inclusive(spark):
    df = spark.createDataFrame([("2025-03-01",), ("2025-03-31",), ("2025-04-01",)], "date string")
    assert _vals(df.where(P.date_range("2025-03-01", "2025-04-01")), "date") == ["2025-03-01", "2025-03-31"]
    assert _vals(df.where(P.date_between("2025-03-31", "2025-04-01")), "date") == ["2025-03-31", "2025-04-01"]


def test_filter_in_lists(spark):
    df = spark.createDataFrame([("a",), ("b",), ("",), (None,)], "page string")
    assert sorted(_vals(P.filter_in(df, "page", ["a", None]), "page")) == ["a"]
    # Empty or all-None list: matches only '' (the source's IN ('')).
    assert _vals(P.filter_in(df, "page", []), "page") == [""]
    assert _vals(P.filter_in(df, "page", [None]), "page") == [""]
    # Optional filter: None or [] means no filter.
    assert P.filter_in(df, "page", None, optional=True).count() == 4
    assert P.filter_in(df, "page", [], optional=True).count() == 4
    # Long list -> semi-join, same result.
    many = ["a"] + [f"x{i}" for i in range(500)]
    out = P.filter_in(df, "page", many)
    assert _vals(out, "page") == ["a"]
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_ctr_and_pct_change_guards(spark):
    df = spark.createDataFrame([(5, 100), (0, 0), (3, None)], "c long, i long")
    got = [r[0] for r in df.select(X.ctr_pct("c", "i")).collect()]
    assert got == [5.0, 0.0, 0.0]
    df = spark.createDataFrame([(100, 150), (0, 10), (None, 10), (10, None)], "a long, b long")
    got = [r[0] for r in df.select(X.pct_change("a", "b")).collect()]
    assert got == [50.0, 0.0, 0.0, None]
    got = [r[0] for r in df.select(X.diff("a", "b")).collect()]
    assert got == [50, 10, None, None]
    got = [r[0] for r in df.select(X.loss("a", "b")).collect()]
    assert got == [-50, -10, -10, 10]


def test_trailing_pct_null_on_zero(spark):
    df = spark.createDataFrame([(10.0, 5.0), (1.0, 0.0)], "cur double, prev double")
    got = [r[0] for r in df.select(X.trailing_pct("cur", "prev")).collect()]
    assert got == [100.0, None]


def test_decode_page_keeps_plus_and_survives_malformed(spark):
    df = spark.createDataFrame([("/%E4%B8%AD/a+b",), ("/100%",), ("/plain",)], "page string")
    got = [r[0] for r in df.select(X.decode_page("page")).collect()]
    assert got == ["/中/a+b", "/100%", "/plain"]


def test_display_helpers(spark):
    df = spark.createDataFrame([(1234567.891, "abcdefghij"), (None, "abc")], "x double, s string")
    got = df.select(X.display_number("x", 2).alias("x"), X.truncate("s", 5).alias("s")).collect()
    assert [tuple(r) for r in got] == [("1,234,567.89", "abcde..."), ("-", "abc")]
    nan = spark.createDataFrame([(float("nan"),)], "x double")
    assert nan.select(X.display_number("x", 1)).first()[0] == "-"


def test_contains_ci(spark):
    df = spark.createDataFrame([("Blue Bolt",), ("gear",)], "q string")
    assert _vals(df.where(P.contains_ci("q", "BOLT")), "q") == ["Blue Bolt"]
