"""Period bounds (CMP-2), templated SQL (SRC-4), keyword files (SRC-9), plans (ING-1/2)."""

import datetime as dt

import pytest

from rankspark.operators.keywords import keyword_frame, read_keywords
from rankspark.plans.ingest import date_spine, plan_daily, plan_hourly, site_frame
from rankspark.plans.periods import period_bounds
from rankspark.schema import DAILY, HOURLY
from rankspark.sources.store import Store


@pytest.mark.parametrize("as_of,p", [
    ("2024-01-08", ("2024-01-01", "2024-01-07", "2024-01-08", "2024-01-08")),   # a Monday
    ("2024-01-14", ("2024-01-01", "2024-01-07", "2024-01-08", "2024-01-14")),   # a Sunday
    ("2024-01-01", ("2023-12-25", "2023-12-31", "2024-01-01", "2024-01-01")),   # 1 January (Monday)
])
def test_week_bounds(as_of, p):
    b = period_bounds(as_of, "week")
    assert (b.period1_start, b.period1_end, b.period2_start, b.period2_end) == p


@pytest.mark.parametrize("as_of,p", [
    ("2024-03-01", ("2024-02-01", "2024-02-29", "2024-03-01", "2024-03-01")),   # leap year
    ("2023-03-15", ("2023-02-01", "2023-02-28", "2023-03-01", "2023-03-15")),
    ("2024-01-01", ("2023-12-01", "2023-12-31", "2024-01-01", "2024-01-01")),
])
def test_month_bounds(as_of, p):
    b = period_bounds(as_of, "month")
    assert (b.period1_start, b.period1_end, b.period2_start, b.period2_end) == p


def test_custom_and_invalid_bounds():
    c = {"period1": {"start": "a", "end": "b"}, "period2": {"start": "c", "end": "d"}}
    assert period_bounds("2024-01-01", "custom", c).span == ("a", "d")
    with pytest.raises(ValueError):
        period_bounds("2024-01-01", "custom", {})
    with pytest.raises(ValueError):
        period_bounds("2024-01-01", "year")


@pytest.fixture()
def store(spark):
    daily = spark.createDataFrame([
        ("s1", "2024-01-01", "a", "/1", "M", "twn", 5, 10, 0.5, 1.0),
        ("s1", "2024-01-02", "b", "/1", "M", "twn", 50, 100, 0.5, 2.0),
        ("s2", "2024-01-01", "a", "/2", "M", "twn", 500, 1000, 0.5, 3.0),
    ], DAILY)
    hourly = spark.createDataFrame([
        ("s1", "2024-01-02", 23, "a", "/1", "M", "twn", 1, 2, 0.5, 1.0),
        ("s1", "2024-01-03", 22, "a", "/1", "M", "twn", 1, 2, 0.5, 1.0),
    ], HOURLY)
    return Store.of(spark, daily, hourly)


def test_sql_binds_site_and_hourly(store):
    df = store.sql("SELECT SUM(clicks) AS c FROM {site}", site="s1")
    assert df.first().c == 55
    df = store.sql("SELECT COUNT(*) AS n FROM {site}", site="s1", data_type="hourly")
    assert df.first().n == 2
    df = store.sql("SELECT (SELECT SUM(clicks) FROM {site}) AS d, (SELECT COUNT(*) FROM {site_hourly}) AS h",
                   site="s1")
    assert tuple(df.first()) == (55, 2)


def test_sql_literal_braces_and_backslash(store):
    df = store.sql("SELECT '{not a table}' AS t, '{x}' AS u, 'a\\\\b' AS v FROM {site} LIMIT 1", site="s1")
    r = df.first()
    assert (r.t, r.u) == ("{not a table}", "{x}")


def test_sql_rejects_non_select_and_multiple(store):
    with pytest.raises(ValueError):
        store.sql("DROP VIEW {site}", site="s1")
    with pytest.raises(ValueError):
        store.sql("SELECT 1; SELECT 2", site="s1")
    with pytest.raises(ValueError):
        store.sql("SELECT 1", data_type="weekly")


def test_sql_default_limit(store):
    assert store.sql("SELECT * FROM {site}", default_limit=1).count() == 1
    assert store.sql("SELECT * FROM {site} LIMIT 2", default_limit=1).count() == 2
    assert store.sql("SELECT * FROM (SELECT * FROM {site} LIMIT 3) x", default_limit=1).count() == 1


def test_sites_sorted_and_unknown_site_empty(store):
    assert [r.site_url for r in store.sites().collect()] == ["s1", "s2"]
    assert store.daily("nope").count() == 0
    with pytest.raises(LookupError):
        store.daily("nope", require_site=True)


def test_keyword_file_keeps_duplicates(spark, tmp_path):
    p = tmp_path / "kw.txt"
    p.write_text("('瑪卡'),('桑拿功效'), ('瑪卡'),('a b')\n('x')", encoding="utf-8")
    got = [r.query for r in read_keywords(spark, str(p)).collect()]
    assert got == ["瑪卡", "桑拿功效", "瑪卡", "a b", "x"]
    assert keyword_frame(spark, ["a", "a", None]).count() == 3


def test_plan_daily_and_spine(spark, store):
    spine = date_spine(site_frame(spark, ["s1"]), "2024-01-01", "2024-01-03")
    assert [r.date for r in spine.collect()] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    plan = plan_daily(store.daily(), ["s1", "s2", "s3"], dt.date(2024, 1, 4), history_days=3)
    got = [(r.site_url, r.date) for r in plan.collect()]
    assert got == [("s1", "2024-01-03"), ("s2", "2024-01-02"), ("s2", "2024-01-03"),
                   ("s3", "2024-01-01"), ("s3", "2024-01-02"), ("s3", "2024-01-03")]


def test_plan_hourly_refetches_incomplete(spark, store):
    plan = plan_hourly(store.units("hourly"), ["s1"], "2024-01-03", history_days=3)
    assert [r.date for r in plan.collect()] == ["2024-01-01", "2024-01-03"]


def test_sql_nan_to_null(store):
    df = store.sql("SELECT CAST('NaN' AS DOUBLE) AS x, 1 AS y FROM {site} LIMIT 1", site="s1", nan_to_null=True)
    assert tuple(df.first()) == (None, 1)


@pytest.mark.parametrize("text", [
    "WITH q AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '/tmp/never' USING parquet SELECT * FROM q",
    "FROM {site} INSERT OVERWRITE DIRECTORY '/tmp/never' USING parquet SELECT *",
    "INSERT INTO t SELECT * FROM {site}", "CREATE TABLE t AS SELECT 1", "SET x = 1", "SELEC 1",
])
def test_sql_refuses_writes(store, text):
    with pytest.raises(ValueError):
        store.sql(text, site="s1")


def test_sql_accepts_comments_quoted_semicolons_and_a_column_called_limit(store):
    assert store.sql("-- a; comment\nSELECT 'a;b' AS x FROM {site}", site="s1").first().x == "a;b"
    assert store.sql("SELECT clicks AS `limit` FROM {site}", site="s1", default_limit=1).count() == 1
    assert store.sql("WITH q AS (SELECT * FROM {site}) SELECT * FROM q LIMIT 2", site="s1", default_limit=1).count() == 2


def test_keyword_file_doubled_quotes(spark, tmp_path):
    p = tmp_path / "kw.txt"
    p.write_text("('a'),('women''s shoes'),('b')", encoding="utf-8")
    assert [r.query for r in read_keywords(spark, str(p)).collect()] == ["a", "women's shoes", "b"]


@pytest.mark.parametrize("text", [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT java_method('java.lang.Math', 'abs', -1) FROM {site}",
    "SELECT COUNT(*) FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SELECT * FROM json.`/etc/passwd`",
    "SELECT * FROM other", "SELECT * FROM default.other", "SELECT (SELECT MAX(x) FROM other) AS m FROM {site}",
    "SELECT * FROM {site} WHERE query IN (SELECT query FROM other)", "SELECT * FROM {site} WHERE EXISTS (SELECT 1 FROM csv.`/etc/passwd`)",
    "WITH q AS (SELECT * FROM other) SELECT * FROM q", "SELECT input_file_name() FROM {site}", "SELECT current_user()",
    "SELECT TRANSFORM(query) USING 'cat' FROM {site}", "SELECT my_udf(query) FROM {site}", "SELECT * FROM {site} LATERAL VIEW reflect('a', 'b') t",
    "SELECT * FROM (WITH other AS (SELECT 1 AS x) SELECT * FROM other) a, other b", "SELECT spark_catalog.default.f(1)",
    "SELECT filter(array(1), x -> reflect('java.lang.System', 'gc') IS NULL) FROM {site}", "SHOW TABLES", "DESCRIBE {site}", "EXPLAIN SELECT 1",
])
def test_sql_reads_the_bound_tables_only(spark, store, text):
    spark.range(3).selectExpr("id AS x", "'q' AS query").createOrReplaceTempView("other")
    spark.udf.register("my_udf", lambda x: x)
    try:
        with pytest.raises(ValueError):
            store.sql(text, site="s1")
    finally:
        spark.catalog.dropTempView("other")


@pytest.mark.parametrize("text", [
    "SELECT query, SUM(clicks) OVER (PARTITION BY page ORDER BY date) AS c, ROW_NUMBER() OVER w AS n FROM {site} WINDOW w AS (ORDER BY query)",
    "WITH a AS (SELECT * FROM {site}), b AS (SELECT query FROM a WHERE clicks > (SELECT AVG(clicks) FROM a)) SELECT a.* FROM a JOIN b USING (query)",
    "SELECT page, COUNT(DISTINCT query) AS n FROM {site} GROUP BY ROLLUP (page) HAVING n > 0 ORDER BY n DESC NULLS LAST LIMIT 5 OFFSET 0",
    "SELECT * FROM {site} UNION ALL SELECT * FROM {site} EXCEPT SELECT * FROM {site} WHERE clicks < 0",
    "SELECT * FROM (SELECT device, clicks FROM {site}) PIVOT (SUM(clicks) FOR device IN ('MOBILE', 'DESKTOP'))",
    "SELECT x FROM {site} LATERAL VIEW explode(split(page, '/')) t AS x", "SELECT v.a, d.query FROM VALUES (1), (2) AS v(a) CROSS JOIN {site} d",
    "SELECT transform(array(s.clicks), x -> x + 1) AS t, CASE WHEN s.clicks > 1 THEN 'a' END AS c, s.date::DATE AS d, h.hour FROM {site} s JOIN {site_hourly} h USING (query)",
    "SELECT DISTINCT query FROM {site} TABLESAMPLE (100 PERCENT)", "SELECT * FROM range(3)", "SELECT 1 AS one",
    "SELECT query FROM {site} WHERE query LIKE 'q%' AND regexp_like(page, '^/') AND date BETWEEN '2020-01-01' AND '2030-01-01'",
    "SELECT percentile_approx(position, 0.5) AS p, approx_count_distinct(query) AS q, date_trunc('MONTH', date::DATE) AS m FROM {site} GROUP BY ALL",
])
def test_sql_of_every_day_still_runs(store, text):
    store.sql(text, site="s1").collect()
