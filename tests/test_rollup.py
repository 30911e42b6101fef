"""Rollups follow the commits, equal recomputation, and their reports equal those over facts."""

import pytest
from pyspark.sql import functions as F

from rankspark.operators import compare as C
from rankspark.operators import dashboard as D
from rankspark.operators import rollups as RO
from rankspark.operators import trends as TR
from rankspark.schema import DAILY
from rankspark.sinks.fact import compact, publish, vacuum, write_batch, write_daily, write_hourly
from rankspark.sources.fixtures import HOURLY_SITE
from rankspark.sources.log import CommitLog
from rankspark.sources.rollup import SUMS, summarize
from rankspark.sources.store import Store
from tests.conftest import SF_SMALL
from tests.test_log import daily, hourly


def rows(rollup, *keys):
    est = [F.hll_sketch_estimate(c).alias(c) for c in ("queries", "pages")]
    return sorted(map(tuple, rollup.select(*keys, *SUMS, *est).collect()))


def same_as_recomputed(spark, root, kind):
    keys = ["site_url", "date"] + (["hour"] if kind == "hourly" else [])
    store = Store.at(spark, root)
    assert rows(store.rollup(kind), *keys) == rows(summarize(store.table(kind), kind), *keys)


def test_rollup_after_replace_late_days_and_compaction(spark, tmp_path):
    root = str(tmp_path)
    write_hourly(hourly(spark, ["2024-01-01", "2024-01-02"], range(10), 1), root)
    same_as_recomputed(spark, root, "hourly")
    write_hourly(hourly(spark, ["2024-01-01"], range(24), 2), root)  # replaces a day
    write_hourly(hourly(spark, ["2023-12-31"], range(24), 5), root)  # comes late
    same_as_recomputed(spark, root, "hourly")
    assert Store.at(spark, root).rollup("hourly").where("date = '2024-01-01'").agg(F.sum("clicks")).first()[0] == 48
    compact(spark, root, "hourly")
    same_as_recomputed(spark, root, "hourly")
    assert vacuum(spark, root, "hourly", older_than_hours=-1) > 3
    same_as_recomputed(spark, root, "hourly")


def test_rollup_of_a_day_in_many_files_and_batches(spark, tmp_path):
    root = str(tmp_path)
    large = daily(spark, [("s", "2024-01-01"), ("t", "2024-01-01")], n=90)
    log = CommitLog(spark, root, "daily")
    publish(log, write_batch(log, large, large.groupBy("date").agg(F.count("*").alias("n")), rows_per_file=50))
    write_daily(daily(spark, [("s", "2024-01-02")], n=10), root)
    same_as_recomputed(spark, root, "daily")
    compact(spark, root, "daily", rows_per_file=80)
    assert len(Store.at(spark, root).daily().inputFiles()) >= 3
    same_as_recomputed(spark, root, "daily")
    r = Store.at(spark, root).rollup("daily", "s", since="2024-01-01", until="2024-01-01").first()
    assert (r.site_url, r.n_rows) == ("s", 90)
    assert Store.at(spark, str(tmp_path / "none")).rollup().count() == 0


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    root, views = str(tmp_path_factory.mktemp("rollup")), Store.fixtures(spark, SF_SMALL)
    write_daily(views.daily(), root)
    write_hourly(views.hourly(), root)
    return Store.at(spark, root), views


def equal(a, b, *rounded):
    for c in rounded:
        a, b = a.withColumn(c, F.round(c, 9)), b.withColumn(c, F.round(c, 9))
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_reports_over_rollups_equal_those_over_facts(stores):
    store, views = stores
    equal(RO.trend(store.rollup(), "1998-06-17", 365), TR.trend(views.daily(), "1998-06-17", 365), "clicks_7d_avg")
    equal(RO.daily_totals(store.rollup()), D.daily_totals(views.daily()))
    equal(D.kpi_summary(RO.daily_totals(store.rollup())), D.kpi_summary(D.daily_totals(views.daily())), "ctr", "position")
    equal(RO.hour_vs_last_week(store.rollup("hourly", HOURLY_SITE)), TR.hour_vs_last_week(views.hourly()))
    custom = {"period1": {"start": "1998-01-01", "end": "1998-03-31"}, "period2": {"start": "2005-01-01", "end": "2005-06-30"}}
    equal(RO.compare_periods(store.rollup(), "1998-06-17", "custom", custom), C.compare_periods(views.daily(), "1998-06-17", "custom", custom))
    equal(RO.trend(views.rollup()), TR.trend(views.daily()), "clicks_7d_avg")  # facts in memory


def test_reports_over_rollups_read_no_facts(stores):
    store, _ = stores
    for df in (RO.trend(store.rollup()), RO.compare_periods(store.rollup(), "1998-06-17", "month")):
        assert df.inputFiles() and all("/_rollups/" in f or "/_manifests/" in f for f in df.inputFiles())


def test_error_of_the_sketches_is_as_stated(spark, tmp_path):
    # 40 sets of 5,000 to 200,000 distinct queries: the relative error has a deviation of about 1.6 %.
    facts = spark.range(40 * 5000).selectExpr(
        "concat('s', id % 40) site_url", "'2024-01-01' date", "concat('q', id) query", "concat('/p', id % 300) page", "'M' device", "'x' country",
        "1L clicks", "2L impressions", "0.5D ctr", "1D position").select(*DAILY.fieldNames())
    told = summarize(facts, "daily").select("site_url", F.hll_sketch_estimate("queries").alias("q"), F.hll_sketch_estimate("pages").alias("p")).collect()
    errors = [r.q / 5000 - 1 for r in told]
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.025 and max(map(abs, errors)) < 0.065
    assert all(abs(r.p - len({i % 300 for i in range(int(r.site_url[1:]), 200_000, 40)})) <= 1 for r in told)
    whole = RO.uniques(summarize(facts, "daily")).first()
    assert abs(whole.unique_query / 200_000 - 1) < 0.05 and whole.unique_page == 300
