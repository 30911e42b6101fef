"""Report operators on micro-fixtures, checked against brute force in Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rankspark.operators import adhoc as A
from rankspark.operators import compare as C
from rankspark.operators import dashboard as D
from rankspark.operators import keywords as K
from rankspark.operators import reports as R
from rankspark.operators import trends as TR
from rankspark.plans.periods import period_bounds
from rankspark.schema import DAILY, HOURLY

SITE = "sc-domain:t.example"


def daily_rows(rows):
    """rows: (date, query, page, clicks, impressions, position[, device])."""
    out = []
    for r in rows:
        d, q, p, c, i, pos = r[:6]
        dev = r[6] if len(r) > 6 else "MOBILE"
        out.append((SITE, d, q, p, dev, "twn", c, i, (c / i) if i else 0.0, pos))
    return out


@pytest.fixture()
def perf(spark):
    rows = [
        ("2024-01-10", "a", "/p1", 10, 100, 1.0),
        ("2024-01-10", "a", "/p1", 5, 50, 2.0, "DESKTOP"),
        ("2024-01-11", "b", "/p1", 7, 70, 3.0),
        ("2024-01-12", "b", "/p2", 7, 10, 4.0),
        ("2024-01-12", "c", "/p2", 0, 0, 5.0),
        ("2023-12-01", "a", "/p3", 100, 1000, 1.0),
        ("2024-01-12", None, "/p3", 1, 2, 6.0),
    ]
    return spark.createDataFrame(daily_rows(rows), DAILY)


def test_page_queries_and_ties(perf):
    out = R.page_queries(perf, "/p1", "2024-01-31", days=30, limit=1).collect()
    # a: 150 impressions, b: 70 -> a first
    assert [(r.query, r.clicks, r.impressions, r.avg_position) for r in out] == [("a", 15, 150, 1.5)]
    # Tie at the limit: /p2 has b(10) vs c(0) impressions; with ties keys decide ascending.
    out = R.page_queries(perf, "/p2", "2024-01-31", days=30, limit=5).collect()
    assert [r.query for r in out] == ["b", "c"]


def test_best_pages_ctr_zero_impressions(spark):
    rows = daily_rows([("2024-01-10", "x", "/z", 0, 0, 1.0), ("2024-01-10", "y", "/y", 1, 4, 1.0)])
    df = spark.createDataFrame(rows, DAILY)
    out = {r.page: r.ctr for r in R.best_pages(df, "2024-01-31", 30).collect()}
    assert out == {"/z": 0.0, "/y": 25.0}


def test_search_keywords_null_query_sorted_last(perf):
    out = R.search_keywords(perf, "%", "2024-01-31", days=60).collect()
    assert [r.query for r in out] == ["a", "b", "c"]  # NULL never matches LIKE
    out = R.pages_queries(perf, ["/p3"]).collect()
    assert [r.query for r in out] == ["a", None]


def test_track_pages_filters(perf):
    out = R.track_pages(perf, ["/p1", None], "2024-01-31", keywords=["a"], days=30).collect()
    assert [(r.date, r.query, r.clicks) for r in out] == [("2024-01-10", "a", 15)]
    assert R.track_pages(perf, [], "2024-01-31").count() == 0


def test_keyword_gap_keeps_duplicates_and_null(spark, perf):
    out = K.keyword_gap(perf, ["a", "zz", "zz", None, "c"]).collect()
    assert sorted([r.query for r in out], key=lambda x: (x is None, x)) == ["zz", "zz", None]


def test_keyword_coverage_excludes(perf):
    out = K.keyword_coverage(perf, ["a", "b"], exclude=("%2%",)).collect()
    assert sorted((r.query, r.page, r.total_clicks) for r in out) == [("a", "/p1", 15), ("a", "/p3", 100), ("b", "/p1", 7)]


def test_keyword_coverage_takes_a_frame(spark, perf):
    listed = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("zz",)], "keyword string")
    out = K.keyword_coverage(perf, listed, exclude=("%2%",))
    assert sorted(out.collect()) == sorted(K.keyword_coverage(perf, ["a", "b"], exclude=("%2%",)).collect())
    assert K.keyword_coverage(perf, listed.limit(0)).count() == 0


def test_traffic_loss_matches_join_semantics(spark):
    rows = daily_rows([
        ("2025-03-05", "q1", "/a", 10, 10, 1.0),
        ("2025-07-05", "q1", "/a", 4, 10, 1.0),
        ("2025-03-06", "q2", "/a", 3, 10, 1.0),
        ("2025-07-06", "q3", "/b", 50, 10, 1.0),   # only in B: not reported
        ("2025-03-07", None, "/c", 5, 10, 1.0),    # NULL query never joins B
        ("2025-07-07", None, "/c", 5, 10, 1.0),
        ("2025-03-08", "q4", "/d", 1, 10, 1.0),
        ("2025-07-08", "q4", "/d", 9, 10, 1.0),    # negative loss
    ])
    df = spark.createDataFrame(rows, DAILY)
    a, b = ("2025-03-01", "2025-04-01"), ("2025-07-01", "2025-08-01")
    out = {(r.page, r.query): r.traffic_loss for r in K.traffic_loss(df, a, b).collect()}
    assert out == {("/a", "q1"): 6, ("/a", "q2"): 3, ("/c", None): 5}
    pages = {r.page: (r.traffic_loss, r.top_query, r.top_query_loss)
             for r in K.page_traffic_loss(df, a, b).collect()}
    assert pages == {"/a": (9, "q1", 6), "/c": (5, None, 5)}


def test_compare_periods_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(400):
        d = dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(0, 60))
        rows.append((d.isoformat(), rnd.choice("abcdef"), rnd.choice(["/1", "/2", "/3"]),
                     rnd.randrange(0, 20), rnd.randrange(1, 200), rnd.randrange(1, 40) / 4))
    df = spark.createDataFrame(daily_rows(rows), DAILY)
    for ptype, custom in [("week", None), ("month", None),
                          ("custom", {"period1": {"start": "2024-01-05", "end": "2024-02-10"},
                                      "period2": {"start": "2024-02-01", "end": "2024-02-20"}}),
                          ("custom", {"period1": {"start": "2030-01-01", "end": "2030-01-31"},
                                      "period2": {"start": "2024-02-01", "end": "2024-02-20"}})]:
        got = C.compare_periods(df, "2024-02-21", ptype, custom).first().asDict()
        p = period_bounds("2024-02-21", ptype, custom)

        def stats(s, e):
            sel = [r for r in rows if s <= r[0] <= e]
            if not sel:
                return None, None, None, 0, 0
            return (sum(r[3] for r in sel), sum(r[4] for r in sel), sum(r[5] for r in sel) / len(sel),
                    len({r[1] for r in sel}), len({r[2] for r in sel}))

        c1, i1, p1, q1, g1 = stats(p.period1_start, p.period1_end)
        c2, i2, p2, q2, g2 = stats(p.period2_start, p.period2_end)
        assert (got["period1_clicks"], got["period2_clicks"]) == (c1, c2)
        assert (got["period1_impressions"], got["period2_impressions"]) == (i1, i2)
        assert got["period1_position"] == pytest.approx(p1) if p1 is not None else got["period1_position"] is None
        assert (got["period1_queries"], got["period2_queries"], got["period1_pages"], got["period2_pages"]) == (q1, q2, g1, g2)
        exp_pct = ((c2 - c1) / c1 * 100) if (c1 and c1 > 0 and c2 is not None) else (None if (c1 and c1 > 0) else 0.0)
        assert got["clicks_change_pct"] == pytest.approx(exp_pct) if exp_pct is not None else got["clicks_change_pct"] is None
        assert list(got) == list(C.OUTPUT_COLUMNS)


def test_compare_periods_empty_input_one_row(spark):
    df = spark.createDataFrame([], DAILY)
    r = C.compare_periods(df, "2024-02-21", "week").collect()
    assert len(r) == 1
    r = r[0]
    assert r.period1_clicks is None and r.clicks_change is None and r.clicks_change_pct == 0.0
    assert r.period1_queries == 0 and r.period2_pages == 0


def test_fresh_daily_totals_prefers_hourly_for_recent_dates(spark):
    daily = spark.createDataFrame(daily_rows([
        ("2024-01-01", "a", "/1", 1, 10, 1.0),
        ("2024-01-30", "a", "/1", 2, 20, 1.0),
    ]), DAILY)
    hourly = spark.createDataFrame([
        (SITE, "2024-01-30", 3, "a", "/1", "MOBILE", "twn", 5, 50, 0.1, 2.0),
        (SITE, "2024-01-30", 23, "a", "/1", "MOBILE", "twn", 6, 60, 0.1, 4.0),
        (SITE, "2024-01-01", 4, "a", "/1", "MOBILE", "twn", 9, 60, 0.1, 4.0),   # before the recent days
        (SITE, "2024-01-29", 7, "a", "/1", "MOBILE", "twn", 4, 60, 0.1, 4.0),   # partial, no daily row
        (SITE, "2024-01-28", 7, "a", "/1", "MOBILE", "twn", 4, 60, 0.1, 4.0),   # partial beside a daily row
    ], HOURLY)
    daily = daily.unionByName(daily.limit(1).withColumn("date", F.lit("2024-01-28")).withColumn("clicks", F.lit(100).cast("long")))
    out = {r.date: (r.clicks, r.source) for r in A.fresh_daily_totals(daily, hourly, "2024-01-31", 10).collect()}
    assert out == {"2024-01-01": (1, "daily"), "2024-01-30": (11, "hourly"), "2024-01-29": (4, "hourly"), "2024-01-28": (100, "daily")}


def test_kpi_change_needs_two_windows(spark):
    days = [(f"2024-01-{d:02d}", "a", "/1", d, 100, 1.0) for d in range(1, 15)]
    df = spark.createDataFrame(daily_rows(days), DAILY)
    r = D.kpi_change(D.daily_totals(df)).first()
    cur = sum(range(8, 15))
    prev = sum(range(1, 8))
    assert r.clicks_change == pytest.approx((cur - prev) / prev * 100)
    assert r.impressions_change == 0.0
    short = spark.createDataFrame(daily_rows(days[:13]), DAILY)
    assert D.kpi_change(D.daily_totals(short)).count() == 0


def test_query_table_sorts(perf):
    out = D.query_table(perf, search="", sort="position", limit=2).collect()
    assert [r.query for r in out] == ["a", "b"]
    out = D.query_table(perf, search="B", sort="impressions").collect()
    assert [r.query for r in out] == ["b"]


def test_hour_vs_last_week_is_calendar_based(spark):
    hourly = spark.createDataFrame([
        (SITE, "2024-01-01", 9, "a", "/1", "M", "twn", 3, 5, 0.1, 1.0),
        (SITE, "2024-01-08", 9, "a", "/1", "M", "twn", 5, 5, 0.1, 1.0),
        (SITE, "2024-01-09", 9, "a", "/1", "M", "twn", 7, 5, 0.1, 1.0),
    ], HOURLY)
    out = {r.date: (r.prev_clicks, r.change) for r in TR.hour_vs_last_week(hourly).collect()}
    assert out == {"2024-01-01": (None, None), "2024-01-08": (3, 2), "2024-01-09": (None, None)}


def test_trend_window_and_lag(spark):
    days = [(f"2024-01-{d:02d}", "a", "/1", d, 100, 1.0) for d in range(1, 11)]
    df = spark.createDataFrame(daily_rows(days), DAILY)
    out = {r.date: (r.clicks_7d_avg, r.clicks_wow_change) for r in TR.trend(df).collect()}
    assert out["2024-01-10"] == (pytest.approx(sum(range(4, 11)) / 7), 7)
    assert out["2024-01-03"] == (2.0, None)


def test_ranking_data_and_summary(perf):
    out = TR.ranking_data(perf, "2024-01-01", "2024-01-31", group_by=("page",), limit=1).collect()
    assert [(r.page, r.clicks) for r in out] == [("/p1", 22)]
    s = TR.ranking_summary(perf, "2024-01-01", "2024-01-31", queries=["a", "b"], group_by=("page",)).first()
    assert (s.total, s.clicks, s.impressions) == (2, 29, 230)
