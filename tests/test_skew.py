"""A skewed fact: one query holds over a third of all rows, one day a large share."""

import pytest
from pyspark.sql import functions as F

from rankspark.operators import compare as C
from rankspark.operators import keywords as K
from rankspark.operators import reports as R
from rankspark.schema import DAILY
from rankspark.sources.landing import assemble_pages, fetch_status, flatten_daily, to_response_pages


@pytest.fixture(scope="module")
def skewed(spark):
    n = 60_000
    df = spark.range(n).select(
        F.lit("sc-domain:hot.example").alias("site_url"),
        F.when(F.col("id") % 2 == 0, F.lit("2024-03-15"))
         .otherwise(F.format_string("2024-03-%02d", (F.col("id") % 28 + 1).cast("int"))).alias("date"),
        F.when(F.col("id") % 5 < 2, F.lit("hot query")).otherwise(F.format_string("q%d", F.col("id") % 97)).alias("query"),
        F.format_string("/p%d", F.col("id") % 13).alias("page"),
        F.when(F.col("id") % 3 == 0, "MOBILE").otherwise("DESKTOP").alias("device"),
        F.format_string("c%d", F.col("id")).alias("country"),   # keeps the logical key unique
        (F.col("id") % 7).alias("clicks"),
        (F.col("id") % 7 + 10).alias("impressions"),
        ((F.col("id") % 7) / (F.col("id") % 7 + 10)).alias("ctr"),
        (1 + (F.col("id") % 40) * 0.25).alias("position"),
    )
    return spark.createDataFrame(df.rdd, DAILY).cache()


def test_hot_query_reports_are_exact(skewed):
    rows = skewed.collect()
    hot = [r for r in rows if r.query == "hot query"]
    assert len(hot) > len(rows) / 3
    out = {r.query: r for r in R.search_keywords(skewed, "%", "2024-03-31", days=60, limit=None).collect()}
    assert out["hot query"].total_clicks == sum(r.clicks for r in hot)
    cmp = C.compare_periods(skewed, "2024-03-31", "custom",
                            {"period1": {"start": "2024-03-01", "end": "2024-03-15"},
                             "period2": {"start": "2024-03-15", "end": "2024-03-31"}}).first()
    assert cmp.period1_clicks == sum(r.clicks for r in rows if r.date <= "2024-03-15")
    loss = K.page_traffic_loss(skewed, ("2024-03-15", "2024-03-16"), ("2024-03-16", "2024-04-01"))
    assert loss.count() > 0


def test_hot_day_replays_through_many_pages(skewed):
    # The hot day (over half the rows) is numbered in page-sized buckets, not in one window.
    pages = to_response_pages(skewed, page_limit=1000)
    st = fetch_status(pages, 1000).where("date = '2024-03-15'").first()
    hot_rows = skewed.where("date = '2024-03-15'").count()
    assert st.complete and st.n_rows == hot_rows and st.n_pages >= hot_rows // 1000
    back = flatten_daily(assemble_pages(pages, 1000))
    assert back.exceptAll(skewed).count() == 0 and skewed.exceptAll(back).count() == 0
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan
