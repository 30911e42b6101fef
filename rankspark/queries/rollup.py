"""Registered reports over rollups: the facts are stored in several commits, and the reports read sums and sketches."""

from pyspark.sql import functions as F

from rankspark.operators import rollups as RO
from rankspark.operators.compare import compare_periods
from rankspark.queries.dashboard import _trend_oracle
from rankspark.queries.params import AS_OF, SITE, sql_str
from rankspark.registry import register
from rankspark.session import scratch_path
from rankspark.sinks.fact import compact, write_daily, write_hourly
from rankspark.sources.store import Store


def _daily_store(spark, sf_dir):
    """The daily facts in two commits, the second of days that come late, and compacted in between."""
    root, facts = scratch_path(spark, "rollup-daily"), Store.fixtures(spark, sf_dir).daily()
    late = F.col("date").like("%-15")
    write_daily(facts.where(~late & (F.col("date") < "1995-01-01")), root)
    write_daily(facts.where(~late & (F.col("date") >= "1995-01-01")), root)
    compact(spark, root, "daily")
    write_daily(facts, root)
    return Store.at(spark, root)


@register("rollup_trend", "TRD-1", _trend_oracle("daily"), writes=True)
def q_rollup_trend(spark, sf_dir):
    """The trend of all sites from rollups; days have few enough queries for their sketches to be exact."""
    return RO.trend(_daily_store(spark, sf_dir).rollup()).withColumn("clicks_7d_avg", F.round("clicks_7d_avg", 9))


_LONG = {"period1": {"start": "1993-01-01", "end": "1995-06-30"}, "period2": {"start": "1995-01-01", "end": "1997-12-31"}}


@register("rollup_compare", "CMP-1", f"""
SELECT CAST(SUM(clicks) FILTER (date BETWEEN '1993-01-01' AND '1995-06-30') AS BIGINT) AS period1_clicks,
       CAST(SUM(impressions) FILTER (date BETWEEN '1995-01-01' AND '1997-12-31') AS BIGINT) AS period2_impressions,
       AVG(position) FILTER (date BETWEEN '1993-01-01' AND '1995-06-30') AS period1_position,
       AVG(position) FILTER (date BETWEEN '1995-01-01' AND '1997-12-31') AS period2_position,
       true AS period1_queries_close, true AS period2_queries_close, true AS period1_pages_close, true AS period2_pages_close
FROM daily WHERE site_url = {sql_str(SITE)}
""", writes=True)
def q_rollup_compare(spark, sf_dir):
    """Two long periods compared from rollups; the distinct counts are held against exact ones (5 %, three standard errors)."""
    store = _daily_store(spark, sf_dir)
    told = RO.compare_periods(store.rollup(site=SITE), AS_OF, "custom", _LONG)
    counts = [f"period{k}_{c}" for k in (1, 2) for c in ("queries", "pages")]
    exact = compare_periods(store.daily(SITE), AS_OF, "custom", _LONG).select("period1_start", *(F.col(c).alias(f"exact_{c}") for c in counts))
    close = [(F.abs(F.col(c) - F.col(f"exact_{c}")) <= 0.05 * F.col(f"exact_{c}")).alias(f"{c}_close") for c in counts]
    return told.join(exact, "period1_start").select("period1_clicks", "period2_impressions", "period1_position", "period2_position", *close)


@register("rollup_hour_vs_last_week", "TRD-2", """
WITH h AS (
    SELECT site_url, date, hour, CAST(SUM(clicks) + CASE WHEN date LIKE '%5' THEN COUNT(*) ELSE 0 END AS BIGINT) AS clicks
    FROM hourly WHERE hour <= 12 OR date LIKE '%5' GROUP BY site_url, date, hour
)
SELECT cur.site_url, cur.date, cur.hour, cur.clicks, prev.clicks AS prev_clicks, cur.clicks - prev.clicks AS change
FROM h cur LEFT JOIN h prev
  ON prev.site_url = cur.site_url AND prev.hour = cur.hour AND CAST(prev.date AS DATE) + INTERVAL 7 DAY = CAST(cur.date AS DATE)
""", writes=True)
def q_rollup_hour_vs_last_week(spark, sf_dir):
    """Hours up to noon, some days then replaced by whole ones with one more click a row: the rollup follows the commits."""
    root, facts = scratch_path(spark, "rollup-hourly"), Store.fixtures(spark, sf_dir).hourly()
    write_hourly(facts.where("hour <= 12"), root)
    write_hourly(facts.where(F.col("date").like("%5")).withColumn("clicks", F.col("clicks") + 1), root)
    return RO.hour_vs_last_week(Store.at(spark, root).rollup("hourly"))
