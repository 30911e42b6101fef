"""Registered dashboard and trend queries DSH-1..5, TRD-1..3."""

from pyspark.sql import functions as F

from rankspark.functions.predicates import floor_date
from rankspark.operators import dashboard as D
from rankspark.operators import trends as TR
from rankspark.queries.params import AS_OF, DAYS, SITE, sql_str
from rankspark.registry import register
from rankspark.sources.store import Store

FLOOR = floor_date(AS_OF, DAYS)


def _site(spark, sf_dir):
    return Store.fixtures(spark, sf_dir).daily(SITE)


def _r9(df, *cols):
    # Means of arbitrary doubles depend on summation order; compare at 9 places.
    for c in cols:
        df = df.withColumn(c, F.round(c, 9))
    return df


_DAILY_TOTALS_SQL = """
SELECT site_url, date, CAST(SUM(clicks) AS BIGINT) AS clicks,
       CAST(SUM(impressions) AS BIGINT) AS impressions,
       CASE WHEN SUM(impressions) > 0
            THEN CAST(SUM(clicks) AS DOUBLE) / CAST(SUM(impressions) AS DOUBLE) * 100 ELSE 0.0 END AS ctr,
       AVG(position) AS position
FROM {src}
GROUP BY site_url, date
"""
_SITE_RECENT = f"(SELECT * FROM daily WHERE site_url = {sql_str(SITE)} AND date >= '{FLOOR}')"


@register("daily_totals", "DSH-1", _DAILY_TOTALS_SQL.format(src=_SITE_RECENT))
def q_daily_totals(spark, sf_dir):
    return D.daily_totals(_site(spark, sf_dir), AS_OF, DAYS, ordered=True)


@register("kpi_summary", "DSH-2", f"""
WITH t AS ({_DAILY_TOTALS_SQL.format(src=_SITE_RECENT)})
SELECT site_url, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
       ROUND(AVG(ctr), 9) AS ctr, ROUND(AVG(position), 9) AS position
FROM t GROUP BY site_url
""")
def q_kpi_summary(spark, sf_dir):
    return _r9(D.kpi_summary(D.daily_totals(_site(spark, sf_dir), AS_OF, DAYS)), "ctr", "position")


def _kpi_oracle(src):
    return f"""
WITH t AS ({_DAILY_TOTALS_SQL.format(src=src)}),
r AS (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY site_url ORDER BY date DESC) AS rn,
           COUNT(*) OVER (PARTITION BY site_url) AS n_days
    FROM t
),
a AS (
    SELECT site_url,
           SUM(CASE WHEN rn <= 7 THEN clicks END) AS cur_clicks,
           SUM(CASE WHEN rn > 7 THEN clicks END) AS prev_clicks,
           SUM(CASE WHEN rn <= 7 THEN impressions END) AS cur_impressions,
           SUM(CASE WHEN rn > 7 THEN impressions END) AS prev_impressions,
           AVG(CASE WHEN rn <= 7 THEN ctr END) AS cur_ctr,
           AVG(CASE WHEN rn > 7 THEN ctr END) AS prev_ctr,
           AVG(CASE WHEN rn <= 7 THEN position END) AS cur_position,
           AVG(CASE WHEN rn > 7 THEN position END) AS prev_position
    FROM r WHERE n_days >= 14 AND rn <= 14
    GROUP BY site_url
)
SELECT site_url,
       ROUND(CAST(cur_clicks - prev_clicks AS DOUBLE) / NULLIF(CAST(prev_clicks AS DOUBLE), 0) * 100, 9) AS clicks_change,
       ROUND(CAST(cur_impressions - prev_impressions AS DOUBLE) / NULLIF(CAST(prev_impressions AS DOUBLE), 0) * 100, 9)
           AS impressions_change,
       ROUND((cur_ctr - prev_ctr) / NULLIF(prev_ctr, 0) * 100, 9) AS ctr_change,
       ROUND((prev_position - cur_position) / NULLIF(cur_position, 0) * 100, 9) AS position_change
FROM a
"""


@register("kpi_change", "DSH-3", _kpi_oracle("hourly"))
def q_kpi_change(spark, sf_dir):
    totals = D.daily_totals(Store.fixtures(spark, sf_dir).hourly())
    return _r9(D.kpi_change(totals), "clicks_change", "impressions_change", "ctr_change", "position_change")


@register("kpi_change_daily", "DSH-3", _kpi_oracle("daily"))
def q_kpi_change_daily(spark, sf_dir):
    totals = D.daily_totals(Store.fixtures(spark, sf_dir).daily())
    return _r9(D.kpi_change(totals), "clicks_change", "impressions_change", "ctr_change", "position_change")


@register("top_pages", "DSH-4", f"""
SELECT page, CAST(SUM(clicks) AS BIGINT) AS clicks
FROM {_SITE_RECENT} s
GROUP BY page
ORDER BY clicks DESC, page ASC
LIMIT 10
""")
def q_top_pages(spark, sf_dir):
    return D.top_pages(_site(spark, sf_dir), AS_OF, DAYS, limit=10)


@register("query_table", "DSH-5", f"""
SELECT query, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
       CASE WHEN SUM(impressions) > 0
            THEN CAST(SUM(clicks) AS DOUBLE) / CAST(SUM(impressions) AS DOUBLE) * 100 ELSE 0.0 END AS ctr,
       AVG(position) AS position
FROM {_SITE_RECENT} s
WHERE contains(lower(query), 'bolt')
GROUP BY query
ORDER BY position ASC, query ASC
LIMIT 50
""")
def q_query_table(spark, sf_dir):
    return D.query_table(_site(spark, sf_dir), AS_OF, DAYS, search="BOLT", sort="position", limit=50)


def _trend_oracle(rows):
    return f"""
WITH day AS (
    SELECT site_url, date, CAST(SUM(clicks) AS BIGINT) AS total_clicks, CAST(SUM(impressions) AS BIGINT) AS total_impressions,
           AVG(position) AS avg_position, COUNT(DISTINCT query) AS unique_queries,
           ROW_NUMBER() OVER (PARTITION BY site_url ORDER BY date) AS n
    FROM {rows} s GROUP BY site_url, date
)
SELECT d.site_url, d.date, d.total_clicks, d.total_impressions, d.avg_position, d.unique_queries,
       ROUND(AVG(w.total_clicks), 9) AS clicks_7d_avg, ANY_VALUE(d.total_clicks) - MAX(b.total_clicks) AS clicks_wow_change
FROM day d JOIN day w ON w.site_url = d.site_url AND w.n BETWEEN d.n - 6 AND d.n
LEFT JOIN day b ON b.site_url = d.site_url AND b.n = d.n - 7
GROUP BY ALL
"""


@register("trend_7d", "TRD-1", _trend_oracle(_SITE_RECENT))
def q_trend(spark, sf_dir):
    return _r9(TR.trend(_site(spark, sf_dir), AS_OF, DAYS), "clicks_7d_avg")


@register("trend_all_sites", "TRD-1", _trend_oracle(f"(SELECT * FROM daily WHERE date >= '{floor_date(AS_OF, DAYS)}')"))
def q_trend_all_sites(spark, sf_dir):
    return _r9(TR.trend(Store.fixtures(spark, sf_dir).daily(), AS_OF, DAYS), "clicks_7d_avg")


@register("hour_vs_last_week", "TRD-2", """
WITH h AS (
    SELECT site_url, date, hour, CAST(SUM(clicks) AS BIGINT) AS clicks
    FROM hourly GROUP BY site_url, date, hour
)
SELECT cur.site_url, cur.date, cur.hour, cur.clicks, prev.clicks AS prev_clicks,
       cur.clicks - prev.clicks AS change
FROM h cur
LEFT JOIN h prev
  ON prev.site_url = cur.site_url AND prev.hour = cur.hour
 AND CAST(prev.date AS DATE) + INTERVAL 7 DAY = CAST(cur.date AS DATE)
""")
def q_hour_vs_last_week(spark, sf_dir):
    return TR.hour_vs_last_week(Store.fixtures(spark, sf_dir).hourly())


RANK_FROM, RANK_TO = "1997-01-01", "1997-12-31"


@register("ranking_data", "TRD-3", f"""
SELECT page, device, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
       CASE WHEN SUM(impressions) > 0
            THEN CAST(SUM(clicks) AS DOUBLE) / CAST(SUM(impressions) AS DOUBLE) * 100 ELSE 0.0 END AS ctr,
       AVG(position) AS position
FROM daily
WHERE site_url = {sql_str(SITE)} AND date BETWEEN '{RANK_FROM}' AND '{RANK_TO}'
GROUP BY page, device
ORDER BY clicks DESC, page ASC, device ASC
LIMIT 25
""")
def q_ranking_data(spark, sf_dir):
    return TR.ranking_data(_site(spark, sf_dir), RANK_FROM, RANK_TO, group_by=("page", "device"), limit=25)


@register("ranking_summary", "TRD-3", f"""
SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT page, device FROM daily
        WHERE site_url = {sql_str(SITE)} AND date BETWEEN '{RANK_FROM}' AND '{RANK_TO}')) AS total,
       CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
       CASE WHEN SUM(impressions) > 0
            THEN CAST(SUM(clicks) AS DOUBLE) / CAST(SUM(impressions) AS DOUBLE) * 100 ELSE 0.0 END AS ctr,
       AVG(position) AS position
FROM daily
WHERE site_url = {sql_str(SITE)} AND date BETWEEN '{RANK_FROM}' AND '{RANK_TO}'
""")
def q_ranking_summary(spark, sf_dir):
    return TR.ranking_summary(_site(spark, sf_dir), RANK_FROM, RANK_TO, group_by=("page", "device"))
