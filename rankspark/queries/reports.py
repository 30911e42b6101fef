"""Registered report queries RPT-1..6."""

from rankspark.functions.predicates import floor_date
from rankspark.operators import reports as R
from rankspark.queries.params import (
    ALL_TIME_FLOOR, AS_OF, DAYS, KEYWORDS, PAGES, SITE, sql_list, sql_str,
)
from rankspark.registry import register
from rankspark.sources.store import Store

FLOOR = floor_date(AS_OF, DAYS)
ALL_TIME_DAYS = (AS_OF - ALL_TIME_FLOOR).days


def _site(spark, sf_dir):
    return Store.fixtures(spark, sf_dir).daily(SITE)


@register("best_pages", "RPT-4", f"""
SELECT page,
       CAST(SUM(clicks) AS BIGINT) AS total_clicks,
       CAST(SUM(impressions) AS BIGINT) AS total_impressions,
       AVG(position) AS avg_position,
       CASE WHEN SUM(impressions) > 0
            THEN CAST(SUM(clicks) AS DOUBLE) / CAST(SUM(impressions) AS DOUBLE) * 100
            ELSE 0.0 END AS ctr
FROM daily
WHERE site_url = {sql_str(SITE)} AND date >= '{FLOOR}'
GROUP BY page
ORDER BY total_clicks DESC, page ASC
LIMIT 20
""")
def q_best_pages(spark, sf_dir):
    return R.best_pages(_site(spark, sf_dir), AS_OF, days=DAYS, limit=20)


@register("page_queries", "RPT-1", f"""
SELECT query,
       CAST(SUM(clicks) AS BIGINT) AS clicks,
       CAST(SUM(impressions) AS BIGINT) AS impressions,
       AVG(position) AS avg_position
FROM daily
WHERE site_url = {sql_str(SITE)} AND page = '/economy/Brand-17' AND date >= '{FLOOR}'
GROUP BY query
ORDER BY impressions DESC, query ASC
LIMIT 50
""")
def q_page_queries(spark, sf_dir):
    return R.page_queries(_site(spark, sf_dir), "/economy/Brand-17", AS_OF, days=DAYS, limit=50)


@register("keyword_pages", "RPT-2", f"""
SELECT page,
       AVG(position) AS avg_position,
       CAST(SUM(clicks) AS BIGINT) AS total_clicks,
       CAST(SUM(impressions) AS BIGINT) AS total_impressions
FROM daily
WHERE site_url = {sql_str(SITE)} AND query = 'blue bolt' AND date >= '{FLOOR}'
GROUP BY page
ORDER BY total_clicks DESC, page ASC
""")
def q_keyword_pages(spark, sf_dir):
    return R.keyword_pages(_site(spark, sf_dir), "blue bolt", AS_OF, days=DAYS)


@register("search_keywords", "RPT-3", f"""
SELECT query,
       CAST(SUM(clicks) AS BIGINT) AS total_clicks,
       CAST(SUM(impressions) AS BIGINT) AS total_impressions,
       AVG(position) AS avg_position
FROM daily
WHERE site_url = {sql_str(SITE)} AND query LIKE '%gear%' AND date >= '{FLOOR}'
GROUP BY query
ORDER BY total_impressions DESC, query ASC
LIMIT 100
""")
def q_search_keywords(spark, sf_dir):
    return R.search_keywords(_site(spark, sf_dir), "%gear%", AS_OF, days=DAYS, limit=100)


@register("track_pages", "RPT-5", f"""
SELECT date, page, query,
       CAST(SUM(clicks) AS BIGINT) AS clicks,
       CAST(SUM(impressions) AS BIGINT) AS impressions,
       AVG(position) AS position
FROM daily
WHERE site_url = {sql_str(SITE)} AND page IN ({sql_list(PAGES)}) AND date >= '{FLOOR}'
GROUP BY date, page, query
ORDER BY date DESC, clicks DESC
""")
def q_track_pages(spark, sf_dir):
    return R.track_pages(_site(spark, sf_dir), PAGES, AS_OF, keywords=None, days=DAYS)


@register("track_pages_all_keywords", "RPT-5", f"""
SELECT date, page, query,
       CAST(SUM(clicks) AS BIGINT) AS clicks,
       CAST(SUM(impressions) AS BIGINT) AS impressions,
       AVG(position) AS position
FROM daily
WHERE site_url = {sql_str(SITE)} AND page IN ({sql_list(PAGES)})
  AND query IN ({sql_list(KEYWORDS)}) AND date >= '{floor_date(AS_OF, ALL_TIME_DAYS)}'
GROUP BY date, page, query
ORDER BY date DESC, clicks DESC
""")
def q_track_pages_kw(spark, sf_dir):
    return R.track_pages(_site(spark, sf_dir), PAGES, AS_OF, keywords=KEYWORDS, days=ALL_TIME_DAYS)


@register("pages_queries", "RPT-6", f"""
SELECT page, query,
       CAST(SUM(clicks) AS BIGINT) AS clicks,
       CAST(SUM(impressions) AS BIGINT) AS impressions,
       AVG(position) AS avg_position
FROM daily
WHERE site_url = {sql_str(SITE)} AND page IN ({sql_list(PAGES)})
GROUP BY page, query
ORDER BY page, impressions DESC
""")
def q_pages_queries(spark, sf_dir):
    return R.pages_queries(_site(spark, sf_dir), PAGES)
