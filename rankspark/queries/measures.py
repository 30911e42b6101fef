"""Registered measure groupings (AGG-3/5/6), the fetch spine (ING-3), sort keys
(SRT-6) and display / export projections (PRJ-9, SNK-3)."""

from pyspark.sql import functions as F

from rankspark.functions.expressions import display_number, truncate
from rankspark.functions.predicates import floor_date
from rankspark.operators import dashboard as D
from rankspark.operators import reports as R
from rankspark.plans.ingest import date_spine
from rankspark.queries.params import AS_OF, DAYS, SITE, sql_str
from rankspark.registry import register
from rankspark.sinks.export import csv_frame
from rankspark.sources.store import Store

FLOOR = floor_date(AS_OF, DAYS)
_SITE_RECENT = f"(SELECT * FROM daily WHERE site_url = {sql_str(SITE)} AND date >= '{FLOOR}')"


def _site(spark, sf_dir):
    return Store.fixtures(spark, sf_dir).daily(SITE)


def _recent(spark, sf_dir):
    from rankspark.functions.predicates import last_days

    return _site(spark, sf_dir).where(last_days(AS_OF, DAYS))


@register("measures_page_query", "AGG-3", f"""
SELECT page, query, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
       AVG(position) AS avg_position, ROUND(AVG(ctr), 9) AS average_ctr
FROM {_SITE_RECENT} s
GROUP BY page, query
""")
def q_measures_page_query(spark, sf_dir):
    out = R.measures(_recent(spark, sf_dir), "page", "query", ctr=True)
    return out.withColumn("average_ctr", F.round("average_ctr", 9))


@register("measures_global", "AGG-5", f"""
SELECT CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
       AVG(position) AS avg_position
FROM {_SITE_RECENT} s
""")
def q_measures_global(spark, sf_dir):
    return R.measures(_recent(spark, sf_dir))


@register("measures_global_empty", "AGG-5", f"""
SELECT CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
       AVG(position) AS avg_position
FROM daily WHERE site_url = {sql_str(SITE)} AND date >= '2100-01-01'
""")
def q_measures_global_empty(spark, sf_dir):
    from rankspark.functions.predicates import last_days

    return R.measures(_site(spark, sf_dir).where(last_days("2100-01-31", 30)))


@register("unique_counts", "AGG-6", f"""
SELECT COUNT(DISTINCT query) AS unique_query, COUNT(DISTINCT page) AS unique_page
FROM {_SITE_RECENT} s
""")
def q_unique_counts(spark, sf_dir):
    return R.uniques(_recent(spark, sf_dir), "query", "page")


@register("fetch_spine", "ING-3", """
SELECT s.site_url, strftime(t.d, '%Y-%m-%d') AS date
FROM (SELECT DISTINCT site_url FROM daily) s,
     generate_series(TIMESTAMP '2001-01-01 00:00:00', TIMESTAMP '2001-01-31 00:00:00', INTERVAL 1 DAY) AS t(d)
""")
def q_fetch_spine(spark, sf_dir):
    sites = Store.fixtures(spark, sf_dir).daily().select("site_url").distinct()
    return date_spine(sites, "2001-01-01", "2001-01-31")


@register("query_table_ctr", "SRT-6", f"""
SELECT query, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
       CASE WHEN SUM(impressions) > 0
            THEN CAST(SUM(clicks) AS DOUBLE) / CAST(SUM(impressions) AS DOUBLE) * 100 ELSE 0.0 END AS ctr,
       AVG(position) AS position
FROM {_SITE_RECENT} s
GROUP BY query
ORDER BY ctr DESC, query ASC
LIMIT 50
""")
def q_query_table_ctr(spark, sf_dir):
    return D.query_table(_site(spark, sf_dir), AS_OF, DAYS, search="", sort="ctr", limit=50)


@register("display_top_pages", "PRJ-9", f"""
WITH t AS (
    SELECT page, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions
    FROM {_SITE_RECENT} s GROUP BY page ORDER BY clicks DESC, page ASC LIMIT 10
)
SELECT CASE WHEN length(page) > 12 THEN concat(left(page, 12), '...') ELSE page END AS page,
       format('{{:,}}', clicks) AS clicks, format('{{:,}}', impressions) AS impressions
FROM t
""")
def q_display_top_pages(spark, sf_dir):
    top = R.measures(_recent(spark, sf_dir), "page")
    from rankspark.operators.ordering import top_k, desc

    top = top_k(top, [desc("clicks")], ["page"], 10)
    return top.select(truncate("page", 12).alias("page"),
                      display_number("clicks", 0).alias("clicks"),
                      display_number("impressions", 0).alias("impressions"))


@register("export_csv_frame", "SNK-3", f"""
WITH t AS (
    SELECT query, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
           CASE WHEN SUM(impressions) > 0
                THEN CAST(SUM(clicks) AS DOUBLE) / CAST(SUM(impressions) AS DOUBLE) * 100 ELSE 0.0 END AS ctr,
           AVG(position) AS position
    FROM {_SITE_RECENT} s GROUP BY query ORDER BY clicks DESC, query ASC LIMIT 50
)
SELECT query AS "Query", clicks AS "Clicks", impressions AS "Impressions",
       printf('%.2f', round(ctr, 2)) AS "CTR", printf('%.1f', round(position, 1)) AS "Position"
FROM t
""")
def q_export_csv_frame(spark, sf_dir):
    return csv_frame(D.query_table(_site(spark, sf_dir), AS_OF, DAYS, sort="clicks", limit=50))
