"""Registered templated SQL (SRC-4), fetch plans (ING-1/2) and page display (PRJ-8)."""

import datetime as dt

from pyspark.sql import functions as F

from rankspark.functions.expressions import decode_page
from rankspark.plans.ingest import plan_daily, plan_hourly
from rankspark.queries.params import SITE, sql_str
from rankspark.registry import register
from rankspark.session import scratch_path, stored
from rankspark.sinks.fact import write_daily
from rankspark.sinks.ordered import read_ordered, write_ordered
from rankspark.sources.dictionary import index, matching
from rankspark.sources.fixtures import HOURLY_SITE, table
from rankspark.sources.store import Store

DAILY_PLAN_AS_OF = dt.date(2001, 12, 31)
HOURLY_PLAN_AS_OF = dt.date(2024, 2, 4)


@register("sql_template_daily", "SRC-4", f"""
SELECT CAST(year(date::DATE) AS INTEGER) AS year, CAST(month(date::DATE) AS INTEGER) AS month,
       CAST(SUM(clicks) AS BIGINT) AS clicks, COUNT(*) AS n_rows
FROM (SELECT * FROM daily WHERE site_url = {sql_str(SITE)}) s
WHERE clicks > 10
GROUP BY 1, 2
""")
def q_sql_daily(spark, sf_dir):
    return Store.fixtures(spark, sf_dir).sql(
        """SELECT CAST(year(date::DATE) AS INT) AS year, CAST(month(date::DATE) AS INT) AS month,
                  SUM(clicks) AS clicks, COUNT(*) AS n_rows
           FROM {site} WHERE clicks > 10 GROUP BY 1, 2""",
        site=SITE,
    )


@register("sql_template_hourly", "SRC-4", f"""
SELECT hour, CAST(SUM(clicks) AS BIGINT) AS clicks, '{{literal braces}}' AS note
FROM (SELECT * FROM hourly WHERE site_url = {sql_str(HOURLY_SITE)}) s
GROUP BY hour
""")
def q_sql_hourly(spark, sf_dir):
    return Store.fixtures(spark, sf_dir).sql(
        "SELECT hour, SUM(clicks) AS clicks, '{literal braces}' AS note FROM {site} GROUP BY hour",
        site=HOURLY_SITE, data_type="hourly",
    )


@register("sql_template_both", "SRC-4", """
SELECT 'daily' AS source, COUNT(*) AS n_rows, CAST(SUM(clicks) AS BIGINT) AS clicks FROM daily
UNION ALL
SELECT 'hourly' AS source, COUNT(*) AS n_rows, CAST(SUM(clicks) AS BIGINT) AS clicks FROM hourly
""")
def q_sql_both(spark, sf_dir):
    return Store.fixtures(spark, sf_dir).sql(
        """SELECT 'daily' AS source, COUNT(*) AS n_rows, SUM(clicks) AS clicks FROM {site}
           UNION ALL
           SELECT 'hourly' AS source, COUNT(*) AS n_rows, SUM(clicks) AS clicks FROM {site_hourly}""",
        site=None,
    )


_TOP = "SELECT query, page, date, clicks, position FROM {site} ORDER BY clicks DESC, date, query, page, device, country, impressions, position"


@register("sql_default_limit", "SRT-7", f"""
{_TOP.replace("{site}", f"(SELECT * FROM daily WHERE site_url = {sql_str(SITE)}) s")} LIMIT 100
""")
def q_sql_default_limit(spark, sf_dir):
    """A statement without a LIMIT of its own gets the endpoint's; a column or a text of that name is none."""
    return Store.fixtures(spark, sf_dir).sql(f"-- LIMIT; none\n{_TOP}", site=SITE, default_limit=100)


@register("sql_nan_to_null", "SNK-4", f"""
SELECT query, SUM(clicks) FILTER (clicks >= 10) / NULLIF(CAST(COUNT(*) FILTER (clicks >= 10) AS DOUBLE), 0) AS mean_clicks, 'a;b' AS note
FROM daily WHERE site_url = {sql_str(SITE)} GROUP BY query
""")
def q_sql_nan_to_null(spark, sf_dir):
    """Queries without a large row have no mean: NaN in the statement, NULL in the result."""
    return Store.fixtures(spark, sf_dir).sql(
        """SELECT query, CASE WHEN count_if(clicks >= 10) = 0 THEN CAST('NaN' AS DOUBLE)
                              ELSE SUM(CASE WHEN clicks >= 10 THEN clicks END) / CAST(count_if(clicks >= 10) AS DOUBLE) END AS mean_clicks, 'a;b' AS note
           FROM {site} GROUP BY query""", site=SITE, nan_to_null=True)


_ALL_PAIRS = f"""SELECT page, query, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions
FROM daily GROUP BY page, query"""


@register("ordered_export", "SRT-2", f"""
SELECT *, ROW_NUMBER() OVER (ORDER BY clicks DESC, page, query) - 1 AS row_no FROM ({_ALL_PAIRS}) t
""", writes=True)
def q_ordered_export(spark, sf_dir):
    """All groups sorted and written as files in order, read back with their places."""
    path = scratch_path(spark, "ordered")
    pairs = Store.fixtures(spark, sf_dir).daily().groupBy("page", "query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    pairs = stored(pairs, "pairs")
    write_ordered(pairs, path, [F.desc("clicks"), F.asc("page"), F.asc("query")], rows_per_file=500)
    return read_ordered(spark, path, pairs.schema)


@register("ordered_page", "SRT-2", f"""
SELECT *, ROW_NUMBER() OVER (ORDER BY clicks DESC, page, query) - 1 AS row_no FROM ({_ALL_PAIRS}) t QUALIFY row_no BETWEEN 600 AND 649
""", writes=True)
def q_ordered_page(spark, sf_dir):
    """One screen out of the middle of the sorted result, read from the file that holds it."""
    path = scratch_path(spark, "ordered")
    pairs = Store.fixtures(spark, sf_dir).daily().groupBy("page", "query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    pairs = stored(pairs, "pairs")
    write_ordered(pairs, path, [F.desc("clicks"), F.asc("page"), F.asc("query")], rows_per_file=500)
    return read_ordered(spark, path, pairs.schema, 600, 50)


@register("dictionary_search", "FLT-5", """
SELECT 'like' AS mode, site_url, date, query, page, clicks FROM daily WHERE query LIKE '%et bo_t%' UNION ALL
SELECT 'contains' AS mode, site_url, date, query, page, clicks FROM daily WHERE lower(query) LIKE '%d wid%' UNION ALL
SELECT 'ilike' AS mode, site_url, date, query, page, clicks FROM daily WHERE query ILIKE 'BLUE%' AND date >= '1997-01-01'
""", writes=True)
def q_dictionary_search(spark, sf_dir):
    """Substring searches through the dictionary of queries; one of the three commits has none yet."""
    root, facts = scratch_path(spark, "dictionary"), Store.fixtures(spark, sf_dir).daily()
    for low, high in (("0", "1994"), ("1994", "1996")):
        write_daily(facts.where((F.col("date") >= low) & (F.col("date") < high)), root)
    index(spark, root, "daily")
    write_daily(facts, root)
    store, out = Store.at(spark, root), None
    for mode, pattern, since in (("like", "%et bo_t%", None), ("contains", "d Wid", None), ("ilike", "BLUE%", "1997-01-01")):
        found = matching(store, pattern, mode, since=since).select(F.lit(mode).alias("mode"), "site_url", "date", "query", "page", "clicks")
        out = found if out is None else out.unionByName(found)
    return out


def _spine_sql(table_name: str, start: dt.date, end: dt.date) -> str:
    return f"""
    SELECT s.site_url, strftime(t.d, '%Y-%m-%d') AS date
    FROM (SELECT DISTINCT site_url FROM {table_name}) s,
         generate_series(TIMESTAMP '{start} 00:00:00', TIMESTAMP '{end} 00:00:00', INTERVAL 1 DAY) AS t(d)"""


@register("plan_daily", "ING-1", f"""
WITH spine AS ({_spine_sql("daily", DAILY_PLAN_AS_OF - dt.timedelta(days=480),
                           DAILY_PLAN_AS_OF - dt.timedelta(days=1))})
SELECT site_url, date FROM spine
WHERE NOT EXISTS (SELECT 1 FROM daily x WHERE x.site_url = spine.site_url AND x.date = spine.date)
ORDER BY site_url, date
""")
def q_plan_daily(spark, sf_dir):
    store = Store.fixtures(spark, sf_dir)
    return plan_daily(store.units("daily"), store.units("daily"), DAILY_PLAN_AS_OF)


@register("plan_hourly", "ING-2", f"""
WITH spine AS ({_spine_sql("hourly", HOURLY_PLAN_AS_OF - dt.timedelta(days=9), HOURLY_PLAN_AS_OF)}),
seen AS (SELECT site_url, date, MAX(hour) AS max_hour FROM hourly GROUP BY site_url, date)
SELECT spine.site_url, spine.date FROM spine
LEFT JOIN seen ON seen.site_url = spine.site_url AND seen.date = spine.date
WHERE COALESCE(seen.max_hour, -1) <> 23
ORDER BY 1, 2
""")
def q_plan_hourly(spark, sf_dir):
    store = Store.fixtures(spark, sf_dir)
    return plan_hourly(store.units("hourly"), store.units("hourly"), HOURLY_PLAN_AS_OF)


@register("display_pages", "PRJ-8", """
SELECT page_id, url_decode(replace(url, '/', '%2F')) AS page FROM pages
""")
def q_display_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", decode_page(F.replace("url", F.lit("/"), F.lit("%2F"))).alias("page"))
