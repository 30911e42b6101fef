"""Registered ad-hoc queries ADH-1..5, AGG-8, and the scans SRC-3/5."""

from pyspark.sql import functions as F

from rankspark.functions.predicates import date_between, floor_date
from rankspark.operators import adhoc as A
from rankspark.queries.params import AS_OF, HOURLY_AS_OF, SITE, sql_str
from rankspark.registry import register
from rankspark.schema import DAILY_COLUMNS
from rankspark.sources.store import Store

_ALL_DAILY = ", ".join(DAILY_COLUMNS)
_NEWEST = ("date DESC, clicks DESC, site_url ASC, query ASC, page ASC, device ASC, country ASC, "
           "impressions ASC, ctr ASC, position ASC")


@register("top_rows", "ADH-1", f"""
SELECT {_ALL_DAILY}
FROM daily
WHERE site_url = {sql_str(SITE)} AND clicks > 49
ORDER BY {_NEWEST}
LIMIT 10
""")
def q_top_rows(spark, sf_dir):
    perf = Store.fixtures(spark, sf_dir).daily(SITE)
    return A.top_rows(perf, 49, limit=10)


@register("find_rows_ilike", "ADH-2", f"""
SELECT {_ALL_DAILY}
FROM daily
WHERE query ILIKE '%GEAR%' AND clicks > 49
ORDER BY date DESC
""")
def q_find_rows(spark, sf_dir):
    return A.find_rows(Store.fixtures(spark, sf_dir).daily(), "%GEAR%", 49)


@register("hour_profile", "ADH-3", """
SELECT hour, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions
FROM hourly
GROUP BY hour
ORDER BY hour
""")
def q_hour_profile(spark, sf_dir):
    return A.hour_profile(Store.fixtures(spark, sf_dir).hourly())


@register("rows_at_hour", "ADH-4", """
SELECT * FROM hourly WHERE hour = 9
""")
def q_rows_at_hour(spark, sf_dir):
    return A.rows_at_hour(Store.fixtures(spark, sf_dir).hourly(), 9)


@register("rows_on_date", "ADH-4", f"""
SELECT {_ALL_DAILY} FROM daily WHERE date = '{AS_OF}'
""")
def q_rows_on_date(spark, sf_dir):
    return A.rows_on_date(Store.fixtures(spark, sf_dir).daily(), AS_OF.isoformat())


def _fresh_oracle(hourly_sql, as_of):
    per_day = """SELECT site_url, date, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
                        AVG(position) AS avg_position, '{source}' AS source, {rank} AS rank FROM {table} GROUP BY site_url, date"""
    recent = f"(SELECT * FROM {hourly_sql} x WHERE date BETWEEN '{floor_date(as_of, 30)}' AND '{as_of}') h"
    return f"""
SELECT site_url, date, clicks, impressions, avg_position, source FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY site_url, date ORDER BY rank DESC) AS n FROM (
        {per_day.format(source="daily", rank="2", table="daily")}
        UNION ALL
        {per_day.format(source="hourly", rank="CASE WHEN MAX(hour) = 23 THEN 3 ELSE 1 END", table=recent)}))
WHERE n = 1"""


@register("fresh_daily_totals", "ADH-5", _fresh_oracle("hourly", HOURLY_AS_OF))
def q_fresh_daily_totals(spark, sf_dir):
    store = Store.fixtures(spark, sf_dir)
    return A.fresh_daily_totals(store.daily(), store.hourly(), HOURLY_AS_OF, recent_days=30)


# One daily site with hourly rows on the same dates: even days reach hour 23, odd days stop
# at 20, and dates two years on have hourly rows only.
_SHARED_HOURS = f"""(
    SELECT site_url, CASE WHEN clicks % 10 = 0 THEN concat('2000', substr(date, 5)) ELSE date END AS date,
           CASE WHEN CAST(substr(date, 9, 2) AS INTEGER) % 2 = 0 THEN 23 ELSE 20 END AS hour,
           clicks + 1 AS clicks, impressions, position
    FROM daily WHERE site_url = {sql_str(SITE)} AND date BETWEEN '{floor_date(AS_OF, 60)}' AND '{AS_OF}')"""
_SHARED_AS_OF = AS_OF.replace(year=2000)


def _shared_hours(daily):
    odd_day = F.substring("date", 9, 2).cast("int") % 2
    date = F.when(F.col("clicks") % 10 == 0, F.concat(F.lit("2000"), F.substring("date", 5, 6))).otherwise(F.col("date"))
    rows = daily.where((F.col("site_url") == SITE) & date_between(floor_date(AS_OF, 60), AS_OF))
    return rows.select("site_url", date.alias("date"), F.when(odd_day == 0, 23).otherwise(20).alias("hour"),
                       (F.col("clicks") + 1).alias("clicks"), "impressions", "position")


@register("fresh_totals_shared", "ADH-5", _fresh_oracle(_SHARED_HOURS, AS_OF))
def q_fresh_totals_shared(spark, sf_dir):
    daily = Store.fixtures(spark, sf_dir).daily()
    return A.fresh_daily_totals(daily, _shared_hours(daily), AS_OF, recent_days=30)


@register("fresh_totals_hourly_only", "ADH-5", _fresh_oracle(_SHARED_HOURS, _SHARED_AS_OF))
def q_fresh_totals_hourly_only(spark, sf_dir):
    daily = Store.fixtures(spark, sf_dir).daily()
    return A.fresh_daily_totals(daily, _shared_hours(daily), _SHARED_AS_OF, recent_days=30)


@register("hourly_to_daily", "AGG-8", """
SELECT site_url, date, query, page, device, country,
       CAST(SUM(clicks) AS BIGINT) AS clicks,
       CAST(SUM(impressions) AS BIGINT) AS impressions,
       CASE WHEN SUM(impressions) > 0
            THEN CAST(SUM(clicks) AS DOUBLE) / CAST(SUM(impressions) AS DOUBLE) ELSE 0.0 END AS ctr,
       AVG(position) AS position
FROM hourly
GROUP BY site_url, date, query, page, device, country
""")
def q_hourly_to_daily(spark, sf_dir):
    return A.hourly_to_daily(Store.fixtures(spark, sf_dir).hourly())


@register("sites", "SRC-5", """
SELECT site_url FROM (SELECT site_url FROM daily UNION SELECT site_url FROM hourly) ORDER BY site_url
""")
def q_sites(spark, sf_dir):
    return Store.fixtures(spark, sf_dir).sites()


@register("all_sites_scan", "SRC-3", f"""
SELECT {_ALL_DAILY} FROM daily
""")
def q_all_sites_scan(spark, sf_dir):
    return Store.fixtures(spark, sf_dir).daily()


@register("hours_seen", "AGG-10", """
SELECT site_url, date, MAX(hour) AS max_hour FROM hourly GROUP BY site_url, date
""")
def q_hours_seen(spark, sf_dir):
    return A.hours_seen(Store.fixtures(spark, sf_dir).hourly())
