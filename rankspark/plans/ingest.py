"""Fetch plans (ING-1..3): which (site, date) units still need a fetch.

The source walks dates one by one and checks a file per day. Here the plan is
a DataFrame: a date spine per site generated by ``sequence`` + ``explode``
(one generator row per site, no cross join), anti-joined with the units
already stored, which a store knows from its manifest (``Store.units``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.functions.predicates import date_between, iso
from rankspark.schema import DAILY_HISTORY_DAYS, HOURLY_HISTORY_DAYS, LAST_HOUR

SITE_SCHEMA = T.StructType([T.StructField("site_url", T.StringType())])


def _d(x) -> dt.date:
    return dt.date.fromisoformat(x) if isinstance(x, str) else x


def site_frame(spark: SparkSession, sites) -> DataFrame:
    if isinstance(sites, DataFrame):
        return sites.select("site_url").distinct()
    return spark.createDataFrame([(s,) for s in dict.fromkeys(sites)], SITE_SCHEMA)


def date_spine(sites: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """ING-3: every (site, date) with start <= date <= end, dates as ISO strings."""
    days = F.sequence(F.lit(iso(start)).cast("date"), F.lit(iso(end)).cast("date"),
                      F.expr("INTERVAL 1 DAY"))
    return sites.select("site_url", F.explode(days).alias("d")).select(
        "site_url", F.col("d").cast("string").alias("date"))


def plan_daily(units: DataFrame, sites: Iterable[str] | DataFrame, as_of: dt.date | str,
               history_days: int = DAILY_HISTORY_DAYS, settle_days: int = 0) -> DataFrame:
    """ING-1: dates in [as_of - history_days, as_of - 1] not yet stored, per site;
    ``units`` has the stored (site_url, date). The last ``settle_days`` dates, which the source may
    still revise, are listed whether stored or not (write them with ``open_since``).

    A day that returned no rows was never written, so it stays in the plan
    (ING-5). Order: site, then oldest date first.
    """
    spark = units.sparkSession
    start = _d(as_of) - dt.timedelta(days=history_days)
    end = _d(as_of) - dt.timedelta(days=1)
    spine = date_spine(site_frame(spark, sites), start, end)
    settled = _d(as_of) - dt.timedelta(days=settle_days + 1)
    stored = units.where(date_between(start, min(end, settled))).select("site_url", "date").distinct()
    return spine.join(stored, ["site_url", "date"], "left_anti").orderBy("site_url", "date")


def plan_hourly(units: DataFrame, sites: Iterable[str] | DataFrame, as_of: dt.date | str,
                history_days: int = HOURLY_HISTORY_DAYS) -> DataFrame:
    """ING-2: dates in [as_of - (history_days - 1), as_of] whose stored hours do
    not reach 23 (absent, empty or incomplete days are all re-fetched); ``units`` has
    (site_url, date, max_hour)."""
    spark = units.sparkSession
    start = _d(as_of) - dt.timedelta(days=history_days - 1)
    end = _d(as_of)
    spine = date_spine(site_frame(spark, sites), start, end)
    complete = units.where(date_between(start, end) & (F.col("max_hour") == LAST_HOUR)).select("site_url", "date").distinct()
    return spine.join(complete, ["site_url", "date"], "left_anti").orderBy("site_url", "date")
