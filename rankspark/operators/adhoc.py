"""Saved ad-hoc queries (ADH-1..5) and hourly rollups (AGG-7/8/10)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions import expressions as X
from rankspark.functions import predicates as P
from rankspark.operators.ordering import asc, desc
from rankspark.schema import DAILY_COLUMNS, DIMENSIONS, LAST_HOUR


def _newest_first(df: DataFrame) -> list:
    """Newest first, then every other column, so a LIMIT picks a fixed row set."""
    rest = [c for c in df.columns if c not in ("date", "clicks")]
    return [desc("date"), desc("clicks"), *[asc(c) for c in rest]]


def top_rows(perf: DataFrame, min_clicks: int, limit: int | None = 10) -> DataFrame:
    """ADH-1: rows over a click threshold, newest first (top-k, no global sort)."""
    rows = perf.where(P.greater_than("clicks", min_clicks))
    return rows.orderBy(desc("date")) if limit is None else rows.orderBy(*_newest_first(rows)).limit(int(limit))


def find_rows(perf: DataFrame, pattern: str, min_clicks: int) -> DataFrame:
    """ADH-2: case-insensitive query pattern plus click threshold, newest first."""
    return perf.where(P.ilike("query", pattern) & P.greater_than("clicks", min_clicks)).orderBy(desc("date"))


def hour_profile(hourly: DataFrame) -> DataFrame:
    """ADH-3 / AGG-7: clicks and impressions by hour of day."""
    return hourly.groupBy("hour").agg(X.total("clicks"), X.total("impressions"))


def rows_at_hour(hourly: DataFrame, hour: int) -> DataFrame:
    """ADH-4: hourly rows at one hour, of all dates."""
    return hourly.where(P.at_hour(hour))


def rows_on_date(perf: DataFrame, date: str) -> DataFrame:
    """ADH-4: rows of one date."""
    return perf.where(P.on_date(date))


def hours_seen(hourly: DataFrame) -> DataFrame:
    """AGG-10: latest hour stored per (site, date); 23 means the day is complete."""
    return hourly.groupBy("site_url", "date").agg(F.max("hour").alias("max_hour"))


def hourly_to_daily(hourly: DataFrame) -> DataFrame:
    """AGG-8: roll hourly rows up to the daily grain, in the daily schema.

    ``ctr`` is recomputed as the fraction clicks / impressions (0 without
    impressions); ``position`` is the unweighted mean over the hourly rows.
    """
    out = hourly.groupBy("site_url", "date", *DIMENSIONS).agg(
        X.total("clicks"), X.total("impressions"), X.mean("position", "position")
    )
    ctr = F.when(F.col("impressions") > 0,
                 F.col("clicks").cast("double") / F.col("impressions").cast("double")).otherwise(0.0)
    return out.withColumn("ctr", ctr).select(*DAILY_COLUMNS)


def _date_totals(df: DataFrame, rank: Column, source: str) -> DataFrame:
    return df.groupBy("site_url", "date").agg(
        X.total("clicks"), X.total("impressions"), X.mean("position", "avg_position"), rank.alias("rank")
    ).select("site_url", "date", "rank", F.struct("clicks", "impressions", "avg_position", F.lit(source).alias("source")).alias("totals"))


def fresh_daily_totals(daily: DataFrame, hourly: DataFrame, as_of: dt.date | str,
                       recent_days: int = 30) -> DataFrame:
    """ADH-5: per (site, date) totals, the best there is for each date: a recent hourly day that
    reaches hour 23, else the daily table, else a recent hourly day that is still partial.

    Each table is aggregated once to a row per (site, date); one more aggregate picks by rank.
    """
    recent = hourly.where(P.date_between(P.floor_date(as_of, recent_days), P.iso(as_of)))
    whole_day = F.when(F.max("hour") == LAST_HOUR, 3).otherwise(1)
    both = _date_totals(daily, F.lit(2), "daily").unionByName(_date_totals(recent, whole_day, "hourly"))
    return both.groupBy("site_url", "date").agg(F.max_by("totals", "rank").alias("t")).select("site_url", "date", "t.*")
