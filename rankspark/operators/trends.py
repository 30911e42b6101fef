"""Trends and rankings (TRD-1..3, WIN-1/2/4).

Windows are always partitioned by site and ordered by date over per-day
totals, so a window never collapses the whole table into one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.functions import expressions as X
from rankspark.functions import predicates as P
from rankspark.operators.ordering import desc, top_k


def _site_window(order: str = "date") -> Window:
    return Window.partitionBy("site_url").orderBy(order)


def moving_avg(column: str, rows: int = 7) -> Column:
    """WIN-1: mean over the current row and the ``rows - 1`` before it."""
    return F.avg(column).over(_site_window().rowsBetween(-(rows - 1), 0))


def lag_change(column: str, rows: int = 7) -> Column:
    """WIN-2: value minus the value ``rows`` rows earlier (rows, not days)."""
    return F.col(column) - F.lag(column, rows).over(_site_window())


def date_stats(perf: DataFrame) -> DataFrame:
    """AGG-11: per (site, date) totals with the distinct query count."""
    return perf.groupBy("site_url", "date").agg(
        X.total("clicks", "total_clicks"),
        X.total("impressions", "total_impressions"),
        X.mean("position", "avg_position"),
        F.countDistinct("query").alias("unique_queries"),
    )


def trend(perf: DataFrame, as_of=None, days: int | None = None) -> DataFrame:
    """TRD-1: daily stats with a 7-row moving average and change vs 7 rows earlier."""
    if as_of is not None and days is not None:
        perf = perf.where(P.last_days(as_of, days))
    return date_stats(perf).select(
        "*",
        moving_avg("total_clicks").alias("clicks_7d_avg"),
        lag_change("total_clicks").alias("clicks_wow_change"),
    )


def _shift_days(date_col: str, days: int) -> Column:
    return F.date_add(F.col(date_col).cast("date"), days).cast("string")


def hour_vs_last_week(hourly: DataFrame) -> DataFrame:
    """TRD-2 / WIN-4: clicks per (site, date, hour) next to the same hour 7
    calendar days earlier. A self equi-join on (site, hour, date - 7) of the
    per-hour totals, so gaps in the data never shift the comparison."""
    return week_before(hourly.groupBy("site_url", "date", "hour").agg(X.total("clicks")))


def week_before(per_hour: DataFrame) -> DataFrame:
    """Clicks per (site, date, hour) next to those of the same hour 7 days earlier."""
    before = per_hour.select(
        "site_url", _shift_days("date", 7).alias("date"), "hour", F.col("clicks").alias("prev_clicks")
    )
    out = per_hour.join(before, ["site_url", "date", "hour"], "left")
    return out.select("site_url", "date", "hour", "clicks", "prev_clicks",
                      (F.col("clicks") - F.col("prev_clicks")).alias("change"))


def _ranking_rows(perf: DataFrame, date_from: str, date_to: str,
                  queries: Iterable[str] | None) -> DataFrame:
    rows = perf.where(P.date_between(date_from, date_to))
    return P.filter_in(rows, "query", queries, optional=True)


def ranking_data(perf: DataFrame, date_from: str, date_to: str, queries: Iterable[str] | None = None,
                 group_by: Sequence[str] = ("query",), limit: int | None = 1000) -> DataFrame:
    """TRD-3 / AGG-12: measures by a caller-chosen grouping, top ``limit`` by clicks."""
    keys = list(group_by)
    out = _ranking_rows(perf, date_from, date_to, queries).groupBy(*keys).agg(
        X.total("clicks"), X.total("impressions"), X.mean("position", "position")
    ).select(*keys, "clicks", "impressions",
             X.ctr_pct("clicks", "impressions").alias("ctr"), "position")
    return top_k(out, [desc("clicks")], keys, limit)


def ranking_summary(perf: DataFrame, date_from: str, date_to: str, queries: Iterable[str] | None = None,
                    group_by: Sequence[str] = ("query",)) -> DataFrame:
    """TRD-3: the total group count and overall measures of ``ranking_data``.

    The group count is an exact distinct count of the grouping keys, computed
    in the same single pass as the totals.
    """
    rows = _ranking_rows(perf, date_from, date_to, queries)
    keys = list(group_by)
    per_group = rows.groupBy(*keys).agg(
        F.sum("clicks").alias("c"), F.sum("impressions").alias("i"),
        F.sum("position").alias("ps"), F.count("position").alias("pn"),
    )
    out = per_group.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("c").cast("bigint").alias("clicks"),
        F.sum("i").cast("bigint").alias("impressions"),
        F.when(F.sum("pn") > 0, F.sum("ps") / F.sum("pn")).alias("position"),
    )
    return out.select("total", "clicks", "impressions",
                      X.ctr_pct("clicks", "impressions").alias("ctr"), "position")
