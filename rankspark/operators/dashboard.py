"""Dashboard aggregations (DSH-1..5), re-aimed from the browser as DataFrame ops.

All per-site results keep ``site_url`` so many sites run in one job; the
windows are partitioned by site and run over per-day totals (one row per
site and date), never over raw fact rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.functions import expressions as X
from rankspark.functions import predicates as P
from rankspark.operators.ordering import desc, sort_by_name, top_k


def _recent(perf: DataFrame, as_of, days) -> DataFrame:
    return perf if as_of is None or days is None else perf.where(P.last_days(as_of, days))


def daily_totals(perf: DataFrame, as_of: dt.date | str | None = None, days: int | None = None,
                 ordered: bool = False) -> DataFrame:
    """DSH-1: per (site, date): clicks, impressions, ctr (%), mean position.

    Unordered by default: the KPI operators aggregate over it, and a sort
    under an aggregate is a wasted range shuffle. ``ordered=True`` sorts by
    site and date for display.
    """
    out = _recent(perf, as_of, days).groupBy("site_url", "date").agg(
        X.total("clicks"), X.total("impressions"), X.mean("position", "position")
    ).select(
        "site_url", "date", "clicks", "impressions",
        X.ctr_pct("clicks", "impressions").alias("ctr"), "position",
    )
    return out.orderBy("site_url", "date") if ordered else out


def kpi_summary(totals: DataFrame) -> DataFrame:
    """DSH-2: total clicks / impressions; mean of the daily ctr and position."""
    return totals.groupBy("site_url").agg(
        X.total("clicks"), X.total("impressions"),
        F.avg("ctr").alias("ctr"), F.avg("position").alias("position"),
    )


def kpi_change(totals: DataFrame, window_rows: int = 7) -> DataFrame:
    """DSH-3: last ``window_rows`` days vs the ones before, per site.

    Rows, not calendar days, as the dashboard counts them; only sites with at
    least two full windows. Position change is inverted (a lower position is
    better). A zero baseline gives NULL instead of a division error.
    """
    n = window_rows
    w = Window.partitionBy("site_url").orderBy(F.desc("date"))
    ranked = totals.select("*", F.row_number().over(w).alias("rn"), F.count("*").over(
        Window.partitionBy("site_url")).alias("n_days"))
    ranked = ranked.where((F.col("n_days") >= 2 * n) & (F.col("rn") <= 2 * n))
    cur = F.col("rn") <= n
    prev = ~cur

    def s(c, flag):
        return F.sum(F.when(flag, F.col(c)))

    def m(c, flag):
        return F.avg(F.when(flag, F.col(c)))

    agg = ranked.groupBy("site_url").agg(
        s("clicks", cur).alias("cur_clicks"), s("clicks", prev).alias("prev_clicks"),
        s("impressions", cur).alias("cur_impressions"), s("impressions", prev).alias("prev_impressions"),
        m("ctr", cur).alias("cur_ctr"), m("ctr", prev).alias("prev_ctr"),
        m("position", cur).alias("cur_position"), m("position", prev).alias("prev_position"),
    )
    return agg.select(
        "site_url",
        X.trailing_pct("cur_clicks", "prev_clicks").alias("clicks_change"),
        X.trailing_pct("cur_impressions", "prev_impressions").alias("impressions_change"),
        X.trailing_pct("cur_ctr", "prev_ctr").alias("ctr_change"),
        X.trailing_pct("prev_position", "cur_position").alias("position_change"),
    )


def top_pages(perf: DataFrame, as_of: dt.date | str | None = None, days: int | None = None,
              limit: int = 10) -> DataFrame:
    """DSH-4: top pages by clicks."""
    out = _recent(perf, as_of, days).groupBy("page").agg(X.total("clicks"))
    return top_k(out, [desc("clicks")], ["page"], limit)


def query_table(perf: DataFrame, as_of: dt.date | str | None = None, days: int | None = None,
                search: str = "", sort: str | None = "clicks", limit: int = 50) -> DataFrame:
    """DSH-5: per-query table with substring search and a selectable sort, top 50."""
    rows = _recent(perf, as_of, days)
    if search:
        rows = rows.where(P.contains_ci("query", search))
    out = rows.groupBy("query").agg(
        X.total("clicks"), X.total("impressions"), X.mean("position", "position")
    ).select("query", "clicks", "impressions",
             X.ctr_pct("clicks", "impressions").alias("ctr"), "position")
    return top_k(out, sort_by_name(sort), ["query"], limit)
