"""The canned reports (RPT-1..6).

Each takes the fact DataFrame of one site (``store.daily(site)``) and returns
a DataFrame. Plans are filter -> partial HashAggregate -> shuffle on the
grouping keys -> final HashAggregate -> TakeOrderedAndProject (or Sort when
there is no limit). Partial aggregation runs before the shuffle, so a hot
page or query only ever ships one partial row per task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.functions import expressions as X
from rankspark.functions import predicates as P
from rankspark.operators.ordering import asc, desc, ordered, top_k


def page_queries(perf: DataFrame, page: str, as_of: dt.date | str, days: int = 30,
                 limit: int | None = 50) -> DataFrame:
    """RPT-1: search queries of one page over the last ``days`` days."""
    out = (
        perf.where(P.eq("page", page) & P.last_days(as_of, days))
        .groupBy("query")
        .agg(X.total("clicks"), X.total("impressions"), X.mean("position", "avg_position"))
    )
    return top_k(out, [desc("impressions")], ["query"], limit)


def keyword_pages(perf: DataFrame, keyword: str, as_of: dt.date | str, days: int = 30) -> DataFrame:
    """RPT-2: pages ranking for one keyword, all of them, by clicks."""
    out = (
        perf.where(P.eq("query", keyword) & P.last_days(as_of, days))
        .groupBy("page")
        .agg(
            X.mean("position", "avg_position"),
            X.total("clicks", "total_clicks"),
            X.total("impressions", "total_impressions"),
        )
    )
    return ordered(out, [desc("total_clicks")], ["page"])


def search_keywords(perf: DataFrame, pattern: str, as_of: dt.date | str, days: int = 30,
                    limit: int | None = 100) -> DataFrame:
    """RPT-3: queries matching a case-sensitive LIKE pattern."""
    out = (
        perf.where(P.like("query", pattern) & P.last_days(as_of, days))
        .groupBy("query")
        .agg(
            X.total("clicks", "total_clicks"),
            X.total("impressions", "total_impressions"),
            X.mean("position", "avg_position"),
        )
    )
    return top_k(out, [desc("total_impressions")], ["query"], limit)


def best_pages(perf: DataFrame, as_of: dt.date | str, days: int = 30, limit: int | None = 20) -> DataFrame:
    """RPT-4: best pages by clicks, with CTR in percent."""
    out = (
        perf.where(P.last_days(as_of, days))
        .groupBy("page")
        .agg(
            X.total("clicks", "total_clicks"),
            X.total("impressions", "total_impressions"),
            X.mean("position", "avg_position"),
        )
        .withColumn("ctr", X.ctr_pct("total_clicks", "total_impressions"))
    )
    return top_k(out, [desc("total_clicks")], ["page"], limit)


def track_pages(perf: DataFrame, pages: Iterable[str], as_of: dt.date | str,
                keywords: Iterable[str] | None = None, days: int = 30) -> DataFrame:
    """RPT-5: daily rows of listed pages (and optionally listed keywords)."""
    rows = P.filter_in(perf, "page", pages)
    rows = P.filter_in(rows, "query", keywords, optional=True)
    out = (
        rows.where(P.last_days(as_of, days))
        .groupBy("date", "page", "query")
        .agg(X.total("clicks"), X.total("impressions"), X.mean("position", "position"))
    )
    return ordered(out, [desc("date"), desc("clicks")], ["page", "query"])


def pages_queries(perf: DataFrame, pages: Iterable[str]) -> DataFrame:
    """RPT-6: every query the listed pages rank for, all time."""
    out = (
        P.filter_in(perf, "page", pages)
        .groupBy("page", "query")
        .agg(X.total("clicks"), X.total("impressions"), X.mean("position", "avg_position"))
    )
    return out.orderBy(asc("page"), desc("impressions"), asc("query"))


def measures(perf: DataFrame, *keys: str, ctr: bool = False) -> DataFrame:
    """AGG-1..5/9: the standard measures grouped by any keys (none = global)."""
    aggs = [X.total("clicks"), X.total("impressions"), X.mean("position", "avg_position")]
    if ctr:
        aggs.append(X.mean("ctr", "average_ctr"))
    return perf.groupBy(*keys).agg(*aggs)


def uniques(perf: DataFrame, *columns: str, approx: bool = False) -> DataFrame:
    """AGG-6: exact (or approximate) distinct counts of several columns together."""
    fn = F.approx_count_distinct if approx else F.countDistinct
    return perf.agg(*[fn(c).alias(f"unique_{c}") for c in columns])
