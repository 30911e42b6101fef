"""The reports that need only totals and distinct counts, over rollups instead of facts.

Same columns as their twins over facts; sums, means and changes are equal to theirs, distinct counts come from
sketches (``sources.rollup`` states the error). They read a row per (site, date), however many facts there are.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions import expressions as X
from rankspark.functions import predicates as P
from rankspark.operators.trends import lag_change, moving_avg, week_before
from rankspark.operators.compare import comparison
from rankspark.plans.periods import Periods, period_bounds


def _mean(total: str, n: str, flag: Column | None = None) -> Column:
    pick = (lambda c: F.col(c)) if flag is None else (lambda c: F.when(flag, F.col(c)))
    return F.when(F.sum(pick(n)) > 0, F.sum(pick(total)) / F.sum(pick(n)))


def _distinct(sketch: str, flag: Column | None = None) -> Column:
    merged = F.hll_union_agg(sketch if flag is None else F.when(flag, F.col(sketch)))
    return F.coalesce(F.hll_sketch_estimate(merged), F.lit(0)).cast("long")


def date_stats(rollup: DataFrame) -> DataFrame:
    """AGG-11 over a rollup."""
    return rollup.groupBy("site_url", "date").agg(
        X.total("clicks", "total_clicks"), X.total("impressions", "total_impressions"),
        _mean("position_sum", "n_positions").alias("avg_position"), _distinct("queries").alias("unique_queries"))


def daily_totals(rollup: DataFrame) -> DataFrame:
    """DSH-1 over a rollup; the KPI operators take its result."""
    out = rollup.groupBy("site_url", "date").agg(
        X.total("clicks"), X.total("impressions"), _mean("position_sum", "n_positions").alias("position"))
    return out.select("site_url", "date", "clicks", "impressions", X.ctr_pct("clicks", "impressions").alias("ctr"), "position")


def trend(rollup: DataFrame, as_of: dt.date | str | None = None, days: int | None = None) -> DataFrame:
    """TRD-1 over a rollup."""
    rows = rollup if as_of is None or days is None else rollup.where(P.last_days(as_of, days))
    return date_stats(rows).select("*", moving_avg("total_clicks").alias("clicks_7d_avg"), lag_change("total_clicks").alias("clicks_wow_change"))


def hour_vs_last_week(rollup: DataFrame) -> DataFrame:
    """TRD-2 over an hourly rollup."""
    return week_before(rollup.groupBy("site_url", "date", "hour").agg(X.total("clicks")))


def uniques(rollup: DataFrame) -> DataFrame:
    """AGG-6 over a rollup: distinct queries and pages of all its units."""
    return rollup.agg(_distinct("queries").alias("unique_query"), _distinct("pages").alias("unique_page"))


def compare_periods(rollup: DataFrame, as_of: dt.date | str | None = None, period_type: str = "week",
                    custom: dict | None = None, periods: Periods | None = None) -> DataFrame:
    """CMP-1 over a rollup: two long periods are compared without reading a fact."""
    p = periods or period_bounds(as_of, period_type, custom)
    in1, in2 = P.date_between(p.period1_start, p.period1_end), P.date_between(p.period2_start, p.period2_end)
    aggs = []
    for name, flag in (("period1", in1), ("period2", in2)):
        aggs += [F.sum(F.when(flag, F.col(c))).cast("bigint").alias(f"{name}_{c}") for c in ("clicks", "impressions")]
        aggs += [_mean("position_sum", "n_positions", flag).alias(f"{name}_position")]
        aggs += [_distinct(c, flag).alias(f"{name}_{c}") for c in ("queries", "pages")]
    return comparison(rollup.where(in1 | in2).agg(*aggs), p)
