"""Scalar and aggregate expressions shared by the reports (PRJ-*, AGG measures).

Ratios are DOUBLE and totals BIGINT throughout. Averages of ``position`` and
``ctr`` are plain means over stored rows (device x country x day), not
impression-weighted, as in the source reports.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


# -- aggregate measures ----------------------------------------------------

def total(column: str, alias: str | None = None) -> Column:
    return F.sum(column).cast("bigint").alias(alias or column)


def mean(column: str, alias: str) -> Column:
    return F.avg(column).alias(alias)


def ctr_pct(clicks: str | Column, impressions: str | Column) -> Column:
    """PRJ-2: clicks / impressions * 100, 0 when impressions is not > 0."""
    c, i = _c(clicks), _c(impressions)
    return F.when(i > 0, c.cast("double") / i.cast("double") * F.lit(100.0)).otherwise(F.lit(0.0))


def pct_change(before: str | Column, after: str | Column) -> Column:
    """PRJ-3: (after - before) / before * 100; 0 when before is not > 0 or NULL."""
    a, b = _c(before), _c(after)
    return F.when(a > 0, (b - a).cast("double") / a.cast("double") * F.lit(100.0)).otherwise(F.lit(0.0))


def diff(before: str | Column, after: str | Column) -> Column:
    """PRJ-4: after - before (NULL when either is NULL)."""
    return _c(after) - _c(before)


def loss(before: str | Column, after: str | Column) -> Column:
    """PRJ-6: coalesce(before, 0) - coalesce(after, 0)."""
    return F.coalesce(_c(before), F.lit(0)) - F.coalesce(_c(after), F.lit(0))


def trailing_pct(current: str | Column, previous: str | Column) -> Column:
    """PRJ-10: (current - previous) / previous * 100, NULL instead of a division by 0."""
    cur, prev = _c(current), _c(previous)
    return F.try_divide((cur - prev).cast("double"), prev.cast("double")) * F.lit(100.0)


# -- display (PRJ-8 / PRJ-9) -------------------------------------------------

def decode_page(column: str | Column = "page") -> Column:
    """Percent-decode a page for display, keeping a literal ``+``.

    ``url_decode`` turns ``+`` into a space, so ``+`` is protected first; a
    malformed escape leaves the raw value.
    """
    raw = _c(column)
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.coalesce(decoded, raw)


def display_number(column: str | Column, decimals: int = 0) -> Column:
    """Thousands separators and fixed decimals; ``-`` for NULL / NaN."""
    c = _c(column)
    bad = c.isNull() | F.isnan(c.cast("double"))
    return F.when(bad, F.lit("-")).otherwise(F.format_number(c, decimals))


def truncate(column: str | Column, n: int) -> Column:
    """Cut to ``n`` characters and append ``...`` when longer."""
    c = _c(column)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
