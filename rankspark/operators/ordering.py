"""Deterministic orderings and top-k (SRT-*).

The source reports order by one measure with no tie-breaker, so rows tied at
a LIMIT are arbitrary there. Here the grouping keys are appended ascending
(NULLs last, as the source engine sorts them), which makes every top-k result
reproducible. ``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``:
each task keeps its k best rows and only k x tasks rows reach the final merge,
so no global sort is ever run for a top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def desc(column: str) -> Column:
    return F.desc_nulls_last(column)


def asc(column: str) -> Column:
    return F.asc_nulls_last(column)


def ordered(df: DataFrame, by: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """SRT-2..4: full ordering, group keys ascending as tie-breakers."""
    return df.orderBy(*by, *[asc(k) for k in keys])


def top_k(df: DataFrame, by: Sequence[Column], keys: Sequence[str], k: int | None) -> DataFrame:
    """SRT-1: order + LIMIT k (no limit when k is None)."""
    out = ordered(df, by, keys)
    return out if k is None else out.limit(int(k))


# SRT-6: the selectable sort keys of the query table.
SORT_KEYS = {
    "clicks": lambda: [desc("clicks")],
    "impressions": lambda: [desc("impressions")],
    "ctr": lambda: [desc("ctr")],
    "position": lambda: [asc("position")],
}


def sort_by_name(name: str | None) -> list[Column]:
    return SORT_KEYS.get(name or "clicks", SORT_KEYS["clicks"])()
