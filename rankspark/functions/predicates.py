"""Row predicates of the reports (FLT-*), as Column expressions.

Values are bound as literals, never formatted into SQL text, so quotes and
backslashes in user input keep their meaning.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Candidate escape characters for LIKE. The source engine's LIKE has no escape
# character at all, so we pick one that the pattern does not contain.
_ESCAPE_CANDIDATES = "\u0001\u0002\u0003\u0004\u0005\u0006\u0007\u000e\u000f\u0010"


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def iso(d: dt.date | str) -> str:
    return d if isinstance(d, str) else d.strftime("%Y-%m-%d")


def floor_date(as_of: dt.date | str, days: int) -> str:
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    return iso(as_of - dt.timedelta(days=days))


def last_days(as_of: dt.date | str, days: int, column: str = "date") -> Column:
    """FLT-1: ``date >= as_of - days`` as a string compare; no upper bound."""
    return _c(column) >= F.lit(floor_date(as_of, days))


def eq(column: str | Column, value) -> Column:
    """FLT-2 / FLT-12: equality with a bound literal."""
    return _c(column) == F.lit(value)


def greater_than(column: str | Column, n) -> Column:
    """FLT-9."""
    return _c(column) > F.lit(n)


def date_between(start: dt.date | str, end: dt.date | str, column: str = "date") -> Column:
    """FLT-10: inclusive BETWEEN on the ISO date strings."""
    return _c(column).between(F.lit(iso(start)), F.lit(iso(end)))


def date_range(start: dt.date | str, end_exclusive: dt.date | str, column: str = "date") -> Column:
    """FLT-11: half-open date range, ``start <= date::DATE < end``.

    Stored dates are always zero-padded ``YYYY-MM-DD`` strings (fixed schema,
    written by the ingest), whose string order is the calendar order, so the
    range is compared as strings: that keeps it a Parquet-pushable filter and a
    partition filter, which a per-row ``CAST(date AS DATE)`` would not be. The
    bounds are validated as calendar dates here.
    """
    lo = dt.date.fromisoformat(iso(start)).isoformat()
    hi = dt.date.fromisoformat(iso(end_exclusive)).isoformat()
    return (_c(column) >= F.lit(lo)) & (_c(column) < F.lit(hi))


def on_date(d: dt.date | str, column: str = "date") -> Column:
    return _c(column) == F.lit(iso(d))


def at_hour(h: int, column: str = "hour") -> Column:
    return _c(column) == F.lit(int(h))


def _escape_for(pattern: str) -> str:
    for ch in _ESCAPE_CANDIDATES:
        if ch not in pattern:
            return ch
    raise ValueError("pattern uses every reserved control character")


def like(column: str | Column, pattern: str) -> Column:
    """FLT-5: case-sensitive LIKE with ``%``/``_`` wildcards and no escape."""
    return F.like(_c(column), F.lit(pattern), F.lit(_escape_for(pattern)))


def ilike(column: str | Column, pattern: str) -> Column:
    """FLT-8: case-insensitive LIKE, no escape."""
    return F.ilike(_c(column), F.lit(pattern), F.lit(_escape_for(pattern)))


def not_like(column: str | Column, *patterns: str) -> Column:
    """FLT-6: conjunction of NOT LIKE."""
    cond = F.lit(True)
    for p in patterns:
        cond = cond & ~like(column, p)
    return cond


def any_like(columns: Sequence[str | Column], pattern: str) -> Column:
    """FLT-7: OR of LIKE across columns."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | like(c, pattern)
    return cond


def contains_ci(column: str | Column, term: str) -> Column:
    """FLT-15: lower-cased substring search."""
    return F.lower(_c(column)).contains(F.lit(term.lower()))


def clean_values(values: Iterable | None) -> list:
    return [v for v in (values or []) if v is not None]


def list_frame(spark: SparkSession, column: str, values: Iterable, dtype: T.DataType | None = None) -> DataFrame:
    """A driver-side list as a typed one-column frame; the planner knows its size."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({column: pa.array(list(values), to_arrow_type(dtype or T.StringType()))}))


RANGES = 10  # ranges that stand for a list in the scan; Parquet statistics and Bloom filters are asked for each


def list_ranges(column: str | Column, values: Iterable) -> tuple[Column, bool]:
    """A condition that the scan can push: the sorted values in at most RANGES stretches of equal length, each with its
    exact least and greatest value, and whether that says all (every stretch is one value)."""
    vals = sorted(set(values))
    step = -(-len(vals) // RANGES)
    groups = [vals[i : i + step] for i in range(0, len(vals), step)]
    cond = F.lit(False)
    for g in groups:
        cond = cond | (_c(column) == F.lit(g[0]) if len(g) == 1 else _c(column).between(F.lit(g[0]), F.lit(g[-1])))
    return cond, all(len(g) == 1 for g in groups)


def filter_in(df: DataFrame, column: str, values: Iterable | None, optional: bool = False) -> DataFrame:
    """FLT-3 / FLT-4 / JN-4: keep rows whose ``column`` is in ``values``.

    ``None`` elements are dropped. With ``optional`` a missing or empty list
    means no filter. A list left empty after dropping matches only the empty
    string, as the source's ``IN ('')`` does. The list's ranges reach the scan;
    where they take in more than the list, a semi-join with a typed frame whose
    size Spark knows follows.
    """
    vals = list(dict.fromkeys(clean_values(values)))
    if not vals:
        if optional and not list(values or []):
            return df
        return df.where(F.col(column) == F.lit(""))
    ranges, exact = list_ranges(column, vals)
    kept = df.where(ranges)
    if exact:
        return kept
    return kept.join(list_frame(df.sparkSession, column, vals, df.schema[column].dataType), on=column, how="left_semi").select(*df.columns)
