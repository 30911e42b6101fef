"""Exports (SNK-3..5) and display projections (PRJ-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.functions.expressions import decode_page, display_number, truncate

# Header of the query-table CSV export (fixed values of the source export).
CSV_HEADER = ("Query", "Clicks", "Impressions", "CTR", "Position")


def nan_to_null(df: DataFrame) -> DataFrame:
    """SNK-4: NaN -> NULL in float/double columns; other columns untouched."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(F.isnan(f.name), F.lit(None)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def csv_frame(query_table: DataFrame) -> DataFrame:
    """SNK-3 projection: ctr with 2 decimals, position with 1, source headers."""
    return query_table.select(
        F.col("query").alias("Query"),
        F.col("clicks").alias("Clicks"),
        F.col("impressions").alias("Impressions"),
        F.format_string("%.2f", "ctr").alias("CTR"),
        F.format_string("%.1f", "position").alias("Position"),
    )


def export_csv(query_table: DataFrame, path: str) -> None:
    """SNK-3: write the query table as CSV with a header row.

    Fields holding a comma or quote are quoted, embedded quotes are doubled, and
    white space at either end is kept. Written as a folder of part files by
    the executors; nothing passes through the driver.
    """
    (csv_frame(query_table).write.mode("overwrite")
        .option("header", True).option("quoteAll", False).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def archive(df: DataFrame, path: str) -> None:
    """SNK-5: archive a table (typically one site) to Parquet with ZSTD."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def display(df: DataFrame, decimals: dict[str, int] | None = None, truncate_at: dict[str, int] | None = None,
            decode: bool = True) -> DataFrame:
    """PRJ-8/9: strings for showing a result: decoded pages, thousands
    separators and fixed decimals, ``-`` for NULL/NaN, long text cut with ``...``."""
    decimals = decimals or {}
    truncate_at = truncate_at or {}
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name == "page" and decode:
            c = decode_page(c)
        if isinstance(f.dataType, T.NumericType):
            c = display_number(c, decimals.get(f.name, 0 if isinstance(f.dataType, T.IntegralType) else 2))
        elif f.name in truncate_at:
            c = truncate(c, truncate_at[f.name])
        cols.append(c.alias(f.name))
    return df.select(*cols)
