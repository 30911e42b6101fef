"""Sorted results of any size as files in order (SRT-2..4).

The rows are range-partitioned by the sort keys, so every task sorts and writes one stretch of the order, and the
file names are in the order of the stretches. Rows equal in the keys are told apart by the other columns and, if they
are equal in all of them, by where they came from: a key that a third of the rows share is cut over many
files. ``_bounds`` beside the files says how many rows each holds and where it begins, so a page of the
result is read from the files that hold it, without sorting again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_FILE = 1_000_000


def write_ordered(df: DataFrame, path: str, order: Sequence[Column], rows_per_file: int = ROWS_PER_FILE, compression: str = "snappy") -> int:
    """Write ``df`` in the order of the given sort columns (``F.asc_nulls_last(...)`` and the like); the number of files."""
    n_files = max(1, -(-df.count() // rows_per_file))
    place = _free("_place", df)
    whole = [*order, *(F.asc_nulls_last(f"`{c}`") for c in df.columns), F.asc(place)]
    placed = df.withColumn(place, F.monotonically_increasing_id())
    sorted_ = placed.repartitionByRange(n_files, *whole).sortWithinPartitions(*whole).drop(place)
    sorted_.write.option("compression", compression).parquet(path)
    spark = df.sparkSession
    sizes = spark.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_rows"))
    before = F.coalesce(F.sum("n_rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.withColumn("first_row", before).coalesce(1).write.parquet(f"{path}/_bounds")  # a row per file
    return n_files


def _free(name: str, df: DataFrame) -> str:
    """A name that no column of ``df`` has."""
    while name in df.columns:
        name += "_"
    return name


def bounds(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_rows, first_row) of an ordered result, first_row counted from 0."""
    return spark.read.schema("file string, n_rows long, first_row long").parquet(f"{path}/_bounds")


def read_ordered(spark: SparkSession, path: str, schema, offset: int = 0, limit: int | None = None) -> DataFrame:
    """The rows from place ``offset`` on, with their place as ``row_no`` (from 0); only files that hold some are opened."""
    inside = F.col("first_row") + F.col("n_rows") > offset
    if limit is not None:
        inside = inside & (F.col("first_row") < offset + limit)
    files = bounds(spark, path).where(inside & (F.col("n_rows") > 0)).collect()  # a row per file of the wanted stretch
    if not files:
        return spark.createDataFrame([], schema).withColumn("row_no", F.lit(0).cast("long"))
    rows = spark.read.schema(schema).parquet(*(f"{path}/{r.file}" for r in files))
    file, row, first = (_free(n, rows) for n in ("_file", "_row", "_first"))
    starts = spark.createDataFrame([(r.file, r.first_row) for r in files], f"{file} string, {first} long")
    placed = rows.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row)).join(starts, file)
    no = F.col(first) + F.col(row)
    inside = no >= offset if limit is None else (no >= offset) & (no < offset + limit)
    return placed.where(inside).select(*(f"`{c}`" for c in rows.columns), no.alias("row_no"))
