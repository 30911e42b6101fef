"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.session import scratch_path

#: White space that separates words: the space and the five ASCII controls from tab to return.
WORD_GAP = r"[ \t-\r]+"
WORD_CHAR = r"[^ \t-\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to a fresh folder under the shared checkpoint folder, with Parquet ``options``, and read it back.

    Cuts lineage, gives the planner real sizes, and survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(table: DataFrame) -> None:
    """Delete a table that ``stored`` has returned, once nothing that is still to run reads it."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text (none for null), in order."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def with_row(df: DataFrame, *columns: Column) -> DataFrame:
    """The whole input row packed as ``row``, beside ``columns``: names cannot clash."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"), *columns)

