"""Fact-table views derived from the driver's test tables.

The reference ships no data, so the daily fact is derived from
``lineitem ⋈ part ⋈ supplier ⋈ nation`` and the hourly fact from ``events``.
Each view exists twice: as a Spark DataFrame (what the operators read) and as
DuckDB SQL text (what the independent oracle reads). Both must produce equal
rows; ``tests/test_fixtures.py`` checks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.schema import DAILY_COLUMNS, HOURLY_COLUMNS

HOURLY_SITE = "sc-domain:events.example"


# Read handles of the driver's read-only tables, per session: a handle is a
# lazy plan (file index + schema), so reusing it skips the footer reads that
# building it costs; no data is held.
_TABLES: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    df = _TABLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _TABLES[key] = df
    return df


def _device_of_line(linenumber: Column) -> Column:
    m = linenumber % 3
    return F.when(m == 0, "DESKTOP").when(m == 1, "MOBILE").otherwise("TABLET")


def daily_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily fact over all sites, columns in ``schema.DAILY`` order.

    Spark picks the joins by the sizes of the sides. Where a side is too large to be broadcast the lines are shuffled, so they go
    into the joins as small numbers (whole days, whole prices), and wide texts come last; every side is a table, whose size Spark
    knows beforehand (that of a join is guessed too large to be broadcast).
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", F.to_date("l_shipdate").alias("day"),
        F.floor("l_quantity").cast("bigint").alias("clicks"), F.floor("l_extendedprice").cast("bigint").alias("impressions"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        li.join(supplier, li.l_suppkey == supplier.s_suppkey)
        .join(part, li.l_partkey == part.p_partkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
    )
    return joined.select(
        F.concat(F.lit("sc-domain:"), F.lower("l_returnflag"), F.lit(".example")).alias("site_url"),
        F.date_format("day", "yyyy-MM-dd").alias("date"),
        F.col("p_name").alias("query"),
        F.concat(F.lit("/"), F.lower("p_type"), F.lit("/"),
                 F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("page"),
        _device_of_line(F.col("l_linenumber")).alias("device"),
        F.col("n_name").alias("country"),
        "clicks",
        "impressions",
        (F.col("clicks").cast("double") / F.col("impressions").cast("double")).alias("ctr"),
        (F.col("l_linenumber") + (F.col("l_partkey") % 4) * F.lit(0.25)).cast("double").alias("position"),
    ).select(*DAILY_COLUMNS)


def hourly_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly fact (one site) derived from ``events``."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    is_click = F.col("event_type") == "click"
    return ev.select(
        F.lit(HOURLY_SITE).alias("site_url"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.hour("ts").cast("int").alias("hour"),
        F.concat(F.lit("kw"), F.regexp_extract("props", r"([0-9]+)", 1)).alias("query"),
        F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("page"),
        F.when(F.col("user_id") % 2 == 0, "MOBILE").otherwise("DESKTOP").alias("device"),
        F.lit("twn").alias("country"),
        F.when(is_click, 1).otherwise(0).cast("bigint").alias("clicks"),
        F.when(F.col("event_type").isin("click", "view"), 1).otherwise(0).cast("bigint").alias("impressions"),
        F.when(is_click, 1.0).otherwise(0.0).cast("double").alias("ctr"),
        (F.lit(1) + (F.col("event_id") % 40) * F.lit(0.25)).cast("double").alias("position"),
    ).select(*HOURLY_COLUMNS)


# DuckDB text of the same two views, for the oracle. Table names are the
# driver's pre-registered views.
DAILY_VIEW_SQL = """
SELECT concat('sc-domain:', lower(l_returnflag), '.example') AS site_url,
       strftime(l_shipdate, '%Y-%m-%d') AS date,
       p_name AS query,
       concat('/', lower(p_type), '/', replace(p_brand, '#', '-')) AS page,
       CASE l_linenumber % 3 WHEN 0 THEN 'DESKTOP' WHEN 1 THEN 'MOBILE' ELSE 'TABLET' END AS device,
       n_name AS country,
       CAST(floor(l_quantity) AS BIGINT) AS clicks,
       CAST(floor(l_extendedprice) AS BIGINT) AS impressions,
       CAST(floor(l_quantity) AS DOUBLE) / CAST(floor(l_extendedprice) AS DOUBLE) AS ctr,
       CAST(l_linenumber + (l_partkey % 4) * CAST(0.25 AS DOUBLE) AS DOUBLE) AS position
FROM lineitem
JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
"""

HOURLY_VIEW_SQL = f"""
SELECT '{HOURLY_SITE}' AS site_url,
       strftime(ts, '%Y-%m-%d') AS date,
       CAST(hour(ts) AS INTEGER) AS hour,
       concat('kw', regexp_extract(props, '([0-9]+)', 1)) AS query,
       concat('/u/', CAST(user_id AS VARCHAR)) AS page,
       CASE WHEN user_id % 2 = 0 THEN 'MOBILE' ELSE 'DESKTOP' END AS device,
       'twn' AS country,
       CAST(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS BIGINT) AS clicks,
       CAST(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS BIGINT) AS impressions,
       CAST(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS DOUBLE) AS ctr,
       CAST(1 + (event_id % 40) * CAST(0.25 AS DOUBLE) AS DOUBLE) AS position
FROM events
"""


def with_views(body: str) -> str:
    """Prefix a DuckDB query with the ``daily`` and ``hourly`` fact CTEs.

    A body that starts with its own ``WITH`` is merged into the same clause.
    """
    head = f"WITH daily AS ({DAILY_VIEW_SQL}), hourly AS ({HOURLY_VIEW_SQL})"
    text = body.strip()
    if text[:4].upper() == "WITH" and text[4:5].isspace():
        return f"{head},\n{text[5:]}"
    return f"{head}\n{text}"
