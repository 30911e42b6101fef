"""Rollups: sums and distinct-count sketches per unit, kept as tables of the same log (DSH-1, TRD-1, AGG-6, CMP-1).

Every batch is summarised once, per (site, date), hour if hourly, and file. Which summaries count follows from
the parts that are live, so a replaced hour, a late day or a compaction changes the rollup with the commit
that names it and nothing is recomputed. Sums are exact. Distinct queries and pages are HyperLogLog
sketches of 2^SKETCH_BITS registers, which merge over any range of units: exact while there are fewer than some
500 values, beyond that with a relative standard error of 1.04 / sqrt(2^12) = 1.6 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.sources.log import OF_BATCH, Snapshot

SKETCH_BITS = 12
SUMS = ("n_rows", "clicks", "impressions", "position_sum", "n_positions", "ctr_sum", "n_ctr")
SKETCHES = ("queries", "pages")


def keys(kind: str) -> list[str]:
    return ["site_url", "date"] if kind == "daily" else ["site_url", "date", "hour"]


def schema(kind: str) -> T.StructType:
    ddl = "site_url string, date string, " + ("hour int, " if kind == "hourly" else "") + "file string, "
    ddl += "n_rows long, clicks long, impressions long, position_sum double, n_positions long, ctr_sum double, n_ctr long, queries binary, pages binary"
    return T._parse_datatype_string(ddl)


def summarize(facts: DataFrame, kind: str, *by: str) -> DataFrame:
    """The rollup rows of some facts."""
    return facts.groupBy(*keys(kind), *by).agg(
        F.count("*").alias("n_rows"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        F.sum("position").alias("position_sum"), F.count("position").alias("n_positions"),
        F.sum("ctr").alias("ctr_sum"), F.count("ctr").alias("n_ctr"),
        F.hll_sketch_agg("query", SKETCH_BITS).alias("queries"), F.hll_sketch_agg("page", SKETCH_BITS).alias("pages"))


def merge(rollup: DataFrame, *by: str) -> DataFrame:
    """Rollup rows of coarser keys."""
    sums = [F.sum(c).alias(c) for c in SUMS]
    return rollup.groupBy(*by).agg(*sums, *(F.hll_union_agg(c).alias(c) for c in SKETCHES))


def live_rollup(snapshot: Snapshot, parts: DataFrame) -> DataFrame:
    """The rollup of the given live parts, a row per (site, date) and hour if hourly."""
    log = snapshot.log
    batches = sorted(r.batch for r in parts.select("batch").distinct().collect())
    if not batches:
        return log.spark.createDataFrame([], schema(log.kind)).drop("file")
    with_batch = T.StructType([*schema(log.kind).fields, T.StructField("batch", T.StringType())])
    rows = log.spark.read.schema(with_batch).option("basePath", log.rollups()).parquet(*(log.rollups(b) for b in batches))
    live = rows.join(parts.select(*OF_BATCH, "file").distinct(), [*OF_BATCH, "file"], "left_semi")
    return merge(live, *keys(log.kind))
