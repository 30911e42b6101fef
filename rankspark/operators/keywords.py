"""Keyword analyses (KWD-1..5) and keyword lists (SRC-8/9)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions import expressions as X
from rankspark.functions import predicates as P
from rankspark.operators.ordering import desc, top_k

# -- keyword lists -------------------------------------------------------------

def keyword_frame(spark: SparkSession, keywords: Iterable[str | None]) -> DataFrame:
    """SRC-8: an inline keyword list as a one-column frame, duplicates kept."""
    return P.list_frame(spark, "query", keywords)


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: a text file of ``('a'),('b'),...`` entries, duplicates kept.

    Read as lines in parallel; each line yields its quoted entries in order. A doubled quote
    inside an entry stands for one.
    """
    lines = spark.read.text(path)
    found = F.regexp_extract_all("value", F.lit(r"\('((?:[^']|'')*)'\)"), F.lit(1))
    return lines.select(F.explode(found).alias("query")).select(F.replace("query", F.lit("''"), F.lit("'")).alias("query"))


def _as_frame(perf: DataFrame, keywords) -> DataFrame:
    if isinstance(keywords, DataFrame):
        return keywords.select(F.col(keywords.columns[0]).cast("string").alias("query"))
    return keyword_frame(perf.sparkSession, keywords)


# -- analyses ------------------------------------------------------------------

def keyword_coverage(perf: DataFrame, keywords: Iterable[str] | DataFrame,
                     exclude: Iterable[str] = ("%#%", "%tag%")) -> DataFrame:
    """KWD-1: for the given keywords, each ranking page outside the excluded
    patterns, with clicks, impressions, mean CTR and mean position.

    Keywords in a frame (a keyword file) stay in Spark: the fact is semi-joined with
    the distinct ones. NULLs match nothing, and an empty frame gives no rows.
    """
    if isinstance(keywords, DataFrame):
        rows = perf.join(_as_frame(perf, keywords).distinct(), "query", "left_semi").select(*perf.columns)
    else:
        rows = P.filter_in(perf, "query", keywords)
    return rows.where(P.not_like("page", *exclude)).groupBy("query", "page").agg(
        X.total("clicks", "total_clicks"),
        X.total("impressions", "total_impressions"),
        X.mean("ctr", "average_ctr"),
        X.mean("position", "average_position"),
    )


def keyword_gap(perf: DataFrame, keywords: list[str | None] | DataFrame) -> DataFrame:
    """KWD-2: listed keywords with no row at all in ``perf``; duplicates kept.

    The fact is semi-joined with the distinct keywords and reduced to the distinct
    matched ones before they are anti-joined with the list; Spark picks the join by size.
    A NULL keyword never matches and is always reported, as with the source's
    ``LEFT JOIN ... IS NULL``.
    """
    kw = _as_frame(perf, keywords if isinstance(keywords, DataFrame) else list(keywords))
    wanted = kw.where(F.col("query").isNotNull()).distinct()
    matched = perf.select("query").join(wanted, "query", "left_semi").distinct()
    return kw.join(matched, "query", "left_anti")


def topic_pages(perf: DataFrame, query_pattern: str, page_pattern: str | None = None,
                limit: int | None = 100) -> DataFrame:
    """KWD-3: pages where the query or the page matches a LIKE pattern, by clicks."""
    page_pattern = query_pattern if page_pattern is None else page_pattern
    rows = perf.where(P.like("query", query_pattern) | P.like("page", page_pattern))
    out = rows.groupBy("page").agg(
        X.total("clicks", "total_clicks"),
        X.total("impressions", "total_impressions"),
        X.mean("ctr", "average_ctr"),
        X.mean("position", "average_position"),
    )
    return top_k(out, [desc("total_clicks")], ["page"], limit)


def pair_losses(perf: DataFrame, range_a: tuple[str, str], range_b: tuple[str, str]) -> DataFrame:
    """Click loss per (page, query) from half-open range A to range B.

    Only pairs with a row in range A are kept. One scan over both ranges and
    one aggregation with conditional sums replace the source's two aggregates
    and their outer join. A pair with a NULL page or query never matched its
    range-B counterpart in that join, so its range-B clicks count as 0 here too.
    """
    in_a = P.date_range(*range_a)
    in_b = P.date_range(*range_b)
    rows = perf.where(in_a | in_b).select(
        "page", "query", "clicks", in_a.alias("in_a"), in_b.alias("in_b")
    )
    pairs = rows.groupBy("page", "query").agg(
        F.sum(F.when(F.col("in_a"), F.col("clicks"))).alias("clicks_a"),
        F.sum(F.when(F.col("in_b"), F.col("clicks"))).alias("clicks_b"),
        F.max("in_a").alias("has_a"),
    ).where("has_a")
    joinable = F.col("page").isNotNull() & F.col("query").isNotNull()
    clicks_b = F.when(joinable, F.col("clicks_b"))
    return pairs.select("page", "query", X.loss("clicks_a", clicks_b).cast("bigint").alias("traffic_loss"))


def traffic_loss(perf: DataFrame, range_a: tuple[str, str], range_b: tuple[str, str],
                 limit: int | None = 100) -> DataFrame:
    """KWD-4: (page, query) pairs that lost clicks from A to B, largest first."""
    out = pair_losses(perf, range_a, range_b).where(F.col("traffic_loss") > 0)
    return top_k(out, [desc("traffic_loss")], ["page", "query"], limit)


def page_traffic_loss(perf: DataFrame, range_a: tuple[str, str], range_b: tuple[str, str],
                      limit: int | None = None) -> DataFrame:
    """KWD-5: pages losing the most clicks, each with its biggest losing query.

    Page loss is the sum over the page's pairs present in range A; the top query
    is the one with the largest loss, ties to the smallest query. The arg-max is
    a ``min`` over a (-loss, query) struct, which aggregates partially like any
    min, so no page's pairs are ever gathered in one place.
    """
    pairs = pair_losses(perf, range_a, range_b)
    best = F.min(F.struct((-F.col("traffic_loss")).alias("neg_loss"), F.col("query").alias("query")))
    pages = pairs.groupBy("page").agg(
        F.sum("traffic_loss").cast("bigint").alias("traffic_loss"), best.alias("best")
    ).where(F.col("traffic_loss") > 0)
    out = pages.select(
        "page", "traffic_loss",
        F.col("best.query").alias("top_query"),
        (-F.col("best.neg_loss")).alias("top_query_loss"),
    )
    return top_k(out, [desc("traffic_loss")], ["page"], limit)
