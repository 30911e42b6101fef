"""Registered write round trips: ingest (SRC-6/7, ING-4..6, SNK-1/2, STR-1..3), zstd archive (SNK-5) and
CSV export (SNK-3).

The facts are replayed as landed response pages, ingested by the Structured Streaming job with
``availableNow`` into a fresh store in the shared checkpoint folder, and read back. Where a fetch is
complete the store must hold every row of it; incomplete, late and superseded fetches must not show.
"""

from pyspark.sql import functions as F

from rankspark.functions.predicates import floor_date
from rankspark.operators.dashboard import query_table
from rankspark.queries.params import AS_OF, DAYS, SITE, sql_str
from rankspark.registry import register
from rankspark.schema import DAILY, DAILY_COLUMNS, HOURLY_COLUMNS, PAGE_ROW_LIMIT, RAW_PAGE
from rankspark.session import scratch_path
from rankspark.sinks.export import archive, display, export_csv
from rankspark.sinks.fact import compact, publish, write_batch, write_hourly
from rankspark.sources.landing import to_response_pages
from rankspark.sources.log import CommitLog
from rankspark.sources.store import Store
from rankspark.streaming.ingest import stream_daily, stream_hourly


def _stream(spark, work, kind, page_limit=PAGE_ROW_LIMIT):
    start = stream_daily if kind == "daily" else stream_hourly
    query = start(spark, f"{work}/landing", f"{work}/store", f"{work}/stream-checkpoint", page_limit=page_limit)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return Store.at(spark, f"{work}/store").table(kind)


def _land(pages, work):
    """Write pages as a fetcher lands them: JSON, compressed as a fetcher would keep what it got over the wire."""
    pages.write.mode("append").option("compression", "gzip").json(f"{work}/landing")


def round_trip(spark, facts, kind, page_limit=PAGE_ROW_LIMIT):
    """Replay ``facts`` as landed pages and stream them into a fresh store."""
    work = scratch_path(spark, f"ingest-{kind}")
    pages = to_response_pages(facts, kind, fetch_id=f"replay-{kind}", hour_offset="-07:00", page_limit=page_limit)
    _land(pages, work)
    return _stream(spark, work, kind, page_limit)


@register("ingest_daily_roundtrip", "STR-1", f"SELECT {', '.join(DAILY_COLUMNS)} FROM daily", writes=True)
def q_ingest_daily(spark, sf_dir):
    return round_trip(spark, Store.fixtures(spark, sf_dir).daily(), "daily")


@register("ingest_hourly_roundtrip", "STR-2", f"SELECT {', '.join(HOURLY_COLUMNS)} FROM hourly", writes=True)
def q_ingest_hourly(spark, sf_dir):
    return round_trip(spark, Store.fixtures(spark, sf_dir).hourly(), "hourly")


SMALL_PAGE = 7


@register("ingest_daily_pages", "ING-4", f"""
SELECT {', '.join(DAILY_COLUMNS)} FROM daily WHERE date NOT LIKE '%-13' AND date NOT LIKE '%-14'
""", writes=True)
def q_ingest_daily_pages(spark, sf_dir):
    """Days of many small pages, some delivered twice. The first page of every 13th is missing, and of
    every 14th there is only an empty fetch: neither day is stored. A later fetch of stored days is ignored."""
    work = scratch_path(spark, "ingest-pages")
    facts = Store.fixtures(spark, sf_dir).daily()
    pages = to_response_pages(facts.where(~F.col("date").like("%-14")), "daily", fetch_id="first", page_limit=SMALL_PAGE)
    pages = pages.where(~(F.col("date").like("%-13") & (F.col("start_row") == 0)))
    empty = facts.where(F.col("date").like("%-14")).select("site_url", "date").distinct().select(
        "*", F.lit("empty").alias("fetch_id"), F.lit(0).cast("bigint").alias("start_row"),
        F.lit("2000-01-01").cast("timestamp").alias("fetched_at"), F.array().cast(RAW_PAGE["rows"].dataType).alias("rows"))
    again = pages.where(F.col("date").like("%-02"))
    _land(pages.unionByName(empty).unionByName(again), work)
    _stream(spark, work, "daily", SMALL_PAGE)
    late = to_response_pages(facts.where(F.col("date").like("%-0_")).withColumn("clicks", F.col("clicks") + 1), "daily",
                             fetch_id="late", fetched_at="2001-01-01 00:00:00", page_limit=SMALL_PAGE)
    _land(late, work)
    return _stream(spark, work, "daily", SMALL_PAGE)


@register("ingest_hourly_replaced", "STR-3", """
SELECT site_url, date, hour, query, page, device, country,
       CASE WHEN MAX(hour) OVER (PARTITION BY site_url, date) = 23 THEN clicks ELSE clicks + 100 END AS clicks,
       impressions, ctr, position
FROM hourly
""", writes=True)
def q_ingest_hourly_replaced(spark, sf_dir):
    """Each day fetched three times: up to noon, whole, and later with other clicks. The second replaces
    the first; the third replaces only days that had not reached hour 23."""
    work = scratch_path(spark, "ingest-replaced")
    facts = Store.fixtures(spark, sf_dir).hourly()
    fetches = [("noon", facts.where("hour <= 12")), ("whole", facts), ("late", facts.withColumn("clicks", F.col("clicks") + 100))]
    for i, (fetch, rows) in enumerate(fetches):
        _land(to_response_pages(rows, "hourly", fetch_id=fetch, fetched_at=f"2000-01-0{i + 1} 00:00:00"), work)
        out = _stream(spark, work, "hourly")
    return out


def _days(rows):
    return rows.groupBy("date").agg(F.count("*").alias("n"))


@register("ingest_two_writers", "SNK-1", f"""
SELECT {', '.join(DAILY_COLUMNS)} FROM (SELECT * REPLACE (CASE WHEN site_url = {sql_str(SITE)} THEN clicks + 1 ELSE clicks END AS clicks) FROM daily) t
""", writes=True)
def q_ingest_two_writers(spark, sf_dir):
    """Two writers plan and write from the same (empty) state; one has all sites but one, the other all, with other
    clicks. The first to commit wins its units, the second keeps the site that is left."""
    log = CommitLog(spark, scratch_path(spark, "two-writers"), "daily")
    facts = Store.fixtures(spark, sf_dir).daily()
    most, all_sites = facts.where(F.col("site_url") != SITE), facts.withColumn("clicks", F.col("clicks") + 1)
    written = [write_batch(log, rows, _days(rows)) for rows in (most, all_sites)]
    for parts in written:
        publish(log, parts)
    return Store.at(spark, log.base.rsplit("/", 1)[0]).daily()


@register("ingest_compacted", "SNK-2", """
SELECT site_url, date, hour, query, page, device, country, CASE WHEN date LIKE '%0' THEN clicks + 100 ELSE clicks END AS clicks, impressions, ctr, position
FROM hourly WHERE hour <= 12 OR date LIKE '%0'
""", writes=True)
def q_ingest_compacted(spark, sf_dir):
    """Days stored up to noon in three batches, some then replaced by whole ones; small files and replaced hours are merged."""
    root = scratch_path(spark, "compacted")
    facts = Store.fixtures(spark, sf_dir).hourly()
    for k in range(3):
        write_hourly(facts.where((F.col("hour") <= 12) & (F.crc32("date") % 3 == k)), root)
    compact(spark, root, "hourly")
    write_hourly(facts.where(F.col("date").like("%0")).withColumn("clicks", F.col("clicks") + 100), root)
    compact(spark, root, "hourly")
    return Store.at(spark, root).hourly()


@register("display_table", "PRJ-9", f"""
SELECT query, CASE WHEN n IS NULL THEN '-' ELSE format('{{:,}}', n) END AS n,
       CASE WHEN share IS NULL OR isnan(share) THEN '-' ELSE printf('%.2f', round(share, 2)) END AS share
FROM (SELECT query, NULLIF(CAST(SUM(impressions) AS BIGINT), 0) AS n,
             CASE WHEN MAX(clicks) >= 45 THEN CAST('NaN' AS DOUBLE) WHEN MAX(clicks) >= 40 THEN NULL ELSE MAX(clicks) / 4.0 END AS share
      FROM daily WHERE site_url = {sql_str(SITE)} GROUP BY query) t
""")
def q_display_table(spark, sf_dir):
    t = Store.fixtures(spark, sf_dir).daily(SITE).groupBy("query").agg(F.sum("impressions").alias("n"), F.max("clicks").alias("top"))
    share = F.when(F.col("top") >= 45, F.lit(float("nan"))).when(F.col("top") < 40, F.col("top") / 4.0)
    return display(t.select("query", "n", share.alias("share")))


@register("archive_site", "SNK-5", f"""
SELECT {', '.join(DAILY_COLUMNS)} FROM daily WHERE site_url = {sql_str(SITE)}
""", writes=True)
def q_archive_site(spark, sf_dir):
    """Archive one site's daily table with ZSTD and read the archive back."""
    path = scratch_path(spark, "archive") + "/daily"
    archive(Store.fixtures(spark, sf_dir).daily(SITE), path)
    return spark.read.schema(DAILY).parquet(path)


_CSV_SCHEMA = "Query string, Clicks bigint, Impressions bigint, CTR string, Position string"


@register("export_csv_roundtrip", "SNK-3", f"""
WITH t AS (
    SELECT query, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions,
           CASE WHEN SUM(impressions) > 0
                THEN CAST(SUM(clicks) AS DOUBLE) / CAST(SUM(impressions) AS DOUBLE) * 100 ELSE 0.0 END AS ctr,
           AVG(position) AS position
    FROM daily WHERE site_url = {sql_str(SITE)} AND date >= '{floor_date(AS_OF, DAYS)}'
    GROUP BY query ORDER BY clicks DESC, query ASC LIMIT 50
)
SELECT query AS "Query", clicks AS "Clicks", impressions AS "Impressions",
       printf('%.2f', round(ctr, 2)) AS "CTR", printf('%.1f', round(position, 1)) AS "Position"
FROM t
""", writes=True)
def q_export_csv_roundtrip(spark, sf_dir):
    """Write the query table as CSV (header, quoted commas) and read the files back."""
    path = scratch_path(spark, "csv-export")
    table = query_table(Store.fixtures(spark, sf_dir).daily(SITE), AS_OF, DAYS, sort="clicks", limit=50)
    export_csv(table, path)
    return spark.read.schema(_CSV_SCHEMA).option("header", True).option("escape", '"').csv(path)
