"""Incremental ingest of landed response pages (STR-1..3).

The source re-runs a scheduled loop that skips finished days. Here a Structured Streaming file source
tracks which landed files were already seen (in the checkpoint), and ``trigger(availableNow=True)``
processes whatever is new and stops, which is the scheduled-batch shape of the source.

A fetch's pages can land in different micro-batches, and a micro-batch sees only new files. So pages go
into a page log, an append-only table of its own: each micro-batch appends its pages once, and their
references (sizes, no rows). What is open is decided on references alone; each unit's newest complete fetch is
then read from the log and stored (daily once, hourly until hour 23), and the fetches that are done with are
appended as closed. A micro-batch so writes in proportion to its own pages, however many fetches stay open.
Every FOLD_EVERY micro-batches the open references are written anew without the closed ones, and pages of
closed fetches are deleted. A fetch without a new page for ``expire_days``, by the newest page seen, is closed
as dropped and listed with what it lacks (``dropped_fetches``); its day stays in the fetch plan.

``foreachBatch`` is at-least-once: a replayed batch overwrites its own part of the log, finds its units stored
and stores nothing (daily), or stores the same rows again (hourly). No watermark is needed: completeness
is decided by page contiguity and hour 23, not by event time.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rankspark.schema import PAGE_ROW_LIMIT
from rankspark.session import checkpoint_root, stored
from rankspark.sinks.fact import UNIT, closed_units, commit
from rankspark.sources.landing import (
    CORRUPT, FETCH, LANDED, REF, SIZED, fetch_status, flatten_daily, flatten_hourly, incomplete_fetches, landed_pages,
    latest_complete_fetch, page_refs, read_landing, sized, take_pages,
)
from rankspark.sources.log import Files
from rankspark.sources.store import Store

FOLD_EVERY = 16  # micro-batches
EXPIRE_DAYS = 7
CLOSED = T.StructType([f for f in REF.fields if f.name in FETCH])
DROPPED = "site_url string, date string, fetch_id string, n_pages long, n_rows long, fetched_at timestamp, problem string"
WITH_EPOCH = T.StructType([*REF.fields, T.StructField("epoch", T.StringType())])


def _store(pages: DataFrame, refs: DataFrame, store_root: str, kind: str, page_limit: int, open_since=None) -> int:
    """Store the newest complete fetch of each open unit; returns the number of units stored."""
    closed = closed_units(Store.at(pages.sparkSession, store_root), kind, open_since)
    chosen = latest_complete_fetch(refs, page_limit).where(F.col("n_rows") > 0).join(closed, UNIT, "left_anti")
    chosen = stored(chosen, f"ingest-units-{kind}")  # a row per unit, read by all that follows
    if chosen.isEmpty():
        return 0
    flat = flatten_daily if kind == "daily" else flatten_hourly
    rows = flat(take_pages(pages, refs, chosen))
    return commit(rows, chosen.groupBy("date").agg(F.sum("n_rows").alias("n")), store_root, kind, open_since=open_since)


class PageLog:
    """Pages, references and closings under ``<root>/_pages/<kind>``, a folder per micro-batch in each."""

    def __init__(self, spark: SparkSession, store_root: str, kind: str):
        self.spark, self.root = spark, f"{store_root.rstrip('/')}/_pages/{kind}"
        self.files = Files(spark, self.root)

    def folder(self, part: str, epoch: str | None = None) -> str:
        return f"{self.root}/{part}" + (f"/epoch={epoch}" if epoch else "")

    def epochs(self, part: str) -> list[str]:
        """Epochs whose folder is whole."""
        names = [n for n in self.files.names(self.folder(part)) if n.startswith("epoch=")]
        return sorted(n[6:] for n in names if "_SUCCESS" in self.files.names(f"{self.folder(part)}/{n}"))

    def read(self, part: str, schema: T.StructType, epochs: list[str] | None = None) -> DataFrame:
        epochs = self.epochs(part) if epochs is None else epochs
        if not epochs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.folder(part)).parquet(*(self.folder(part, e) for e in epochs))

    def append(self, batch: DataFrame, epoch: str) -> None:
        sized(batch).write.mode("overwrite").option("compression", "zstd").parquet(self.folder("pages", epoch))
        refs = page_refs(self.spark.read.schema(SIZED).parquet(self.folder("pages", epoch)))
        refs.withColumn("epoch", F.lit(epoch)).select(*WITH_EPOCH.names).write.mode("overwrite").parquet(self.folder("refs", epoch))

    def open_refs(self) -> DataFrame:
        refs = None  # `epoch` is a column of the files: a fold gathers references of many epochs
        for e in self.epochs("refs"):
            one = self.spark.read.schema(WITH_EPOCH).parquet(self.folder("refs", e))
            refs = one if refs is None else refs.unionByName(one)
        if refs is None:
            return self.spark.createDataFrame([], WITH_EPOCH)
        return refs.join(self.read("closed", CLOSED).select(*FETCH).distinct(), FETCH, "left_anti")

    def pages(self, refs: DataFrame) -> DataFrame:
        """The pages of the epochs that ``refs`` name (open epochs, one small name each)."""
        return self.read("pages", SIZED, sorted(r.epoch for r in refs.select("epoch").distinct().collect()))

    def close(self, fetches: DataFrame, epoch: str) -> None:
        fetches.select(*FETCH).distinct().write.mode("overwrite").parquet(self.folder("closed", epoch))

    def fold(self, epoch: str) -> None:
        """Put the open references of earlier epochs into one folder; delete their closings, and pages of epochs that
        have none open. The present epoch is left as it is: if it is replayed, its files are written anew."""
        old = [e for e in self.epochs("refs") if e != epoch]
        if len(old) < FOLD_EVERY:
            return
        closed = [e for e in self.epochs("closed") if e != epoch]
        refs = stored(self.open_refs(), "open-refs")
        refs.where(F.col("epoch") != epoch).write.mode("overwrite").parquet(self.folder("refs", f"{epoch}-fold"))
        needed = {r.epoch for r in refs.select("epoch").distinct().collect()} | {epoch}
        for e in old:
            self.files.delete(self.folder("refs", e))
        for e in closed:  # after the references that they close: a job lost in between opens nothing anew
            self.files.delete(self.folder("closed", e))
        for e in set(self.epochs("pages")) - needed:
            self.files.delete(self.folder("pages", e))


def process_pages(batch: DataFrame, store_root: str, kind: str, page_limit: int = PAGE_ROW_LIMIT,
                  epoch: str = "0", expire_days: int | None = EXPIRE_DAYS, open_since=None) -> None:
    """One micro-batch of landed pages -> page log and fact table. Daily units of dates from ``open_since`` on are replaced."""
    spark = batch.sparkSession
    log = PageLog(spark, store_root, kind)
    log.append(batch, epoch)
    refs = stored(log.open_refs(), f"ingest-refs-{kind}")
    _store(log.pages(refs), refs, store_root, kind, page_limit, open_since)
    status = stored(fetch_status(refs, page_limit), f"ingest-status-{kind}")
    closed = status.join(closed_units(Store.at(spark, store_root), kind, open_since), UNIT, "left_semi")
    done = status.where("complete").select(*FETCH).unionByName(closed.select(*FETCH))
    if expire_days is not None:
        newest = status.agg(F.max("fetched_at")).first()[0]
        dead = incomplete_fetches(status, page_limit).where(F.col("fetched_at") < F.lit(newest) - F.expr(f"INTERVAL {int(expire_days)} DAYS"))
        dead = stored(dead.join(done.distinct(), FETCH, "left_anti"), f"ingest-dropped-{kind}")
        if not dead.isEmpty():
            dead.write.mode("overwrite").parquet(log.folder("dropped", epoch))
        done = done.unionByName(dead.select(*FETCH))
    log.close(done, epoch)
    log.fold(epoch)


def open_fetches(spark: SparkSession, store_root: str, kind: str, page_limit: int = PAGE_ROW_LIMIT) -> DataFrame:
    """Fetches that are waited for: what has landed of them, and what each lacks."""
    return incomplete_fetches(fetch_status(PageLog(spark, store_root, kind).open_refs(), page_limit), page_limit)


def dropped_fetches(spark: SparkSession, store_root: str, kind: str) -> DataFrame:
    """Fetches that were given up, with what they lacked."""
    return PageLog(spark, store_root, kind).read("dropped", T._parse_datatype_string(DROPPED)).select(*(c.split()[0] for c in DROPPED.split(", ")))


def _start(spark: SparkSession, landing: str, store_root: str, kind: str, checkpoint: str | None,
           max_files_per_trigger: int | None, page_limit: int, expire_days: int | None, open_since=None) -> StreamingQuery:
    reader = spark.readStream.schema(LANDED).option("columnNameOfCorruptRecord", CORRUPT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    ckpt = checkpoint or f"{checkpoint_root(spark)}/stream-{kind}"
    name = f"{zlib.crc32(ckpt.encode()):08x}"

    def each(df: DataFrame, n: int) -> None:
        process_pages(df, store_root, kind, page_limit, f"{name}-{n:09d}", expire_days, open_since)

    return (
        landed_pages(reader.json(landing)).writeStream.foreachBatch(each)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )


def stream_daily(spark: SparkSession, landing: str, store_root: str, checkpoint: str | None = None,
                 max_files_per_trigger: int | None = None, page_limit: int = PAGE_ROW_LIMIT,
                 expire_days: int | None = EXPIRE_DAYS, open_since=None) -> StreamingQuery:
    """STR-1: each (site, date) stored once, from its newest complete fetch; dates from ``open_since`` on are replaced."""
    return _start(spark, landing, store_root, "daily", checkpoint, max_files_per_trigger, page_limit, expire_days, open_since)


def stream_hourly(spark: SparkSession, landing: str, store_root: str, checkpoint: str | None = None,
                  max_files_per_trigger: int | None = None, page_limit: int = PAGE_ROW_LIMIT,
                  expire_days: int | None = EXPIRE_DAYS) -> StreamingQuery:
    """STR-2/3: hourly units replaced until hour 23 is stored, then frozen."""
    return _start(spark, landing, store_root, "hourly", checkpoint, max_files_per_trigger, page_limit, expire_days)


def ingest_batch(spark: SparkSession, landing: str, store_root: str, kind: str = "daily", page_limit: int = PAGE_ROW_LIMIT) -> None:
    """Batch form of the same job over everything landed (re-runnable)."""
    pages = stored(sized(read_landing(spark, landing)), "landed-pages")
    _store(pages, stored(page_refs(pages), "page-refs"), store_root, kind, page_limit)
