"""Fact-table writers (SNK-1, SNK-2), compaction and clean-up.

A write is a *batch* of files. Rows are dealt to files by their place in the order of dates: a file has
about ROWS_PER_FILE rows, holds a range of dates (many thin days, or a hash share of one large day) and is sorted by
site, date, query and page, with Bloom filters on query and page. Beside it lie its sums and sketches per unit
(``sources.rollup``), made in the one pass that also counts its parts. Then the batch is committed to the
table's log (``sources.log``): a job lost half-way leaves files that nobody reads, and running it again stores the
unit whole.

A daily unit is stored once and never replaced, unless a writer says that its date is still provisional
(``open_since``). An hourly unit is replaced by newer commits until its rows
reach hour 23, then frozen. Both rules are applied when the commit is put, against the version it follows:
if another writer was first, the units are looked at again, so two writers that planned from the same state
never store a unit twice, whichever is first.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.functions.predicates import iso
from rankspark.schema import DAILY, DAILY_COLUMNS, HOURLY, HOURLY_COLUMNS, LAST_HOUR
from rankspark.session import stored
from rankspark.sources import rollup
from rankspark.sources.log import OF_BATCH, UNIT, CommitLog, Snapshot
from rankspark.sources.store import Store, facts_of

ROWS_PER_FILE = 4_000_000  # some 128-512 MB
CHECKPOINT_EVERY = 16  # versions that a reader may have to put together
BLOOM = {f"parquet.bloom.filter.{k}#{c}": "true" for c in ("query", "page") for k in ("enabled", "adaptive.enabled")}


def _closed(units: DataFrame, kind: str, open_since: dt.date | str | None) -> DataFrame:
    if kind == "hourly":
        return units.where(F.col("max_hour") == LAST_HOUR)
    return units if open_since is None else units.where(F.col("date") < F.lit(iso(open_since)))


def closed_units(store: Store, kind: str, open_since: dt.date | str | None = None) -> DataFrame:
    """Units that are not to be written again: stored daily ones (of dates before ``open_since``, if given), hourly
    ones that reach hour 23."""
    return _closed(store.units(kind), kind, open_since).select(*UNIT)


def write_batch(log: CommitLog, rows: DataFrame, sizes: DataFrame, compression: str = "snappy", rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write one batch that no reader sees yet; its parts, (site_url, date, batch, file, n_rows, max_hour), as a stored table.

    ``sizes`` has the rows per day (date, n), one small row a day; only it is put in order of dates in one task.
    """
    schema = DAILY if log.kind == "daily" else HOURLY
    dims = [F.col(c) for c in ("site_url", "query", "page", "device", "country")]
    before = F.coalesce(F.sum("n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = stored(sizes.select("date", "n", before.alias("before")), "day-sizes")
    total = days.agg(F.sum("n")).first()[0] or 0
    n_files = max(1, -(-total // rows_per_file))
    place = F.col("before") + F.pmod(F.xxhash64(*dims), F.col("n"))
    dealt = rows.join(days, "date").withColumn("_file", F.floor(place / rows_per_file).cast("int"))
    dealt = dealt.repartitionById(n_files, "_file").select(*schema.fieldNames())
    batch = uuid.uuid4().hex
    ordered = dealt.sortWithinPartitions("site_url", "date", "query", "page")
    ordered.write.options(**BLOOM).option("compression", compression).parquet(log.data(batch))
    back = rows.sparkSession.read.schema(schema).parquet(log.data(batch)).withColumn("file", F.col("_metadata.file_name"))
    rollup.summarize(back, log.kind, "file").write.option("compression", "zstd").parquet(log.rollups(batch))
    hour = F.max("hour") if log.kind == "hourly" else F.lit(None).cast("int")
    told = rows.sparkSession.read.parquet(log.rollups(batch)).groupBy(*UNIT, "file")
    return stored(told.agg(F.sum("n_rows").alias("n_rows"), hour.alias("max_hour")).withColumn("batch", F.lit(batch)), "batch-parts")


def commit(rows: DataFrame, sizes: DataFrame, root: str, kind: str, compression: str = "snappy",
           open_since: dt.date | str | None = None) -> int:
    """Write ``rows`` as one batch and publish it; returns the number of units stored.

    ``sizes`` has the rows per day (date, n).
    """
    log = CommitLog(rows.sparkSession, root, kind)
    return publish(log, write_batch(log, rows, sizes, compression), open_since)


def publish(log: CommitLog, parts: DataFrame, open_since: dt.date | str | None = None) -> int:
    """Make a written batch visible, but for units that the version before holds for good."""
    mine = parts.select(*OF_BATCH).distinct()
    while True:
        seen = log.snapshot()
        held = seen.parts().select(*OF_BATCH, "max_hour")
        closed = _closed(held, log.kind, open_since).select(*UNIT)
        lost = mine.join(closed.distinct(), UNIT, "left_semi")
        replaced = held.join(mine.select(*UNIT), UNIT, "left_semi").select(*OF_BATCH).join(closed.distinct(), UNIT, "left_anti").distinct()
        dead = stored(lost.unionByName(replaced), "dead-units")
        live = parts.join(lost, OF_BATCH, "left_anti")
        manifest, n = log.write(_entries("part", live), _entries("dead", dead))
        if not n.get("part"):
            return 0
        if log.publish(seen, manifest, n.get("dead", 0)):
            stored_units = log.spark.read.parquet(log.manifest(manifest)).where("what = 'part'").select(*UNIT).distinct().count()
            if seen.version + 1 - seen.checkpoint >= CHECKPOINT_EVERY:
                checkpoint(log)
            return stored_units


def _entries(what: str, rows: DataFrame) -> DataFrame:
    missing = {"file": "string", "n_rows": "long", "max_hour": "int"}
    return rows.select(F.lit(what).alias("what"), *OF_BATCH, *(
        F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in missing.items()))


def checkpoint(log: CommitLog) -> bool:
    """Put the whole state into one manifest, so that readers need not put versions together; False if a writer was first."""
    seen = log.snapshot()
    manifest, n = log.write(_entries("part", seen.parts()), _entries("dead", seen.dead()))
    return log.publish(seen, manifest, n.get("dead", 0), checkpoint=True)


def compact(spark, root: str, kind: str, rows_per_file: int = ROWS_PER_FILE, compression: str = "snappy") -> int:
    """Rewrite small files, and files of batches with replaced units, into files of about ``rows_per_file`` rows.

    Facts are the same before and after; the new version is a checkpoint that names the new files in place of
    the old ones, which stay until ``vacuum``. Writers go on meanwhile: units that they replace while the files
    are rewritten are replaced in the new files, too. Returns the number of files rewritten.
    """
    log = CommitLog(spark, root, kind)
    seen = log.snapshot()
    if not seen.manifests:
        return 0
    parts = stored(seen.parts(), "live-parts")
    size = parts.groupBy("batch", "file").agg(F.sum("n_rows").alias("n"))
    old = stored(size.join(seen.dead().select("batch").distinct().withColumn("holed", F.lit(True)), "batch", "left").where(
        (F.col("n") < rows_per_file / 2) | F.col("holed")).select("batch", "file", "n", "holed"), "old-files")
    n_old = old.count()
    if n_old < 2 and old.where("holed").isEmpty():
        return 0
    of_file = ["batch", "file"]
    moved = parts.join(old.select(*of_file), of_file, "left_semi")
    sizes = moved.groupBy("date").agg(F.sum("n_rows").alias("n"))
    new = write_batch(log, facts_of(seen, old), sizes, compression, rows_per_file)
    known = stored(seen.dead(), "dead-units")
    fresh = new.select("batch").first()  # no row if nothing of the old files is live
    while True:
        now = log.snapshot()
        if now.checkpoint > seen.checkpoint and not _still_there(now, moved):
            return 0  # another compaction has moved these files
        late = now.dead().join(known, OF_BATCH, "left_anti").join(moved.select(*OF_BATCH).distinct(), OF_BATCH, "left_semi")
        remapped = late.select(*UNIT).distinct().withColumn("batch", F.lit(fresh.batch if fresh else None).cast("string"))
        left = now.entries("part").join(old.select(*of_file), of_file, "left_anti")
        dead = now.dead().join(left.select("batch").distinct(), "batch", "left_semi").select(*OF_BATCH).unionByName(remapped.select(*OF_BATCH))
        manifest, n = log.write(_entries("part", left.unionByName(new.select(*left.columns))), _entries("dead", dead))
        if log.publish(now, manifest, n.get("dead", 0), checkpoint=True):
            return n_old


def _still_there(now: Snapshot, moved: DataFrame) -> bool:
    of_file = ["batch", "file"]
    return moved.select(*of_file).distinct().join(now.entries("part").select(*of_file).distinct(), of_file, "left_anti").isEmpty()


def vacuum(spark, root: str, kind: str, older_than_hours: float = 24.0) -> int:
    """Delete batches that no live file needs, and versions and manifests before the last checkpoint, once they are
    older than ``older_than_hours`` (longer than any write or read takes). Returns the number of things deleted."""
    log = CommitLog(spark, root, kind)
    seen = log.snapshot()
    if not seen.manifests:
        return 0
    limit = (time.time() - older_than_hours * 3600) * 1000
    batches = {f"batch={r.batch}" for r in seen.entries("part").select("batch").distinct().collect()}  # one per write not compacted
    keep = [(log.data(), batches), (log.rollups(), batches), (f"{log.base}/_queries", batches), (f"{log.base}/_grams", batches), (f"{log.base}/_manifests", set(seen.manifests)),
            (f"{log.base}/_log", {log.entry(v).rsplit("/", 1)[1] for v in range(max(seen.checkpoint, 0), seen.version + 1)})]
    gone = 0
    for folder, needed in keep:
        for status in log.files.list(folder):
            name = status.getPath().getName()
            if name not in needed and status.getModificationTime() < limit:
                log.files.delete(f"{folder}/{name}")
                gone += 1
    return gone


def write_daily(rows: DataFrame, root: str, compression: str = "snappy", open_since: dt.date | str | None = None) -> int:
    """SNK-1: store the days that are not stored yet; running again with the same rows stores nothing.

    Days from ``open_since`` on, if given, are still provisional at the source: they are replaced.
    """
    return _write(rows.select(*DAILY_COLUMNS), root, "daily", compression, open_since)


def write_hourly(rows: DataFrame, root: str, compression: str = "snappy") -> int:
    """SNK-2 / STR-3: store or replace whole hourly units, except those already complete."""
    return _write(rows.select(*HOURLY_COLUMNS), root, "hourly", compression)


def _write(rows: DataFrame, root: str, kind: str, compression: str, open_since: dt.date | str | None = None) -> int:
    closed = closed_units(Store.at(rows.sparkSession, root), kind, open_since)
    new = rows.join(closed, UNIT, "left_anti")
    sizes = new.groupBy("date").agg(F.count("*").alias("n"))
    return commit(new, sizes, root, kind, compression, open_since)
