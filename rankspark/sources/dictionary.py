"""Substring search over stored facts through a dictionary of queries (FLT-5, FLT-8, FLT-15).

``index`` gives every live batch that has none a dictionary, (query, file), and a posting table, (gram, query), of the
three-character pieces of its lower-cased queries, sorted so that a look-up reads few row groups. A search takes the
pieces that the pattern's literal parts are bound to contain, finds the queries that have all of them, applies
the predicate itself to those, and reads the facts of the files that hold a hit, semi-joined with the hits. A pattern
without three literal characters in a row looks through the dictionary. Batches without an index yet are
searched by their facts' queries. The result equals the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions import predicates as P
from rankspark.sources.log import CommitLog, Snapshot
from rankspark.sources.store import Store, _bounds, facts_of

GRAM = 3
MODES = {"like": P.like, "ilike": P.ilike, "contains": P.contains_ci}


def _folder(log: CommitLog, part: str, batch: str | None = None) -> str:
    return f"{log.base}/_{part}" + (f"/batch={batch}" if batch else "")


def _indexed(log: CommitLog) -> set[str]:
    """Batches whose postings, written last, are whole."""
    names = log.files.names(_folder(log, "grams"))
    return {n[6:] for n in names if log.files.fs.exists(log.files.path(f"{_folder(log, 'grams')}/{n}/_SUCCESS"))}


def index(spark: SparkSession, root: str, kind: str) -> int:
    """Index the live batches that have no dictionary yet (compaction keeps them few); their number."""
    log = CommitLog(spark, root, kind)
    todo = {r.batch for r in log.snapshot().parts().select("batch").distinct().collect()} - _indexed(log)
    for batch in sorted(todo):
        facts = spark.read.schema("query string").parquet(log.data(batch))
        queries = facts.where("query IS NOT NULL").select("query", F.col("_metadata.file_name").alias("file")).distinct()
        queries.sortWithinPartitions("query").write.mode("overwrite").parquet(_folder(log, "queries", batch))
        known = spark.read.schema("query string, file string").parquet(_folder(log, "queries", batch)).select("query").distinct()
        low = F.lower("query")
        starts = F.when(F.char_length(low) >= GRAM, F.sequence(F.lit(1), F.char_length(low) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
        grams = known.select("query", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM))))).alias("gram"))
        grams.repartitionByRange("gram", "query").sortWithinPartitions("gram", "query").write.mode("overwrite").parquet(_folder(log, "grams", batch))
    return len(todo)


def pieces(pattern: str, mode: str) -> list[str]:
    """The literal parts of a pattern that every match contains, lower-cased."""
    return [p.lower() for p in ([pattern] if mode == "contains" else re.split("[%_]+", pattern)) if len(p) >= GRAM]


def _hits(snapshot: Snapshot, batches: list[str], pattern: str, mode: str) -> DataFrame:
    """(batch, file, query) of the queries in the given indexed batches that match."""
    log, spark = snapshot.log, snapshot.log.spark
    read = lambda part, ddl: spark.read.schema(ddl + ", batch string").option("basePath", _folder(log, part)).parquet(*(_folder(log, part, b) for b in batches))
    said: Column = MODES[mode]("query", pattern)
    queries = read("queries", "query string, file string").where(said)
    wanted = _grams(spark, pieces(pattern, mode))
    if wanted:
        posted = read("grams", "gram string, query string").where(F.col("gram").isin(wanted))
        found = posted.groupBy("batch", "query").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("batch", "query")
        queries = queries.join(found, ["batch", "query"], "left_semi")
    return queries.select("batch", "file", "query")


def _grams(spark: SparkSession, parts: list[str]) -> list[str]:
    """The distinct pieces of GRAM characters, lower-cased and cut by Spark itself, as they are in the postings."""
    if not parts:
        return []
    low = F.lower("p")
    cut = F.transform(F.sequence(F.lit(1), F.char_length(low) - (GRAM - 1)), lambda i: F.substring(low, i, F.lit(GRAM)))
    rows = spark.createDataFrame([(p,) for p in parts], "p string").where(F.char_length(low) >= GRAM)
    return sorted({r.g for r in rows.select(F.explode(cut).alias("g")).collect()})


def matching(store: Store, pattern: str, mode: str = "like", kind: str = "daily", site: str | None = None, since=None, until=None) -> DataFrame:
    """The facts whose query matches: 'like', 'ilike' (patterns with % and _), or 'contains' (any case)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    said, where = MODES[mode]("query", pattern), _bounds(site, since, until)
    if store.root is None:
        return store.table(kind).where(where & said)
    snapshot = store.snapshot(kind)
    parts = snapshot.parts().where(where)
    live = {r.batch for r in parts.select("batch").distinct().collect()}
    known = sorted(live & _indexed(snapshot.log))
    rest = parts.where(~F.col("batch").isin(known)) if known else parts
    out = facts_of(snapshot, rest).where(where & said)
    if known:
        hits = _hits(snapshot, known, pattern, mode).join(parts.select("batch", "file").distinct(), ["batch", "file"], "left_semi")
        some = facts_of(snapshot, hits).where(where)
        out = out.unionByName(some.join(hits.select("query").distinct(), "query", "left_semi").select(*out.columns))
    return out
