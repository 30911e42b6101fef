"""The fact store: daily and hourly tables, each with a commit log of its files and units.

A reader takes a snapshot of the log (``sources.log``): the files of the newest version and the units, (site,
date), that each of them holds. It opens those files by name and lists no data folders; a site or
date bound given to ``daily()`` / ``hourly()`` leaves out the files that hold no such unit before any is
opened, and later predicates skip row groups by their statistics (a file covers a range of dates and is
sorted by site, date, query and page). Which units exist, and up to which hour, is read from the log, never
from facts. A unit's rows come from one batch: those of replaced hours, or of a writer that lost a race, are
left out by an anti-join that is only there while such rows exist.

Daily and hourly are separate tables: a daily report never reads hourly files, so a day with both is never
counted twice. A store can also wrap DataFrames already in memory (fixture views, tests).
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.functions.predicates import iso
from rankspark.schema import DAILY, HOURLY
from rankspark.sources.log import OF_BATCH, CommitLog, Snapshot
from rankspark.sources.rollup import live_rollup, summarize
from rankspark.sources.sqlcheck import check_leaves, limited, parse

KINDS = ("daily", "hourly")


def _bounds(site: str | None, since: dt.date | str | None, until: dt.date | str | None) -> Column:
    """Site and dates (both ends included), where they are given."""
    cond = F.lit(True)
    if site is not None:
        cond = cond & (F.col("site_url") == F.lit(site))
    if since is not None:
        cond = cond & (F.col("date") >= F.lit(iso(since)))
    if until is not None:
        cond = cond & (F.col("date") <= F.lit(iso(until)))
    return cond


def facts_of(snapshot: Snapshot, parts: DataFrame) -> DataFrame:
    """The live rows of the files that ``parts`` name; the driver learns their names, as any file scan does."""
    log = snapshot.log
    schema = DAILY if log.kind == "daily" else HOURLY
    files = sorted(f"{log.data(r.batch)}/{r.file}" for r in parts.select("batch", "file").distinct().collect())
    if not files:
        return log.spark.createDataFrame([], schema)
    # An explicit schema keeps `date` a string and fixes the measure types.
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
    facts = log.spark.read.schema(with_batch).option("basePath", log.data()).parquet(*files)
    if snapshot.n_dead:
        facts = facts.join(snapshot.dead(), OF_BATCH, "left_anti")
    return facts.select(*schema.fieldNames())


class Store:
    """Daily and hourly tables; each is built on first use only."""

    def __init__(self, spark: SparkSession, daily=None, hourly=None, root: str | None = None):
        self.spark = spark
        self.root = root
        self._daily, self._hourly = daily, hourly
        self._snapshots: dict[str, Snapshot] = {}

    def snapshot(self, kind: str) -> Snapshot:
        """The version of the table that this store reads: the newest when it was first asked for."""
        if kind not in self._snapshots:
            self._snapshots[kind] = CommitLog(self.spark, self.root, kind).snapshot()
        return self._snapshots[kind]

    @property
    def daily_df(self) -> DataFrame:
        if self.root is not None:
            return self._scan("daily", None)
        if callable(self._daily):
            self._daily = self._daily()
        return self._daily

    @property
    def hourly_df(self) -> DataFrame:
        if self.root is not None:
            return self._scan("hourly", None)
        if callable(self._hourly):
            self._hourly = self._hourly()
        return self._hourly

    # -- construction -------------------------------------------------------
    @classmethod
    def at(cls, spark: SparkSession, root: str) -> "Store":
        """Open the tables under ``root`` (missing tables read empty)."""
        return cls(spark, root=root.rstrip("/"))

    @classmethod
    def of(cls, spark: SparkSession, daily: DataFrame, hourly: DataFrame | None = None) -> "Store":
        if hourly is None:
            return cls(spark, daily, lambda: spark.createDataFrame([], HOURLY))
        return cls(spark, daily, hourly)

    @classmethod
    def fixtures(cls, spark: SparkSession, sf_dir: str) -> "Store":
        """The facts derived from the driver's tables in ``sf_dir``, as lazy views: nothing is written,
        and a report's filters and columns reach the scans of those tables."""
        from rankspark.sources.fixtures import daily_view, hourly_view

        return cls(spark, lambda: daily_view(spark, sf_dir), lambda: hourly_view(spark, sf_dir))

    # -- scans (SRC-1..3) ---------------------------------------------------
    def daily(self, site: str | None = None, require_site: bool = False,
              since: dt.date | str | None = None, until: dt.date | str | None = None) -> DataFrame:
        """The daily facts, of one site if given, of the dates ``since`` to ``until`` (both included) if given."""
        return self._scan("daily", site, require_site, since, until)

    def hourly(self, site: str | None = None, require_site: bool = False,
               since: dt.date | str | None = None, until: dt.date | str | None = None) -> DataFrame:
        return self._scan("hourly", site, require_site, since, until)

    def table(self, data_type: str = "daily", site: str | None = None) -> DataFrame:
        if data_type not in KINDS:
            raise ValueError(f"data_type must be 'daily' or 'hourly', not {data_type!r}")
        return self._scan(data_type, site)

    def _scan(self, kind: str, site: str | None, require_site: bool = False, since=None, until=None) -> DataFrame:
        bounds = _bounds(site, since, until)
        if self.root is not None:
            snapshot = self.snapshot(kind)
            df = facts_of(snapshot, snapshot.parts().where(bounds))
        else:
            df = self.daily_df if kind == "daily" else self.hourly_df
        if require_site and site is not None and self._unknown(df, kind, site):
            raise LookupError(f"no stored rows for site {site!r}")
        return df if site is None and since is None and until is None else df.where(bounds)

    def rollup(self, kind: str = "daily", site: str | None = None, since: dt.date | str | None = None,
               until: dt.date | str | None = None) -> DataFrame:
        """Sums and sketches per (site, date), and hour if hourly (``sources.rollup``). From the tables of a stored
        root, which commits keep up to date, no facts are read; of facts in memory they are computed."""
        if self.root is None:
            return summarize(self._scan(kind, site, since=since, until=until), kind)
        snapshot, bounds = self.snapshot(kind), _bounds(site, since, until)
        return live_rollup(snapshot, snapshot.parts().where(bounds)).where(bounds)

    def _unknown(self, df: DataFrame, kind: str, site: str) -> bool:
        known = df if self.root is None else self.snapshot(kind).parts()
        return known.where(F.col("site_url") == F.lit(site)).select("site_url").limit(1).count() == 0

    # -- catalog (SRC-5) ----------------------------------------------------
    def units(self, kind: str = "daily") -> DataFrame:
        """(site_url, date, n_rows, max_hour) of every stored unit; from the log where there is one."""
        if self.root is not None:
            return self.snapshot(kind).units()
        df = self.table(kind)
        hour = F.max("hour") if kind == "hourly" else F.lit(None).cast("int")
        return df.groupBy("site_url", "date").agg(F.count("*").alias("n_rows"), hour.alias("max_hour"))

    def sites(self) -> DataFrame:
        """Sorted distinct sites of the daily and hourly tables."""
        if self.root is None:
            both = self.daily_df.select("site_url").unionByName(self.hourly_df.select("site_url"))
        else:
            both = self.snapshot("daily").parts().select("site_url").unionByName(self.snapshot("hourly").parts().select("site_url"))
        return both.distinct().orderBy(F.asc_nulls_last("site_url"))

    # -- templated SQL (SRC-4) ----------------------------------------------
    def sql(self, sql: str, site: str | None = None, data_type: str = "daily",
            default_limit: int | None = None, nan_to_null: bool = False) -> DataFrame:
        """Run one SELECT/WITH statement with ``{site}`` / ``{site_hourly}`` bound; ``sources.sqlcheck`` says which may run.

        ``{site}`` is the daily table (hourly when ``data_type='hourly'``) and
        ``{site_hourly}`` the hourly one, both restricted to ``site``. Both are
        bound at once as DataFrame parameters, never spliced in as text. Any other
        brace pair is escaped so it reaches the SQL parser literally.
        ``default_limit`` caps a statement with no outer LIMIT (SRT-7);
        ``nan_to_null`` turns NaN into NULL in float columns (SNK-4), as the
        source's SQL endpoint does.
        """
        if data_type not in ("daily", "hourly"):
            raise ValueError(f"data_type must be 'daily' or 'hourly', not {data_type!r}")
        text = sql.strip().rstrip(";").strip()
        named = _PLACEHOLDER.sub(lambda m: f"__{m.group(1)}" if m.group(1) in ("site", "site_hourly") else m.group(0), text)
        plan = parse(self.spark, named, frozenset(["__site", "__site_hourly"]))
        escaped = _escape_other_braces(text, ("site", "site_hourly"))
        used = set(_PLACEHOLDER.findall(escaped.replace("{{", "").replace("}}", "")))
        bound = {}
        if "site" in used:
            bound["site"] = self.table(data_type, site)
        if "site_hourly" in used:
            bound["site_hourly"] = self.hourly(site)
        df = self.spark.sql(escaped, **bound)
        check_leaves(df, list(bound.values()))
        if default_limit is not None and not limited(plan):
            df = df.limit(default_limit)
        if nan_to_null:
            from rankspark.sinks.export import nan_to_null as _nan_to_null

            df = _nan_to_null(df)
        return df


_PLACEHOLDER = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")


def _escape_other_braces(text: str, names: tuple[str, ...]) -> str:
    out = []
    i = 0
    for m in _PLACEHOLDER.finditer(text):
        out.append(text[i:m.start()].replace("{", "{{").replace("}", "}}"))
        out.append(m.group(0) if m.group(1) in names else "{{" + m.group(1) + "}}")
        i = m.end()
    out.append(text[i:].replace("{", "{{").replace("}", "}}"))
    return "".join(out)
