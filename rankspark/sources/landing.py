"""Landed API response pages -> fact rows (SRC-6, SRC-7) and page assembly (ING-4..6).

A fetcher lands each response page as one JSON record: the envelope
(site_url, date, fetch_id, start_row, fetched_at) plus the response ``rows``.
A page holds at most 25,000 rows, so flattening is a per-record ``inline``
with bounded fan-out, and no operation here ever gathers a whole day.

Which pages count is decided on *references*: a row per page with its size, a digest of its rows and where it
lies (file and row). The pages themselves are written once as they come and read once, those of chosen fetches
only, by a join with masks of the chosen references; no page takes part in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.schema import DAILY_COLUMNS, HOURLY_COLUMNS, PAGE_ROW_LIMIT, RAW_PAGE
from rankspark.session import stored

UNIT = ["site_url", "date"]
FETCH = ["site_url", "date", "fetch_id"]


CORRUPT = "_corrupt_record"
LANDED = T.StructType([*RAW_PAGE.fields, T.StructField(CORRUPT, T.StringType())])


def landed_pages(read: DataFrame) -> DataFrame:
    """Pages read with ``LANDED``, with a flag for records that did not parse as they should."""
    return read.select(*RAW_PAGE.fieldNames(), F.col(CORRUPT).isNotNull().alias("malformed"))


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of landed pages with the fixed envelope schema."""
    return landed_pages(spark.read.schema(LANDED).option("columnNameOfCorruptRecord", CORRUPT).json(path))


def _malformed(raw: DataFrame) -> Column:
    """Whether a page did not parse, or holds a row without its keys or counts."""
    holed = F.exists("rows", lambda r: r["keys"].isNull() | r["clicks"].isNull() | r["impressions"].isNull())
    flag = F.coalesce(holed, F.lit(False))
    return flag | F.col("malformed") if "malformed" in raw.columns else flag


def sized(raw: DataFrame) -> DataFrame:
    """Pages with their number of rows, whether they are good, and a digest of their rows."""
    n = F.coalesce(F.size("rows"), F.lit(0))
    return raw.select(*RAW_PAGE.fieldNames(), n.alias("n"), (~_malformed(raw)).alias("good"), F.xxhash64("rows").alias("digest"))


SIZED = T.StructType([*RAW_PAGE.fields, T.StructField("n", T.IntegerType()), T.StructField("good", T.BooleanType()), T.StructField("digest", T.LongType())])
PLACE = ["file", "row"]
REF = T.StructType([
    *(f for f in SIZED.fields if f.name != "rows"), T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])


def page_refs(pages: DataFrame) -> DataFrame:
    """References to stored (Parquet) pages that ``sized`` has made; the rows of the pages are not read."""
    return pages.select(*(c for c in REF.names if c not in PLACE), *_place())


def _place() -> list[Column]:
    return [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]


def _one_copy(pages: DataFrame) -> DataFrame:
    """Of re-delivered copies of a page the one that counts: the newest, then the largest, then a good one, then by
    its rows' digest; copies equal in all of that are alike, and one of them is taken."""
    found = pages if "digest" in pages.columns else sized(pages)
    order = [c for c in ("fetched_at", "n", "good", "digest", *PLACE) if c in found.columns]
    one = found.groupBy(*FETCH, "start_row").agg(F.max(F.struct(*order)).alias("copy"))
    return one.select(*FETCH, "start_row", *(F.col(f"copy.{c}").alias(c) for c in order), (~F.col("copy.good")).alias("bad"))


def _whole(c) -> F.Column:
    # Counts arrive as JSON numbers, sometimes floats (2.0). Round half-even to
    # a whole number, as the source engine's double->bigint cast does.
    return F.bround(c, 0).cast("bigint")


def _flat_rows(raw: DataFrame, *envelope: str) -> DataFrame:
    return raw.select(*envelope, F.inline("rows"))


def flatten_daily(raw: DataFrame) -> DataFrame:
    """SRC-6: keys = [query, page, device, country] -> the daily schema."""
    r = _flat_rows(raw, "site_url", "date")
    k = F.col("keys")
    return r.select(
        "site_url", "date",
        k[0].alias("query"), k[1].alias("page"), k[2].alias("device"), k[3].alias("country"),
        _whole(F.col("clicks")).alias("clicks"), _whole(F.col("impressions")).alias("impressions"),
        F.col("ctr").cast("double").alias("ctr"), F.col("position").cast("double").alias("position"),
    ).select(*DAILY_COLUMNS)


def hour_of_key(key) -> F.Column:
    """Local hour of an offset timestamp key such as ``2025-07-23T03:00:00-07:00``.

    Taken from the text between ``T`` and the first ``:``; converting through a
    timestamp would shift it into the session time zone.
    """
    return F.split(F.split(key, "T")[1], ":")[0].cast("int")


def flatten_hourly(raw: DataFrame) -> DataFrame:
    """SRC-7: keys = [hour key, query, page, device, country] -> the hourly schema.

    ``date`` is the requested date of the envelope, not the key's date.
    """
    r = _flat_rows(raw, "site_url", "date")
    k = F.col("keys")
    return r.select(
        "site_url", "date", hour_of_key(k[0]).alias("hour"),
        k[1].alias("query"), k[2].alias("page"), k[3].alias("device"), k[4].alias("country"),
        _whole(F.col("clicks")).alias("clicks"), _whole(F.col("impressions")).alias("impressions"),
        F.col("ctr").cast("double").alias("ctr"), F.col("position").cast("double").alias("position"),
    ).select(*HOURLY_COLUMNS)


def fetch_status(raw: DataFrame, page_limit: int = PAGE_ROW_LIMIT) -> DataFrame:
    """ING-4: one row per fetch with its completeness.

    A fetch is complete when its pages start at row 0, every page but the last
    is full, the starts are contiguous, the last page is short (possibly empty)
    and no page is malformed. Of re-delivered copies of a page one counts. Only
    per-page sizes are aggregated; the rows themselves never move here.
    """
    pages = _one_copy(raw)
    stats = pages.groupBy(*FETCH).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.min("start_row").alias("first_start"),
        F.max("start_row").alias("last_start"),
        F.sum("n").alias("n_rows"),
        F.max_by("n", "start_row").alias("last_size"),
        F.sum(F.when(F.col("n") == page_limit, 1).otherwise(0)).alias("full_pages"),
        F.max("fetched_at").alias("fetched_at"),
        F.count_if("bad").alias("n_malformed"),
    )
    complete = (
        (F.col("first_start") == 0)
        & (F.col("n_malformed") == 0)
        & (F.col("last_size") < page_limit)
        & (F.col("full_pages") == F.col("n_pages") - 1)
        & (F.col("last_start") == (F.col("n_pages") - 1) * page_limit)
        & (F.col("n_rows") == F.col("last_start") + F.col("last_size"))
    )
    return stats.withColumn("complete", complete)


def latest_complete_fetch(raw: DataFrame, page_limit: int = PAGE_ROW_LIMIT) -> DataFrame:
    """ING-4/6: per (site, date), the newest complete fetch; incomplete fetches
    are dropped, so a day that failed half-way contributes nothing."""
    st = fetch_status(raw, page_limit).where("complete")
    newest = F.max_by(F.struct("fetch_id", "n_rows"), F.struct("fetched_at", "fetch_id"))
    return st.groupBy(*UNIT).agg(newest.alias("pick")).select(
        *UNIT, F.col("pick.fetch_id").alias("fetch_id"), F.col("pick.n_rows").alias("n_rows"))


MASKS_BROADCAST = 500_000  # masks of 64 references (some 100 bytes each) that are sent to every task


def take_pages(pages: DataFrame, refs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The stored pages of the ``chosen`` fetches, one copy each; ``refs`` are their references.

    The places wanted are sent as masks, a bit for each of 64 neighbouring rows of a file.
    """
    wanted = _one_copy(refs.join(chosen.select(*FETCH), FETCH, "left_semi")).where("good")
    block = F.shiftright("row", 6).alias("block")
    masks = stored(wanted.groupBy("file", block).agg(F.expr("bit_or(shiftleft(1L, int(row & 63)))").alias("mask")), "chosen-pages")
    if masks.count() <= MASKS_BROADCAST:
        masks = F.broadcast(masks)
    placed = pages.select(*RAW_PAGE.fieldNames(), *_place()).select("*", block).join(masks, ["file", "block"])
    return placed.where("getbit(mask, int(row & 63)) = 1").select(*RAW_PAGE.fieldNames())


def assemble_pages(raw: DataFrame, page_limit: int = PAGE_ROW_LIMIT, chosen: DataFrame | None = None) -> DataFrame:
    """ING-4: the pages of each (site, date)'s newest complete fetch, one copy each.

    ``chosen`` restricts them to given fetches (site_url, date, fetch_id). Days whose
    fetch has zero rows yield no pages, so nothing is written for them and they stay
    in the fetch plan (ING-5). The pages are stored once, then read by reference.
    """
    pages = stored(sized(raw), "landed-pages")
    refs = page_refs(pages)
    if chosen is None:
        chosen = latest_complete_fetch(refs, page_limit).where(F.col("n_rows") > 0)
    return take_pages(pages, refs, chosen)


def incomplete_fetches(status: DataFrame, page_limit: int = PAGE_ROW_LIMIT) -> DataFrame:
    """The fetches of a ``fetch_status`` that are not complete, and what each lacks."""
    before_last = F.col("n_pages") - 1
    gap = (F.col("last_start") != before_last * page_limit) | (F.col("full_pages") < before_last)
    problem = (
        F.when(F.col("n_malformed") > 0, "malformed page").when(F.col("first_start") != 0, "first page missing")
        .when(gap, "page missing or of another size").otherwise("last page missing"))
    return status.where(~F.col("complete")).select(*FETCH, "n_pages", "n_rows", "fetched_at", problem.alias("problem"))


BUCKET_ROWS = 100_000  # rows of a day that are put in order together, or those of a page if that has more


def to_response_pages(fact: DataFrame, kind: str = "daily", fetch_id: str = "replay",
                      fetched_at: str = "2000-01-01 00:00:00", hour_offset: str = "+00:00",
                      page_limit: int = PAGE_ROW_LIMIT) -> DataFrame:
    """Package stored fact rows as landed response pages (the inverse of flatten).

    Used to replay a stored table through the ingest path (backfill, migration
    of per-day files, end-to-end checks). Each (site, date) becomes one fetch:
    pages of at most ``page_limit`` rows with contiguous start rows, plus an
    empty closing page after a full last page, exactly as the source pages.

    Rows are numbered without ever sorting a large day in one task: a day of more than BUCKET_ROWS rows is
    split into hash buckets of about that size, rows are numbered inside their bucket, and each bucket's
    offset is the running total of the bucket sizes before it (a window over per-bucket counts, one small
    row per bucket). A row is shuffled once, as the flat columns of the facts, to its bucket, where the pages
    that lie in it are gathered; only the rows of pages over the edge of two buckets move again, to (site, date, page).
    """
    dims = [F.col(c) for c in ("query", "page", "device", "country")]
    if kind == "hourly":
        hour_key = F.concat(F.col("date"), F.lit("T"), F.lpad(F.col("hour").cast("string"), 2, "0"),
                            F.lit(":00:00" + hour_offset))
        keys = F.array(hour_key, *dims)
    else:
        keys = F.array(*dims)
    row = F.struct(
        keys.alias("keys"),
        F.col("clicks").cast("double").alias("clicks"),
        F.col("impressions").cast("double").alias("impressions"),
        F.col("ctr").cast("double").alias("ctr"),
        F.col("position").cast("double").alias("position"),
    )
    size = max(page_limit, BUCKET_ROWS)
    cols = ["query", "page", "device", "country", "clicks", "impressions", "ctr", "position"]
    cols = ["hour", *cols] if kind == "hourly" else cols
    # Stored, so that Spark knows how small it is and the facts need no shuffle to meet it.
    days = stored(fact.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n")), "page-days")
    rows = fact.select(*UNIT, *cols).join(days, UNIT)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*cols), F.ceil(F.col("n") / size)).cast("int"))

    split = not days.where(F.col("n") > size).isEmpty()
    if split:
        before = Window.partitionBy(*UNIT).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sizes = rows.where(F.col("n") > size).groupBy(*UNIT, "bucket").agg(F.count(F.lit(1)).alias("size"))
        sizes = stored(sizes.select("*", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")), "page-buckets")
        rows = rows.join(sizes, [*UNIT, "bucket"], "left")
    start = F.coalesce("offset", F.lit(0)) if split else F.lit(0)
    in_bucket = Window.partitionBy(*UNIT, "bucket").orderBy(*cols)
    indexed = rows.withColumn("i", start + F.row_number().over(in_bucket) - 1)
    indexed = indexed.withColumn("row", row).withColumn("page_no", F.floor(F.col("i") / page_limit))

    def gathered(part: DataFrame, *by: str) -> DataFrame:
        pages = part.groupBy(*UNIT, *by, "page_no").agg(F.array_sort(F.collect_list(F.struct("i", "row"))).alias("numbered"))
        return pages.select(
            *UNIT, (F.col("page_no") * page_limit).cast("bigint").alias("start_row"),
            F.transform("numbered", lambda x: x["row"]).alias("rows"))

    if split:
        first = F.col("page_no") * page_limit
        end = F.least(first + page_limit, F.col("n"))
        over_edge = F.col("size").isNotNull() & ((first < F.col("offset")) | (end > F.col("offset") + F.col("size")))
        pages = gathered(indexed.where(~over_edge), "bucket").unionByName(gathered(indexed.where(over_edge)))
    else:
        pages = gathered(indexed, "bucket")
    closing = days.where(F.col("n") % page_limit == 0).select(
        *UNIT, F.col("n").cast("bigint").alias("start_row"),
        F.array().cast(RAW_PAGE["rows"].dataType).alias("rows"))
    out = pages.unionByName(closing)
    return out.select(
        *UNIT, F.lit(fetch_id).alias("fetch_id"), "start_row",
        F.lit(fetched_at).cast("timestamp").alias("fetched_at"), "rows",
    ).select(*RAW_PAGE.fieldNames())
