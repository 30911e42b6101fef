"""Landed response pages -> store (SRC-6/7, ING-4..6, SNK-1..5, STR-1..3)."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from rankspark.plans.ingest import plan_daily
from rankspark.schema import PAGE_ROW_LIMIT, RAW_PAGE
from rankspark.sinks.export import archive, csv_frame, export_csv, nan_to_null
from rankspark.sources.landing import (
    assemble_pages, fetch_status, flatten_daily, flatten_hourly, hour_of_key, read_landing,
)
from rankspark.sources.store import Store
from rankspark.streaming.ingest import ingest_batch, stream_daily, stream_hourly


def land(folder, site, date, fetch_id, start_row, rows, fetched_at="2024-02-01T00:00:00Z"):
    os.makedirs(folder, exist_ok=True)
    rec = {"site_url": site, "date": date, "fetch_id": fetch_id, "start_row": start_row,
           "fetched_at": fetched_at, "rows": rows}
    with open(os.path.join(folder, f"{fetch_id}-{start_row}-{uuid.uuid4().hex[:6]}.json"), "w") as f:
        f.write(json.dumps(rec) + "\n")


def drow(i, clicks=1, impressions=10):
    return {"keys": [f"q{i}", f"/p{i % 3}", "MOBILE", "twn"], "clicks": clicks,
            "impressions": impressions, "ctr": clicks / impressions, "position": 1.5}


def hrow(hour, i=0, clicks=1):
    return {"keys": [f"2025-04-07T{hour:02d}:00:00-07:00", f"q{i}", "/p", "MOBILE", "twn"],
            "clicks": clicks, "impressions": 10, "ctr": clicks / 10, "position": 2.0}


def test_flatten_daily_types_and_mixed_numbers(spark, tmp_path):
    land(str(tmp_path), "s", "2024-01-01", "f1", 0,
         [drow(1, clicks=2, impressions=10), {**drow(2), "clicks": 3.0, "impressions": 7.0}])
    rows = flatten_daily(read_landing(spark, str(tmp_path))).orderBy("query").collect()
    assert [(r.query, r.page, r.device, r.country, r.clicks, r.impressions) for r in rows] == [
        ("q1", "/p1", "MOBILE", "twn", 2, 10), ("q2", "/p2", "MOBILE", "twn", 3, 7)]
    assert dict(flatten_daily(read_landing(spark, str(tmp_path))).dtypes)["clicks"] == "bigint"


def test_hour_key_keeps_local_hour(spark, tmp_path):
    df = spark.createDataFrame([("2025-04-07T03:00:00-07:00",), ("2025-07-23T23:00:00+09:00",)], "k string")
    assert [r[0] for r in df.select(hour_of_key(F.col("k"))).collect()] == [3, 23]
    land(str(tmp_path), "s", "2025-04-06", "h1", 0, [hrow(3)])
    r = flatten_hourly(read_landing(spark, str(tmp_path))).first()
    assert (r.date, r.hour, r.query) == ("2025-04-06", 3, "q0")


def _status(spark, folder, limit):
    return {r.fetch_id: (r.complete, r.n_rows) for r in fetch_status(read_landing(spark, folder), limit).collect()}


def test_page_completeness_rules(spark, tmp_path):
    f = str(tmp_path)
    # exactly 2 full pages then an empty page: complete
    land(f, "s", "d1", "exact", 0, [drow(i) for i in range(3)])
    land(f, "s", "d1", "exact", 3, [drow(i) for i in range(3, 6)])
    land(f, "s", "d1", "exact", 6, [])
    # full page then a short page: complete
    land(f, "s", "d2", "short", 0, [drow(i) for i in range(3)])
    land(f, "s", "d2", "short", 3, [drow(9)])
    # full page only (last page missing): incomplete
    land(f, "s", "d3", "missing", 0, [drow(i) for i in range(3)])
    # gap between pages: incomplete
    land(f, "s", "d4", "gap", 0, [drow(i) for i in range(3)])
    land(f, "s", "d4", "gap", 6, [drow(1)])
    # not starting at 0: incomplete
    land(f, "s", "d5", "late", 3, [drow(1)])
    # the same page delivered twice counts once
    land(f, "s", "d6", "dup", 0, [drow(1), drow(2)])
    land(f, "s", "d6", "dup", 0, [drow(1), drow(2)])
    # zero-row day: complete, zero rows
    land(f, "s", "d7", "empty", 0, [])
    st = _status(spark, f, 3)
    assert st == {"exact": (True, 6), "short": (True, 4), "missing": (False, 3), "gap": (False, 4),
                  "late": (False, 1), "dup": (True, 2), "empty": (True, 0)}
    pages = assemble_pages(read_landing(spark, f), 3)
    got = {r.date: r.n for r in flatten_daily(pages).groupBy("date").agg(F.count("*").alias("n")).collect()}
    assert got == {"d1": 6, "d2": 4, "d6": 2}


def test_newest_complete_fetch_wins(spark, tmp_path):
    f = str(tmp_path)
    land(f, "s", "d", "old", 0, [drow(1, clicks=1)], fetched_at="2024-01-01T00:00:00Z")
    land(f, "s", "d", "new", 0, [drow(1, clicks=2)], fetched_at="2024-01-02T00:00:00Z")
    land(f, "s", "d", "newest-broken", 3, [drow(1, clicks=3)], fetched_at="2024-01-03T00:00:00Z")
    rows = flatten_daily(assemble_pages(read_landing(spark, f), 3)).collect()
    assert [r.clicks for r in rows] == [2]


def test_real_page_limit_boundary(spark, tmp_path):
    f = str(tmp_path)
    land(f, "s", "d", "f", 0, [drow(i) for i in range(PAGE_ROW_LIMIT)])
    assert _status(spark, f, PAGE_ROW_LIMIT) == {"f": (False, PAGE_ROW_LIMIT)}
    land(f, "s", "d", "f", PAGE_ROW_LIMIT, [])
    assert _status(spark, f, PAGE_ROW_LIMIT) == {"f": (True, PAGE_ROW_LIMIT)}


def test_daily_batch_ingest_append_once_and_idempotent(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "store")
    sites = ["https://example.com/", "sc-domain:my_site.com"]
    for s in sites:
        land(landing, s, "2024-01-01", f"f-{len(s)}", 0, [drow(i, clicks=1) for i in range(4)])
    land(landing, sites[0], "2024-01-02", "zero", 0, [])
    ingest_batch(spark, landing, root, "daily")
    store = Store.at(spark, root)
    assert [r.site_url for r in store.sites().collect()] == sorted(sites)
    assert store.daily(sites[0]).count() == 4
    # A later fetch for a stored day never touches it; a re-run changes nothing.
    land(landing, sites[0], "2024-01-01", "later", 0, [drow(i, clicks=9) for i in range(2)],
         fetched_at="2024-03-01T00:00:00Z")
    ingest_batch(spark, landing, root, "daily")
    ingest_batch(spark, landing, root, "daily")
    store = Store.at(spark, root)
    assert store.daily(sites[0]).agg(F.sum("clicks")).first()[0] == 4
    assert store.daily().count() == 8
    assert dict(store.daily().dtypes)["date"] == "string"
    # The zero-row day was not stored, so it stays in the plan (ING-5).
    plan = plan_daily(store.daily(), [sites[0]], "2024-01-03", history_days=2)
    assert [r.date for r in plan.collect()] == ["2024-01-02"]


def test_hourly_replace_until_complete(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "store")
    land(landing, "s", "2025-04-07", "a", 0, [hrow(h) for h in range(23)], fetched_at="2025-04-07T23:30:00Z")
    ingest_batch(spark, landing, root, "hourly")
    assert Store.at(spark, root).hourly().agg(F.max("hour")).first()[0] == 22
    land(landing, "s", "2025-04-07", "b", 0, [hrow(h, clicks=2) for h in range(24)],
         fetched_at="2025-04-08T06:00:00Z")
    ingest_batch(spark, landing, root, "hourly")
    h = Store.at(spark, root).hourly()
    assert (h.count(), h.agg(F.sum("clicks")).first()[0]) == (24, 48)
    # Complete day is frozen: later data is ignored.
    land(landing, "s", "2025-04-07", "c", 0, [hrow(h, clicks=5) for h in range(24)],
         fetched_at="2025-04-09T06:00:00Z")
    ingest_batch(spark, landing, root, "hourly")
    h = Store.at(spark, root).hourly()
    assert (h.count(), h.agg(F.sum("clicks")).first()[0]) == (24, 48)


def test_stream_daily_pages_across_runs(spark, tmp_path):
    landing, root, ckpt = str(tmp_path / "landing"), str(tmp_path / "store"), str(tmp_path / "ckpt")
    os.makedirs(landing)
    land(landing, "s", "2024-01-01", "f", 0, [drow(i) for i in range(PAGE_ROW_LIMIT)])
    land(landing, "s", "2024-01-02", "g", 0, [drow(1)])
    stream_daily(spark, landing, root, ckpt).awaitTermination(300)
    assert {r.date for r in Store.at(spark, root).daily().select("date").distinct().collect()} == {"2024-01-02"}
    land(landing, "s", "2024-01-01", "f", PAGE_ROW_LIMIT, [drow(7)])
    stream_daily(spark, landing, root, ckpt).awaitTermination(300)
    stream_daily(spark, landing, root, ckpt).awaitTermination(300)  # nothing new: no change
    d = Store.at(spark, root).daily()
    assert d.where("date = '2024-01-01'").count() == PAGE_ROW_LIMIT + 1
    assert d.count() == PAGE_ROW_LIMIT + 2


def test_stream_hourly(spark, tmp_path):
    landing, root, ckpt = str(tmp_path / "landing"), str(tmp_path / "store"), str(tmp_path / "ckpt")
    land(landing, "s", "2025-04-07", "a", 0, [hrow(h) for h in range(20)], fetched_at="2025-04-07T20:30:00Z")
    stream_hourly(spark, landing, root, ckpt).awaitTermination(300)
    land(landing, "s", "2025-04-07", "b", 0, [hrow(h) for h in range(24)], fetched_at="2025-04-08T01:00:00Z")
    stream_hourly(spark, landing, root, ckpt).awaitTermination(300)
    assert Store.at(spark, root).hourly().count() == 24


def test_exports(spark, tmp_path):
    qt = spark.createDataFrame([("a, b", 3, 1000, 12.345, 2.25), ("c", 1, 10, float("nan"), 1.0)],
                               "query string, clicks long, impressions long, ctr double, position double")
    assert nan_to_null(qt).where("ctr IS NULL").count() == 1
    assert csv_frame(qt).first().CTR == "12.35"
    out = str(tmp_path / "csv")
    export_csv(qt.where("query = 'a, b'"), out)
    text = "".join(open(os.path.join(out, p)).read() for p in sorted(os.listdir(out)) if p.endswith(".csv"))
    assert text.splitlines()[0] == "Query,Clicks,Impressions,CTR,Position"
    assert '"a, b",3,1000,12.35,2.3' in text or '"a, b",3,1000,12.35,2.2' in text
    arch = str(tmp_path / "arch")
    archive(qt, arch)
    assert any(p.endswith(".zstd.parquet") for p in os.listdir(arch))
    assert spark.read.parquet(arch).count() == 2


@pytest.mark.parametrize("site", ["https://example.com/", "sc-domain:my_site.com", "a=b/c%d"])
def test_site_url_round_trip(spark, tmp_path, site):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "store")
    land(landing, site, "2024-01-01", "f", 0, [drow(1)])
    ingest_batch(spark, landing, root, "daily")
    assert [r.site_url for r in Store.at(spark, root).sites().collect()] == [site]
    assert Store.at(spark, root).daily(site).count() == 1


def test_response_pages_boundaries(spark):
    from rankspark.schema import DAILY
    from rankspark.sources.landing import to_response_pages

    rows = [("s", "d1", f"q{i}", "/p", "M", "twn", 1, 2, 0.5, 1.0) for i in range(6)]
    rows += [("s", "d2", f"q{i}", "/p", "M", "twn", 1, 2, 0.5, 1.0) for i in range(4)]
    pages = to_response_pages(spark.createDataFrame(rows, DAILY), page_limit=3)
    got = sorted((r.date, r.start_row, len(r.rows)) for r in pages.collect())
    # d1: two full pages and an empty closing page; d2: a full page and a short one.
    assert got == [("d1", 0, 3), ("d1", 3, 3), ("d1", 6, 0), ("d2", 0, 3), ("d2", 3, 1)]
    st = {r.date: (r.complete, r.n_rows) for r in fetch_status(pages, 3).collect()}
    assert st == {"d1": (True, 6), "d2": (True, 4)}


def test_half_written_day_is_repaired(spark, tmp_path, monkeypatch):
    # A job lost between its data and its manifest leaves rows that no reader sees; a re-run stores the day whole.
    from rankspark.schema import DAILY
    from rankspark.sinks import fact
    from rankspark.sources.log import CommitLog

    rows = [("s", "2024-01-01", f"q{i}", "/p", "M", "twn", i, 10, 0.1, 1.0) for i in range(50)]
    df, root = spark.createDataFrame(rows, DAILY), str(tmp_path / "store")
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            fact.write_daily(df.limit(20), root)
    assert os.path.isdir(os.path.join(root, "daily")) and Store.at(spark, root).daily().count() == 0
    assert fact.write_daily(df, root) == 1 and fact.write_daily(df, root) == 0
    assert Store.at(spark, root).daily().count() == 50


def test_malformed_page_makes_the_fetch_incomplete(spark, tmp_path):
    f, root = str(tmp_path / "landing"), str(tmp_path / "store")
    land(f, "s", "2024-01-01", "bad", 0, [drow(1), {**drow(2), "clicks": "abc"}])
    land(f, "s", "2024-01-02", "null", 0, [{**drow(1), "clicks": None}])
    land(f, "s", "2024-01-03", "good", 0, [drow(1)])
    st = {r.fetch_id: (r.complete, r.n_malformed) for r in fetch_status(read_landing(spark, f)).collect()}
    assert st == {"bad": (False, 1), "null": (False, 1), "good": (True, 0)}
    ingest_batch(spark, f, root, "daily")
    assert [r.date for r in Store.at(spark, root).daily().collect()] == ["2024-01-03"]


def test_copies_of_a_page_with_different_rows(spark, tmp_path):
    f = str(tmp_path)
    land(f, "s", "d", "x", 0, [drow(1)], fetched_at="2024-01-01T00:00:00Z")
    land(f, "s", "d", "x", 0, [drow(2), drow(3)], fetched_at="2024-01-02T00:00:00Z")
    raw = read_landing(spark, f)
    assert [r.n_rows for r in fetch_status(raw, 3).collect()] == [2]
    assert sorted(r.query for r in flatten_daily(assemble_pages(raw, 3)).collect()) == ["q2", "q3"]


def test_open_fetches_wait_in_the_page_log(spark, tmp_path):
    from rankspark.streaming.ingest import open_fetches

    landing, root, ckpt = str(tmp_path / "landing"), str(tmp_path / "store"), str(tmp_path / "ckpt")
    land(landing, "s", "2024-01-01", "f", 0, [drow(i) for i in range(3)])
    stream_daily(spark, landing, root, ckpt, page_limit=3).awaitTermination(300)
    assert [(r.fetch_id, r.n_pages, r.problem) for r in open_fetches(spark, root, "daily", 3).collect()] == [("f", 1, "last page missing")]
    land(landing, "s", "2024-01-01", "f", 3, [drow(9)])
    stream_daily(spark, landing, root, ckpt, page_limit=3).awaitTermination(300)
    assert open_fetches(spark, root, "daily", 3).count() == 0
    assert Store.at(spark, root).daily().count() == 4


def test_csv_keeps_blanks_and_quotes(spark, tmp_path):
    qt = spark.createDataFrame([('  lead "x", ', 3, 1000, 12.345, 2.25)], "query string, clicks long, impressions long, ctr double, position double")
    export_csv(qt, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(str(tmp_path / "csv"))
    assert back.first().Query == '  lead "x", '


def test_write_daily_from_plain_rows(spark, tmp_path):
    from rankspark.schema import DAILY
    from rankspark.sinks.fact import write_daily

    rows = [("s", f"2024-01-0{d}", f"q{i}", "/p", "M", "twn", i, 10, 0.1, 1.0) for d in (1, 2) for i in range(5)]
    df = spark.createDataFrame(rows, DAILY)
    root = str(tmp_path / "store")
    write_daily(df, root)
    write_daily(df, root)  # idempotent
    got = Store.at(spark, root).daily()
    assert got.count() == 10
    assert got.exceptAll(df).count() == 0


def test_stream_one_file_per_batch(spark, tmp_path):
    # Force a day's pages into different micro-batches of one run.
    landing, root, ckpt = str(tmp_path / "landing"), str(tmp_path / "store"), str(tmp_path / "ckpt")
    land(landing, "s", "2024-01-01", "f", 0, [drow(i) for i in range(PAGE_ROW_LIMIT)])
    land(landing, "s", "2024-01-01", "f", PAGE_ROW_LIMIT, [drow(i) for i in range(2)])
    land(landing, "s", "2024-01-02", "g", 0, [drow(1)])
    q = stream_daily(spark, landing, root, ckpt, max_files_per_trigger=1)
    q.awaitTermination(300)
    d = Store.at(spark, root).daily()
    assert {r.date: r.n for r in d.groupBy("date").agg(F.count("*").alias("n")).collect()} == \
        {"2024-01-01": PAGE_ROW_LIMIT + 2, "2024-01-02": 1}


def test_replayed_rows_are_shuffled_once(spark, monkeypatch):
    from rankspark.schema import DAILY
    from rankspark.sources import landing

    rows = [("s", f"2024-01-{d:02d}", f"q{i % 90}", f"/p{i}", "M", "twn", i % 5, i, 0.5, float(i % 7)) for d in (1, 2) for i in range(d * 150)]
    facts = spark.createDataFrame(rows + rows[:1] * 3, DAILY)
    whole = landing.to_response_pages(facts, page_limit=7)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # before: 4 shuffles of all rows, to join sizes, number, join offsets and gather
    monkeypatch.setattr(landing, "BUCKET_ROWS", 20)
    for pages in (whole, landing.to_response_pages(facts, page_limit=7)):  # the second has pages over the edges of buckets
        sizes = {(r.date, r.start_row): len(r.rows) for r in pages.collect()}
        assert sizes == {(d, i): min(7, n - i) for d, n in (("2024-01-01", 153), ("2024-01-02", 300)) for i in range(0, n, 7)}
        assert pages.schema.simpleString() == RAW_PAGE.simpleString()
        back = landing.flatten_daily(pages)
        assert back.exceptAll(facts).isEmpty() and facts.exceptAll(back).isEmpty()


def test_landed_replay_is_compressed(spark, tmp_path):
    from rankspark.queries.ingest import _land

    _land(spark.createDataFrame([], RAW_PAGE), str(tmp_path))
    _land(spark.createDataFrame([("s", "2024-01-01", "f", 0, None, [])], RAW_PAGE), str(tmp_path))
    names = [n for n in os.listdir(tmp_path / "landing") if n.startswith("part-")]
    assert names and all(n.endswith(".json.gz") for n in names)
    assert spark.read.schema(RAW_PAGE).json(str(tmp_path / "landing")).count() == 1


def _shuffled(df):
    """The columns of every shuffle in the plan of ``df``."""
    import re

    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [re.findall(r"(\w+)#\d+", cols) for cols in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", text)]


def test_shuffled_rows_are_narrow(spark):
    """Lines go into shuffled joins as numbers, without texts or fine times; replayed rows go to their bucket as flat columns."""
    from rankspark.sources.landing import to_response_pages

    facts = Store.fixtures(spark, "/root/testdata/sf0.001").daily()
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")  # as if the dimensions were large
    try:
        lines = [c for c in _shuffled(facts.select("*")) if "l_partkey" in c and "p_name" not in c]
        assert lines and not any({"l_shipdate", "l_extendedprice", "l_quantity", "n_name"} & set(c) for c in lines)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    rows = [c for c in _shuffled(to_response_pages(facts, "daily", page_limit=7)) if "bucket" in c]
    assert rows and not any("row" in c or "keys" in c for c in rows)
