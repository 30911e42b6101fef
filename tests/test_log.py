"""Commit log, snapshots, compaction, clean-up, and the page log of the stream."""

import json
import os
import threading

from pyspark.sql import functions as F

from rankspark.schema import DAILY, HOURLY, RAW_PAGE
from rankspark.sinks import fact
from rankspark.sinks.fact import compact, publish, vacuum, write_batch, write_daily, write_hourly
from rankspark.sources.landing import assemble_pages, fetch_status, flatten_daily, page_refs, read_landing, sized, take_pages
from rankspark.sources.log import CommitLog, Files
from rankspark.sources.store import Store
from rankspark.session import stored
from rankspark.streaming import ingest
from rankspark.streaming.ingest import dropped_fetches, open_fetches, process_pages, stream_daily
from tests.test_ingest import drow, land


def daily(spark, units, clicks=1, n=3):
    rows = [(s, d, f"q{i}", f"/p{i}", "M", "twn", clicks, 10, 0.1, 1.0) for s, d in units for i in range(n)]
    return spark.createDataFrame(rows, DAILY)


def hourly(spark, days, hours, clicks=1):
    rows = [("s", d, h, f"q{h}", "/p", "M", "twn", clicks, 10, 0.1, 1.0) for d in days for h in hours]
    return spark.createDataFrame(rows, HOURLY)


def sizes(df):
    return df.groupBy("date").agg(F.count("*").alias("n"))


def facts(spark, root, kind="daily"):
    return sorted(map(tuple, Store.at(spark, root).table(kind).collect()))


def test_put_if_absent_lets_one_writer_through(spark, tmp_path):
    files, path, got = Files(spark, str(tmp_path)), f"{tmp_path}/log/000000000007.json", []
    threads = [threading.Thread(target=lambda i=i: got.append((files.put_if_absent(path, f'{{"i": {i}}}'), i))) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    (winner,) = [i for ok, i in got if ok]
    assert json.loads(files.read(path)) == {"i": winner}
    assert os.listdir(tmp_path / "log") == ["000000000007.json"]


def test_two_writers_that_planned_from_the_same_state_store_a_day_once(spark, tmp_path):
    root = str(tmp_path)
    log = CommitLog(spark, root, "daily")
    a = daily(spark, [("s", "2024-01-01"), ("s", "2024-01-02")], clicks=1)
    b = daily(spark, [("s", "2024-01-02"), ("s", "2024-01-03")], clicks=7, n=4)
    pa, pb = (write_batch(log, x, sizes(x)) for x in (a, b))
    assert publish(log, pb) == 2 and publish(log, pa) == 1
    assert facts(spark, root) == sorted(map(tuple, a.where("date = '2024-01-01'").unionByName(b).collect()))
    units = {(r.date, r.n_rows) for r in Store.at(spark, root).units("daily").collect()}
    assert units == {("2024-01-01", 3), ("2024-01-02", 4), ("2024-01-03", 4)}
    assert publish(log, write_batch(log, a, sizes(a))) == 0  # nothing is left to store: no version
    assert log.snapshot().version == 1
    compact(spark, root, "daily")
    assert log.snapshot().n_dead == 0 and len(facts(spark, root)) == 11


def test_writer_that_loses_the_race_looks_again(spark, tmp_path, monkeypatch):
    # Between a writer's look at the log and its put another one commits.
    root = str(tmp_path)
    log = CommitLog(spark, root, "daily")
    late, put = daily(spark, [("s", "2024-01-01")], clicks=9), CommitLog.publish
    tried = []

    def slow(self, seen, *a, **k):
        if not tried:
            tried.append(1)
            write_daily(daily(spark, [("s", "2024-01-01"), ("t", "2024-01-01")]), root)
        return put(self, seen, *a, **k)

    monkeypatch.setattr(CommitLog, "publish", slow)
    parts = write_batch(log, late, sizes(late))
    assert publish(log, parts) == 0
    assert {(r.site_url, r.clicks) for r in Store.at(spark, root).daily().collect()} == {("s", 1), ("t", 1)}


def test_writers_in_threads(spark, tmp_path):
    root, got = str(tmp_path), []
    frames = [daily(spark, [("s", f"2024-01-0{d}") for d in range(1, 4 + k)], clicks=k + 1) for k in range(3)]
    threads = [threading.Thread(target=lambda f=f: got.append(write_daily(f, root))) for f in frames]
    [t.start() for t in threads]
    [t.join() for t in threads]
    days = Store.at(spark, root).daily().groupBy("date").agg(F.count("*").alias("n"), F.countDistinct("clicks").alias("k")).collect()
    assert sorted((r.date, r.n, r.k) for r in days) == [(f"2024-01-0{d}", 3, 1) for d in range(1, 6)]
    assert sum(got) == 5


def test_hourly_rules_hold_at_the_commit(spark, tmp_path):
    root = str(tmp_path)
    log = CommitLog(spark, root, "hourly")
    noon, whole, late = (hourly(spark, ["2024-01-01"], h, c) for h, c in ((range(13), 1), (range(24), 2), (range(24), 3)))
    parts = [write_batch(log, x, sizes(x)) for x in (noon, whole, late)]
    assert [publish(log, p) for p in parts] == [1, 1, 0]
    assert facts(spark, root, "hourly") == sorted(map(tuple, whole.collect()))


def test_a_reader_keeps_its_snapshot(spark, tmp_path):
    root = str(tmp_path)
    write_daily(daily(spark, [("s", "2024-01-01")]), root)
    store = Store.at(spark, root)
    assert store.daily().count() == 3
    write_daily(daily(spark, [("s", "2024-01-02")]), root)
    compact(spark, root, "daily")
    assert store.daily().count() == 3 and Store.at(spark, root).daily().count() == 6


def test_checkpoints_bound_what_a_reader_puts_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fact, "CHECKPOINT_EVERY", 3)
    root = str(tmp_path)
    for d in range(1, 8):
        write_daily(daily(spark, [("s", f"2024-01-0{d}")]), root)
        assert len(CommitLog(spark, root, "daily").snapshot().manifests) <= 3
    assert Store.at(spark, root).units("daily").count() == 7 and Store.at(spark, root).daily().count() == 21


def test_compaction_merges_many_one_day_batches(spark, tmp_path):
    root = str(tmp_path)
    log = CommitLog(spark, root, "daily")
    for d in range(1, 13):
        write_daily(daily(spark, [("s", f"2024-01-{d:02d}"), ("t", f"2024-01-{d:02d}")]), root)
    before = facts(spark, root)
    assert len(Store.at(spark, root).daily().inputFiles()) == 12
    assert compact(spark, root, "daily", rows_per_file=30) == 12
    store = Store.at(spark, root)
    assert facts(spark, root) == before and len(store.daily().inputFiles()) == 3  # 72 rows
    assert len(store.daily(since="2024-01-11").inputFiles()) == 1  # files hold ranges of dates
    assert len(log.snapshot().manifests) == 1
    assert store.units("daily").count() == 24
    assert compact(spark, root, "daily", rows_per_file=30) in (0, 1, 2)
    assert vacuum(spark, root, "daily") == 0  # too young to go
    assert vacuum(spark, root, "daily", older_than_hours=-1) > 12
    assert facts(spark, root) == before and len(os.listdir(f"{root}/daily/_log")) == 1 + (log.snapshot().version - log.snapshot().checkpoint)


def test_compaction_drops_replaced_hours_also_those_replaced_meanwhile(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    log = CommitLog(spark, root, "hourly")
    write_hourly(hourly(spark, ["2024-01-01", "2024-01-02"], range(10), 1), root)
    write_hourly(hourly(spark, ["2024-01-01"], range(12), 2), root)
    put, tried = CommitLog.publish, []

    def slow(self, seen, manifest, n_dead, checkpoint=False):
        if checkpoint and not tried:
            tried.append(1)
            write_hourly(hourly(spark, ["2024-01-02"], range(24), 3), root)
        return put(self, seen, manifest, n_dead, checkpoint)

    monkeypatch.setattr(CommitLog, "publish", slow)
    assert compact(spark, root, "hourly") == 2 and tried
    want = hourly(spark, ["2024-01-01"], range(12), 2).unionByName(hourly(spark, ["2024-01-02"], range(24), 3))
    assert facts(spark, root, "hourly") == sorted(map(tuple, want.collect()))
    compact(spark, root, "hourly")
    assert log.snapshot().n_dead == 0 and facts(spark, root, "hourly") == sorted(map(tuple, want.collect()))


def test_large_and_thin_days_share_the_file_rule(spark, tmp_path):
    df = daily(spark, [("s", "2024-01-01")], n=450).unionByName(daily(spark, [("s", f"2024-02-{d:02d}") for d in range(1, 29)], n=2))
    log = CommitLog(spark, str(tmp_path), "daily")
    publish(log, write_batch(log, df, sizes(df), rows_per_file=100))
    files = log.snapshot().parts().groupBy("file").agg(F.sum("n_rows").alias("n"), F.countDistinct("date").alias("days")).collect()
    assert len(files) == 6 and max(r.n for r in files) < 150 and max(r.days for r in files) > 20
    assert facts(spark, str(tmp_path)) == sorted(map(tuple, df.collect()))


def test_files_of_other_sites_and_dates_are_not_opened(spark, tmp_path):
    root = str(tmp_path)
    write_daily(daily(spark, [("s", "2024-01-01")]), root)
    write_daily(daily(spark, [("t", "2024-01-02")]), root)
    store = Store.at(spark, root)
    assert len(store.daily("s").inputFiles()) == 1 and store.daily("s").count() == 3
    assert len(store.daily(since="2024-01-02").inputFiles()) == 1 and store.daily(until="2024-01-01").count() == 3
    assert store.daily("s", since="2024-01-02").count() == 0


# -- pages by reference -----------------------------------------------------------

def test_no_page_is_shuffled_before_the_write(spark, tmp_path):
    f = str(tmp_path / "landing")
    land(f, "s", "2024-01-01", "f", 0, [drow(i) for i in range(3)])
    land(f, "s", "2024-01-01", "f", 3, [drow(7)])
    pages = stored(sized(read_landing(spark, f)), "pages")
    refs = page_refs(pages)
    chosen = spark.createDataFrame([("s", "2024-01-01", "f")], "site_url string, date string, fetch_id string")
    got = take_pages(pages, refs, chosen)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert flatten_daily(got).count() == 4
    reading = refs._jdf.queryExecution().executedPlan().toString()
    assert "rows" not in reading.split("ReadSchema")[1]


def test_ties_of_copies_are_decided_by_content(spark, tmp_path):
    one, other = [drow(1), drow(2)], [drow(3), drow(4)]
    results = []
    for k, order in enumerate(((one, other), (other, one), (one, other, one, other))):
        f = str(tmp_path / f"l{k}")
        for rows in order:
            land(f, "s", "2024-01-01", "f", 0, rows)
        raw = read_landing(spark, f)
        assert [r.n_rows for r in fetch_status(raw, 3).collect()] == [2]
        results.append(sorted(r.query for r in flatten_daily(assemble_pages(raw.repartition(3), 3)).collect()))
    assert results[0] == results[1] == results[2] and len(results[0]) == 2


def _sizes_of(folder):
    return {d: sum(os.path.getsize(os.path.join(r, x)) for r, _, fs in os.walk(os.path.join(folder, d)) for x in fs) for d in sorted(os.listdir(folder))}


def test_micro_batches_append_their_own_pages_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "FOLD_EVERY", 3)
    landing, root = tmp_path / "landing", str(tmp_path / "store")
    seen = None
    for e in range(7):
        f = str(landing / str(e))
        land(f, "s", "2024-01-01", "open", 3 * e if e else 3, [drow(i) for i in range(3)])  # its first page never comes
        land(f, "s", f"2024-02-0{e + 1}", f"f{e}", 0, [drow(1)])
        process_pages(read_landing(spark, f), root, "daily", 3, f"{e:03d}")
        pages = _sizes_of(f"{root}/_pages/daily/pages")
        if seen:
            assert all(pages[k] == seen[k] for k in pages if k in seen)  # nothing is written anew
        seen = pages
        assert len(os.listdir(f"{root}/_pages/daily/refs")) <= 4
    assert Store.at(spark, root).daily().count() == 7
    assert [(r.fetch_id, r.n_pages, r.problem) for r in open_fetches(spark, root, "daily", 3).collect()] == [("open", 6, "first page missing")]
    land(str(landing / "last"), "s", "2024-01-01", "open", 0, [drow(i) for i in range(3)])
    land(str(landing / "last"), "s", "2024-01-01", "open", 21, [])
    process_pages(read_landing(spark, str(landing / "last")), root, "daily", 3, "007")
    assert Store.at(spark, root).daily().where("date = '2024-01-01'").count() == 21
    assert open_fetches(spark, root, "daily", 3).count() == 0


def test_a_replayed_micro_batch_changes_nothing(spark, tmp_path):
    f, root = str(tmp_path / "landing"), str(tmp_path / "store")
    land(f, "s", "2024-01-01", "f", 0, [drow(1)])
    land(f, "s", "2024-01-02", "g", 3, [drow(1)])
    for _ in range(2):
        process_pages(read_landing(spark, f), root, "daily", 3, "000")
    assert Store.at(spark, root).daily().count() == 1 and open_fetches(spark, root, "daily", 3).count() == 1


def test_dead_fetches_expire_and_are_listed(spark, tmp_path):
    landing, root, ckpt = str(tmp_path / "landing"), str(tmp_path / "store"), str(tmp_path / "ckpt")
    land(landing, "s", "2024-01-01", "dead", 3, [drow(1)], fetched_at="2024-01-02T00:00:00Z")
    land(landing, "s", "2024-01-03", "slow", 0, [drow(i) for i in range(3)], fetched_at="2024-01-08T00:00:00Z")
    land(landing, "s", "2024-01-04", "bad", 0, [{**drow(1), "clicks": None}], fetched_at="2024-01-01T00:00:00Z")
    stream_daily(spark, landing, root, ckpt, page_limit=3, expire_days=5).awaitTermination(300)
    assert {(r.fetch_id, r.problem) for r in dropped_fetches(spark, root, "daily").collect()} == {("dead", "first page missing"), ("bad", "malformed page")}
    assert [r.fetch_id for r in open_fetches(spark, root, "daily", 3).collect()] == ["slow"]
    land(landing, "s", "2024-01-03", "slow", 3, [drow(1)], fetched_at="2024-01-08T00:00:00Z")
    land(landing, "s", "2024-01-01", "again", 0, [drow(1)], fetched_at="2024-01-09T00:00:00Z")
    stream_daily(spark, landing, root, ckpt, page_limit=3, expire_days=5).awaitTermination(300)
    assert Store.at(spark, root).daily().count() == 5 and open_fetches(spark, root, "daily", 3).count() == 0


def test_provisional_days_are_replaced_until_they_settle(spark, tmp_path):
    from rankspark.plans.ingest import plan_daily

    landing, root, ckpt = str(tmp_path / "landing"), str(tmp_path / "store"), str(tmp_path / "ckpt")
    for d in range(1, 5):
        land(landing, "s", f"2024-01-0{d}", "first", 0, [drow(1)], fetched_at="2024-01-05T00:00:00Z")
    stream_daily(spark, landing, root, ckpt).awaitTermination(300)
    plan = plan_daily(Store.at(spark, root).units("daily"), ["s"], "2024-01-05", history_days=4, settle_days=2)
    assert [r.date for r in plan.collect()] == ["2024-01-03", "2024-01-04"]
    assert plan_daily(Store.at(spark, root).units("daily"), ["s"], "2024-01-05", history_days=4).count() == 0
    for d in range(1, 5):
        land(landing, "s", f"2024-01-0{d}", "again", 0, [drow(1, clicks=5)], fetched_at="2024-01-06T00:00:00Z")
    stream_daily(spark, landing, root, ckpt, open_since="2024-01-03").awaitTermination(300)
    clicks = {r.date[-1]: r.clicks for r in Store.at(spark, root).daily().collect()}
    assert clicks == {"1": 1, "2": 1, "3": 5, "4": 5}
    write_daily(daily(spark, [("s", "2024-01-04")], clicks=9), root, open_since="2024-01-04")
    assert Store.at(spark, root).daily().where("clicks = 9").count() == 3 and Store.at(spark, root).daily().count() == 6


def test_chosen_pages_are_sent_as_masks(spark, tmp_path, monkeypatch):
    from rankspark.sources import landing

    rows = [("s", f"2024-01-{1 + i % 28:02d}", f"f{i % 3}", i, None, []) for i in range(400)]
    pages = stored(sized(spark.createDataFrame(rows, RAW_PAGE).coalesce(1)), "pages")
    refs = page_refs(pages)
    chosen = refs.where("fetch_id != 'f1'").select("site_url", "date", "fetch_id").distinct()
    want = sorted(r[3] for r in rows if r[2] != "f1")
    monkeypatch.setattr(landing, "MASKS_BROADCAST", 7)  # 267 references in one file lie in 7 masks
    got = take_pages(pages, refs, chosen)
    assert sorted(r.start_row for r in got.collect()) == want
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString() and not got.isEmpty()
    monkeypatch.setattr(landing, "MASKS_BROADCAST", 0)
    assert sorted(r.start_row for r in take_pages(pages, refs, chosen).collect()) == want
