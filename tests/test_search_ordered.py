"""Substring search through the dictionary equals the scan; sorted results as files in order."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from rankspark.api import Reports
from rankspark.operators import reports as R
from rankspark.schema import DAILY
from rankspark.sinks.fact import compact, vacuum, write_daily
from rankspark.sinks.ordered import bounds, read_ordered, write_ordered
from rankspark.sources.dictionary import MODES, index, matching, pieces
from rankspark.sources.store import Store

QUERIES = ["blue bolt", "Blue BOLT", "bolt", "bo", "", None, "100% wool_x", "a\\b c", "straße ÉTÉ", "İstanbul kebap", "瑪卡 桑拿功效", "red widget", "red  widget set"]


@pytest.fixture(scope="module")
def facts(spark):
    r = random.Random(3)
    words = [q for q in QUERIES if q] + ["".join(r.choices("abcdo lt", k=r.randint(1, 12))) for _ in range(150)]
    rows = [("s" if i % 3 else "t", f"2024-01-{1 + i % 20:02d}", q, f"/p{i % 5}", "M", "twn", i, 10, 0.1, 1.0) for i, q in enumerate((words + QUERIES) * 3)]
    return spark.createDataFrame(rows, DAILY)


PATTERNS = ["%bolt%", "bolt%", "%bolt", "bl_e%", "%", "", "%bo%", "%100%% wool_x%", "%a\\b%", "%straße%", "%été%", "%İstanbul%", "%i̇stan%", "%桑拿功%", "%red  widget%", "%zzzz%", "_____", "%olt a%lt%"]


@pytest.mark.parametrize("mode", list(MODES))
def test_search_through_the_dictionary_equals_the_scan(spark, facts, tmp_path_factory, mode):
    root = str(tmp_path_factory.mktemp("dictionary"))
    write_daily(facts.where("date <= '2024-01-08'"), root)
    write_daily(facts.where("date <= '2024-01-14'"), root)
    assert index(spark, root, "daily") == 2 and index(spark, root, "daily") == 0
    write_daily(facts, root)  # a batch without an index
    store = Store.at(spark, root)
    patterns = [p.strip("%") for p in PATTERNS] if mode == "contains" else PATTERNS
    for p in patterns:
        want = facts.where(MODES[mode]("query", p)).where("site_url = 's' AND date >= '2024-01-05'")
        got = matching(store, p, mode, site="s", since="2024-01-05")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (mode, p)


def test_facts_are_read_for_hits_only(spark, facts, tmp_path):
    root = str(tmp_path)
    for d in range(1, 5):
        write_daily(facts.where(f"date = '2024-01-0{d}'").withColumn("query", F.lit(f"only on day {d}")), root)
    index(spark, root, "daily")
    store = Store.at(spark, root)
    found = matching(store, "%on day 3%")
    data = [f for f in found.inputFiles() if "/data/" in f]
    assert len(data) == 1 and found.count() > 0
    assert not [f for f in matching(store, "%nothing%").inputFiles() if "/data/" in f]
    assert sorted(map(tuple, R.search_keywords(found, "%on day 3%", "2024-01-20", days=30).collect())) == \
        sorted(map(tuple, R.search_keywords(store.daily(), "%on day 3%", "2024-01-20", days=30).collect()))
    compact(spark, root, "daily")
    by_report = Reports(store, dt.date(2024, 1, 20)).search_keywords("s", "%on day 3%", days=30)
    assert sorted(map(tuple, by_report.collect())) == sorted(map(tuple, R.search_keywords(store.daily("s"), "%on day 3%", "2024-01-20", days=30).collect()))
    n = found.count()
    assert index(spark, root, "daily") == 1 and matching(Store.at(spark, root), "%on day 3%").count() == n
    vacuum(spark, root, "daily", older_than_hours=-1)
    assert [len(os.listdir(f"{root}/daily/{part}")) for part in ("data", "_rollups", "_queries", "_grams")] == [1] * 4
    assert matching(Store.at(spark, root), "%on day 3%").count() == n


def test_pieces():
    assert pieces("%blue_bolt%ab%xyz", "like") == ["blue", "bolt", "xyz"] and pieces("a%b", "contains") == ["a%b"] and pieces("%ab%", "ilike") == []


def test_files_are_in_order_at_a_skewed_key(spark, tmp_path):
    rows = spark.range(9000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id % 1000 END AS k", "CASE WHEN id % 6 = 0 THEN 'same' ELSE concat('v', id % 11) END AS v", "id % 2 = 0 AS _file")
    path, order = str(tmp_path / "o"), [F.desc_nulls_last("k"), F.asc("v")]
    n_files = write_ordered(rows, path, order, rows_per_file=500)
    said = bounds(spark, path).orderBy("file").collect()
    assert n_files == 18 and len(said) >= 15 and max(r.n_rows for r in said) < 1500
    assert [r.first_row for r in said] == [sum(x.n_rows for x in said[:i]) for i in range(len(said))]
    text = [tuple(r) for f in said for r in spark.read.parquet(f"{path}/{f.file}").collect()]  # the files one after the other
    key = lambda r: (r[0] is None, -(r[0] or 0), r[1])
    assert len(text) == 9000 and [key(r) for r in text] == sorted(key(r) for r in text)
    assert sorted(text, key=str) == sorted(map(tuple, rows.collect()), key=str)
    placed = read_ordered(spark, path, rows.schema).orderBy("row_no").collect()
    assert [tuple(r)[:3] for r in placed] == text and [r.row_no for r in placed] == list(range(9000))
    page = read_ordered(spark, path, rows.schema, 4321, 20)
    assert len(page.inputFiles()) <= 2 and [tuple(r)[:3] for r in page.orderBy("row_no").collect()] == text[4321:4341]
    assert read_ordered(spark, path, rows.schema, 9000, 5).count() == 0


def test_ordered_write_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "a int, b string")
    write_ordered(df, str(tmp_path / "o"), [F.asc("a")])
    assert read_ordered(spark, str(tmp_path / "o"), df.schema).count() == 0
