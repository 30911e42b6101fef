"""Plan checks on a real partitioned store: pruning, one scan, top-k without a sort."""

import pytest

from rankspark.operators import compare as C
from rankspark.operators import keywords as K
from rankspark.operators import reports as R
from rankspark.schema import DAILY
from rankspark.sinks.fact import write_daily
from rankspark.sources.store import Store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    rows = []
    for site in ("sc-domain:a.example", "https://b.example/"):
        for d in range(1, 29):
            for q in range(5):
                rows.append((site, f"2024-02-{d:02d}", f"q{q}", f"/p{q % 3}", "MOBILE", "twn",
                             q + d, 10 * (q + d), 0.1, 1.0 + q / 4))
    df = spark.createDataFrame(rows, DAILY)
    write_daily(df, root)
    return Store.at(spark, root)


def _plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(plan: str) -> int:
    return plan.count("FileScan parquet")


def test_site_and_date_filters_prune_partitions(store):
    df = R.best_pages(store.daily("sc-domain:a.example"), "2024-02-20", days=5)
    plan = _plan(df)
    pushed = plan.split("PushedFilters")[1]
    assert "GreaterThanOrEqual(date," in pushed and "EqualTo(site_url" in pushed
    assert "TakeOrderedAndProject" in plan
    assert " Sort " not in plan and "+- Sort" not in plan
    assert df.count() == 3


def test_compare_periods_scans_once(store):
    df = C.compare_periods(store.daily("https://b.example/"), "2024-02-21", "week")
    plan = _plan(df)
    assert _scans(plan) == 1
    assert "GreaterThanOrEqual(date," in plan.split("PushedFilters")[1]
    r = df.first()
    assert r.period1_clicks is not None and r.period2_clicks is not None


def test_traffic_loss_scans_once(store):
    df = K.traffic_loss(store.daily("sc-domain:a.example"), ("2024-02-01", "2024-02-08"), ("2024-02-20", "2024-02-27"))
    assert _scans(_plan(df)) == 1


def test_keyword_gap_does_not_ship_fact_rows(store):
    df = K.keyword_gap(store.daily("sc-domain:a.example"), ["q1", "zz", "zz"])
    plan = _plan(df)
    # The fact side is reduced by the semi-join and a distinct before any exchange.
    assert "LeftSemi" in plan and "LeftAnti" in plan
    assert sorted(r.query for r in df.collect()) == ["zz", "zz"]


def test_projection_is_pruned(store):
    df = R.page_queries(store.daily("sc-domain:a.example"), "/p1", "2024-02-20", days=30)
    plan = _plan(df)
    read_schema = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "country" not in read_schema and "ctr" not in read_schema and "device" not in read_schema


def test_year_over_year_reads_the_two_periods_only(store):
    custom = {"period1": {"start": "2024-02-01", "end": "2024-02-02"}, "period2": {"start": "2024-02-26", "end": "2024-02-28"}}
    df = C.compare_periods(store.daily("sc-domain:a.example"), "2024-02-28", "custom", custom)
    df.collect()
    pushed = _plan(df).split("PushedFilters")[1].split("ReadSchema")[0]
    assert "Or(And(" in pushed and "2024-02-02" in pushed and "2024-02-26" in pushed
    assert df.first().period1_clicks == sum(q + d for q in range(5) for d in (1, 2))


def test_planning_does_not_grow_with_units(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.range(4000).selectExpr(
        "concat('s', id div 20) site_url", "date_format(date_add(date'2024-01-01', cast(id % 20 as int)), 'yyyy-MM-dd') date", "'q' query", "'/p' page",
        "'M' device", "'x' country", "1L clicks", "2L impressions", "0.5D ctr", "1D position")
    write_daily(rows, root)
    store = Store.at(spark, root)
    assert store.units("daily").count() == 4000
    # Twenty thin days share one file; a site or date that no file holds opens none.
    assert len(store.daily().inputFiles()) == 1
    assert store.daily("nobody").inputFiles() == [] and store.daily(since="2024-01-21").inputFiles() == []
    plan = _plan(store.daily("s7").where("date = '2024-01-05'"))
    assert "EqualTo(date,2024-01-05)" in plan and "EqualTo(site_url,s7)" in plan
    assert store.daily("s7").where("date = '2024-01-05'").count() == 1
    assert all("/_manifests/" in f for f in store.units("daily").inputFiles())


# -- lists at the scan -------------------------------------------------------------

def _scan_rows(df) -> int:
    """Rows that came out of the file scans of a finished query: row groups that were skipped give none."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan]
    while stack:
        p = stack.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            stack.append(p.plan())
        else:
            if name == "FileSourceScanExec":
                rows += p.metrics().apply("numOutputRows").value()
            stack += [p.children().apply(i) for i in range(p.children().size())]
    return rows


@pytest.fixture(scope="module")
def grouped(spark, tmp_path_factory):
    """Facts in many small row groups: pages in order, queries that are not, Bloom filters as the writer sets them."""
    from rankspark.sinks.fact import BLOOM

    path = str(tmp_path_factory.mktemp("groups")) + "/t"
    rows = spark.range(200_000).selectExpr("concat('/p', lpad(id, 7, '0')) page", "concat('q', (id * 7919) % 200000) query", "id clicks")
    rows.coalesce(1).write.options(**BLOOM).option("parquet.block.size", "65536").option("parquet.page.row.count.limit", "2000").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("n", [1, 3, 10, 11, 500])
def test_lists_of_any_length_reach_the_scan(grouped, n):
    from rankspark.functions.predicates import filter_in

    pages = [f"/p{i:07d}" for i in range(50_000, 50_000 + n)]
    df = filter_in(grouped, "page", [*pages, None, pages[0]])
    pushed = _plan(df).split("PushedFilters")[1].split("ReadSchema")[0]
    assert pages[0] in pushed and pages[-1] in pushed
    assert sorted(r.page for r in df.collect()) == pages
    assert _scan_rows(df) < 60_000


def test_bloom_filters_skip_row_groups(grouped):
    from rankspark.functions.predicates import filter_in

    here, absent = filter_in(grouped, "query", ["q77", "q4711"]), filter_in(grouped, "query", ["q77x", "q1y"])
    assert here.count() == 2 and absent.count() == 0
    assert _scan_rows(absent) < _scan_rows(here) < 200_000


def test_list_ranges_are_exact_bounds(spark):
    from rankspark.functions.predicates import filter_in, list_ranges

    values = [f"v{i}" for i in range(95)]
    df = spark.createDataFrame([(v,) for v in values + [None, "", "v10a", "zz", "漢"]], "x string")
    for n in (1, 9, 10, 11, 95):
        cond, exact = list_ranges("x", values[:n])
        assert exact == (n <= 10)
        assert sorted(r.x for r in filter_in(df, "x", values[:n]).collect()) == sorted(values[:n])
    assert [r.x for r in filter_in(df, "x", ["漢", "a"]).collect()] == ["漢"]
