"""The source-compatible report entry points and the command line."""

import datetime as dt
import json
import os

import pytest

from rankspark.__main__ import main
from rankspark.api import Reports
from rankspark.schema import DAILY, HOURLY
from rankspark.sinks.fact import write_daily, write_hourly
from rankspark.sources.store import Store

SITE = "sc-domain:t.example"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("api-store"))
    rows = [(SITE, f"2024-02-{d:02d}", f"q{q}", f"/p{q % 2}", "MOBILE", "twn", q + d, 10 * (q + d), 0.1, 1.0 + q)
            for d in range(1, 15) for q in range(4)]
    write_daily(spark.createDataFrame(rows, DAILY), root)
    hours = [(SITE, "2024-02-14", h, "q0", "/p0", "MOBILE", "twn", 1, 2, 0.5, 1.0) for h in range(24)]
    write_hourly(spark.createDataFrame(hours, HOURLY), root)
    return root


def test_reports_entry_points(spark, root):
    r = Reports(Store.at(spark, root), dt.date(2024, 2, 14))
    assert r.best_pages(SITE, days=7, limit=1).count() == 1
    assert r.show_page_queries(SITE, "/p0").count() == 2
    assert r.show_keyword_pages(SITE, "q1").count() == 1
    assert r.search_keywords(SITE, "q%").count() == 4
    assert r.track_pages(SITE, ["/p1"], keywords=["q1"], days=3).count() == 4
    assert r.pages_queries(SITE, ["/p0", "/p1"]).count() == 4
    c = r.compare_periods(SITE, "week").first()
    assert c.period1_start == "2024-02-05" and c.period2_end == "2024-02-14"
    assert r.query(SITE, "SELECT hour, SUM(clicks) AS c FROM {site_hourly} GROUP BY hour").count() == 24


def test_cli_report_sql_plan_sites(spark, root, tmp_path):
    out = str(tmp_path / "best.json")
    assert main(["report", "--store", root, "--as-of", "2024-02-14", "--out", out,
                 "best_pages", f"site={SITE}", "days=7", "limit=2"]) == 0
    rows = [json.loads(line) for p in sorted(os.listdir(out)) if p.endswith(".json")
            for line in open(os.path.join(out, p))]
    assert len(rows) == 2 and {"page", "total_clicks", "ctr"} <= set(rows[0])
    out = str(tmp_path / "sql.csv")
    assert main(["sql", "--store", root, "--site", SITE, "--out", out,
                 "SELECT COUNT(*) AS n FROM {site}"]) == 0
    text = "".join(open(os.path.join(out, p)).read() for p in os.listdir(out) if p.endswith(".csv"))
    assert text.splitlines() == ["n", "56"]
    out = str(tmp_path / "plan")
    assert main(["plan", "--store", root, "--as-of", "2024-02-16", "--kind", "daily", "--out", out,
                 f"site={SITE}"]) == 0
    plan = spark.read.parquet(out)
    assert [r.date for r in plan.orderBy("date").collect()][-1] == "2024-02-15"
    assert main(["sites", "--store", root, "--rows", "5"]) == 0
