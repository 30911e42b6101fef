"""Every registered query equals its DuckDB oracle on the driver's sf0.01 tables."""

import pytest

from rankspark.registry import load_all
from tests.conftest import SF_ORACLE
from tools.oracle_check import compare

REG = load_all()


@pytest.mark.parametrize("name", sorted(REG))
def test_query_matches_oracle(spark, duck, name):
    info = compare(spark, duck, name, REG[name], SF_ORACLE)
    assert info["ok"] is not False, info


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 20
    assert df.columns == ["page", "total_clicks", "total_impressions", "avg_position", "ctr"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40


ROBUST = ["best_pages", "compare_custom", "keyword_gap", "page_traffic_loss", "kpi_change", "trend_7d",
          "hour_vs_last_week", "fresh_daily_totals", "ranking_summary", "plan_daily", "top_rows"]


def test_results_do_not_depend_on_parallelism_or_broadcasts(spark, duck):
    """Same answers with another shuffle width, no coalescing and no automatic broadcasts
    (every join that is not explicitly bounded falls back to a sort-merge join)."""
    keys = {"spark.sql.shuffle.partitions": "37",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        for name in ROBUST:
            info = compare(spark, duck, name, REG[name], SF_ORACLE)
            assert info["ok"] is True, info
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
