"""Registered period comparisons CMP-1 (week, month, custom with overlap, empty period)."""

from rankspark.operators.compare import compare_periods
from rankspark.plans.periods import Periods, period_bounds
from rankspark.queries.params import AS_OF, SITE, sql_str
from rankspark.registry import register
from rankspark.sources.store import Store


def _oracle(p: Periods) -> str:
    """One pass with a FILTER per period; the changes are derived from its single row."""
    measures = {"clicks": "CAST(SUM(clicks){f} AS BIGINT)", "impressions": "CAST(SUM(impressions){f} AS BIGINT)",
                "position": "AVG(position){f}", "queries": "COUNT(DISTINCT query){f}", "pages": "COUNT(DISTINCT page){f}"}
    bounds = {1: (p.period1_start, p.period1_end), 2: (p.period2_start, p.period2_end)}
    sums, out = [], []
    for k, (start, end) in bounds.items():
        inside = f" FILTER (date BETWEEN '{start}' AND '{end}')"
        sums += [f"{sql.format(f=inside)} AS period{k}_{name}" for name, sql in measures.items()]
        out += [f"'{start}' AS period{k}_start", f"'{end}' AS period{k}_end"]
    for name in ("clicks", "impressions", "position"):
        out.append(f"period2_{name} - period1_{name} AS {name}_change")
    for name in ("clicks", "impressions"):
        out.append(f"CASE WHEN period1_{name} > 0 THEN CAST(period2_{name} - period1_{name} AS DOUBLE) "
                   f"/ CAST(period1_{name} AS DOUBLE) * 100 ELSE 0.0 END AS {name}_change_pct")
    return f"SELECT *, {', '.join(out)} FROM (SELECT {', '.join(sums)} FROM daily WHERE site_url = {sql_str(SITE)}) t"


CUSTOM = {"period1": {"start": "1998-01-01", "end": "1998-03-31"},
          "period2": {"start": "1998-03-01", "end": "1998-06-30"}}
EMPTY = {"period1": {"start": "2005-01-01", "end": "2005-01-31"},
         "period2": {"start": "1998-06-01", "end": "1998-06-17"}}


def _make(name, period_type, custom=None):
    bounds = period_bounds(AS_OF, period_type, custom)

    @register(name, "CMP-1", _oracle(bounds))
    def run(spark, sf_dir):
        perf = Store.fixtures(spark, sf_dir).daily(SITE)
        return compare_periods(perf, AS_OF, period_type, custom)

    return run


_make("compare_week", "week")
_make("compare_month", "month")
_make("compare_custom", "custom", CUSTOM)
_make("compare_empty_period", "custom", EMPTY)
