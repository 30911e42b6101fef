"""Property tests: LIKE semantics against DuckDB, period-bound invariants."""

import datetime as dt
import random

import duckdb
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankspark.functions import predicates as P
from rankspark.plans.periods import period_bounds

ALPHABET = "ab%_\\A"


def _pairs(seed: int, n: int = 400):
    rnd = random.Random(seed)

    def word(k):
        return "".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(0, k)))

    return [(word(7), word(6)) for _ in range(n)]


def test_like_matches_duckdb_without_escape(spark):
    pairs = _pairs(11)
    # Spark side: one job; the escape character is one that no pattern contains.
    df = spark.createDataFrame(pairs, "s string, p string")
    esc = P._escape_for("".join(p for _, p in pairs))
    got = df.select(
        F.like("s", "p", F.lit(esc)).alias("like"), F.ilike("s", "p", F.lit(esc)).alias("ilike")
    ).collect()
    con = duckdb.connect()
    frame = pd.DataFrame(pairs, columns=["s", "p"])
    con.register("t", frame)
    want = con.execute("SELECT s LIKE p, s ILIKE p FROM t").fetchall()
    assert [(r.like, r.ilike) for r in got] == [tuple(w) for w in want]


def test_like_helper_matches_duckdb_on_literal_patterns(spark):
    pairs = _pairs(23, 60)
    df = spark.createDataFrame([(s,) for s, _ in pairs], "s string")
    con = duckdb.connect()
    for _, p in pairs[:15]:
        got = sorted(r.s for r in df.where(P.like("s", p)).collect())
        want = sorted(r[0] for r in con.execute("SELECT s FROM (SELECT unnest(?) AS s) WHERE s LIKE ?",
                                                [[s for s, _ in pairs], p]).fetchall())
        assert got == want, p


@settings(max_examples=300, deadline=None)
@given(st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2100, 12, 31)))
def test_week_and_month_bounds_invariants(d):
    w = period_bounds(d, "week")
    p1s, p1e, p2s, p2e = (dt.date.fromisoformat(x) for x in
                          (w.period1_start, w.period1_end, w.period2_start, w.period2_end))
    assert p1s.weekday() == 0 and p2s.weekday() == 0 and (p1e - p1s).days == 6
    assert p2s - p1e == dt.timedelta(days=1) and p2e == d and p2s <= d < p2s + dt.timedelta(days=7)
    m = period_bounds(d, "month")
    m1s, m1e, m2s, m2e = (dt.date.fromisoformat(x) for x in
                          (m.period1_start, m.period1_end, m.period2_start, m.period2_end))
    assert m1s.day == 1 and m2s.day == 1 and m2s - m1e == dt.timedelta(days=1)
    assert m1e.month != (m1e + dt.timedelta(days=1)).month and m2e == d and m2s.month == d.month
