from datetime import date, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inspectra.operators import rolling

SCHEMA = "e string, d date, n long, s double, e2 string, entity string, day string"
D0 = date(2024, 1, 1)


def _totals(spark, events, periods=(7, 30), **kw):
    df = spark.createDataFrame([(e, None if d is None else D0 + timedelta(d), n, s, "x", "clash", "clash") for e, d, n, s in events], SCHEMA)
    daily = rolling.daily_totals(df, "e", "d", {"n": F.col("n")}, {"s": F.col("s")})
    return rolling.trailing_totals(daily, list(periods), measures=["n", "s_sum", "s_n"], **kw)


def _brute(events, periods=(7, 30)):
    out = {}
    for who in {e for e, d, _, _ in events if e is not None and d is not None}:
        own = [(d, n, s) for e, d, n, s in events if e == who and d is not None]
        for day in range(min(d for d, _, _ in own), max(d for d, _, _ in own) + 1):
            out[who, D0 + timedelta(day)] = tuple(x for p in periods for x in (
                sum(n or 0 for d, n, _ in own if 0 <= day - d < p), sum(s or 0 for d, _, s in own if 0 <= day - d < p), sum(s is not None for d, _, s in own if 0 <= day - d < p)))
    return out


def test_idle_days_bounds_and_nulls(spark):
    events = [("a", 0, 2, 1.0), ("a", 0, None, None), ("a", 40, 1, 5.0), ("b", 3, 7, None), (None, 1, 9, 9.0), ("c", None, 1, 1.0)]
    got = {(r[0], r[1]): tuple(r)[2:] for r in _totals(spark, events).collect()}
    assert got == _brute(events)
    assert got["a", D0 + timedelta(6)][0] == 2 and got["a", D0 + timedelta(7)][0] == 0 and got["a", D0 + timedelta(29)][3] == 2 and got["a", D0 + timedelta(30)][3] == 0


def test_without_idle_days_nothing_active_is_lost(spark):
    events = [("a", 0, 2, 1.0), ("a", 100, 1, 1.0), ("a", 129, 4, 2.0)]
    full = {(r[0], r[1]): tuple(r)[2:] for r in _totals(spark, events).collect()}
    active = {(r[0], r[1]): tuple(r)[2:] for r in _totals(spark, events, idle_days=False).collect()}
    assert active == {k: v for k, v in full.items() if v[5] > 0}


def test_empty(spark):
    assert _totals(spark, []).count() == 0


def test_latest_version_keeps_rows_without_key(spark, rows):
    df = spark.createDataFrame([("i", 1, 1, "a"), ("i", None, 9, "b"), ("i", 1, 2, "c"), (None, 1, 1, "d"), (None, 1, 1, "d")], "k string, t int, no int, v string")
    assert rows(rolling.latest_version(df, "k", ["t", "no"], ["t", "no", "v"]).select("k", "v")) == [("i", "c"), (None, "d"), (None, "d")]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 90), st.one_of(st.none(), st.integers(0, 5)), st.one_of(st.none(), st.sampled_from([0.0, 12.5, 20.0]))), max_size=15))
def test_against_brute_force(spark, events):
    assert {(r[0], r[1]): tuple(r)[2:] for r in _totals(spark, events).collect()} == _brute(events)
