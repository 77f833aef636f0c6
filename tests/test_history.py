import statistics
from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inspectra.operators import history as h

D0 = date(2024, 1, 1)
EVENTS = "e string, d date, s double, c double, id string"
events_strategy = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 12), st.one_of(st.none(), st.integers(0, 4).map(float)), st.one_of(st.none(), st.integers(0, 3).map(float))), min_size=1, max_size=14)


def _days(spark, events):
    df = spark.createDataFrame([(e, D0 + timedelta(d), s, c, str(i)) for i, (e, d, s, c) in enumerate(events)], EVENTS)
    return h.collapse_days(df, "e", "d", additive={"c": F.col("c")}, single={"s": F.col("s")})


def _naive(events, who, before):
    own = {}
    for e, d, s, c in events:
        if e == who and d < before:
            own.setdefault(d, []).append((s, c))
    days = sorted(own)
    single = {d: own[d][0][0] for d in days if all(s is not None for s, _ in own[d]) and len({s for s, _ in own[d]}) == 1}
    x, y = list(single), list(single.values())
    trend = None
    if len(x) >= 3:
        mx, my = sum(x) / len(x), sum(y) / len(y)
        trend = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x) * 365
    added = [sum(c for _, c in own[d]) for d in days if all(c is not None for _, c in own[d])]
    return {"history_depth": sum(map(len, own.values())), "prior_days": len(days), "days_since_previous": before - days[-1] if days else None, "s_mean": sum(y) / len(y) if y else None, "s_variance": statistics.variance(y) if len(y) > 1 else None,
            "s_trend": trend, "s_previous": single.get(days[-1]) if days else None, "c_sum": sum(added) if added else None, "s_max": max(y) if y else None}


def _close(got, want):
    return all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in want.items())


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events_strategy)
def test_features_are_those_of_strictly_earlier_days(spark, events):
    days = _days(spark, events)
    for r in h.history_features(days, ["s", "c"]).collect():
        assert _close(r.asDict(), _naive(events, r["entity"], (r["day"] - D0).days))


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events_strategy)
def test_state_as_of_a_day_is_the_same(spark, events):
    days = _days(spark, events)
    got = h.state_as_of(days, days, ["s", "c"], str(D0 + timedelta(7))).collect()
    assert len(got) == len({e for e, *_ in events})
    assert all(_close(r.asDict(), _naive(events, r["entity"], 7)) for r in got)


def test_later_events_change_nothing_before(spark, rows):
    early = [("a", 0, 3.0, 1.0), ("a", 2, 4.0, None), ("a", 5, 1.0, 1.0)]
    cut = lambda ev: rows(h.history_features(_days(spark, ev), ["s", "c"]).where(F.col("day") <= str(D0 + timedelta(5))))
    assert cut(early) == cut([*early, ("a", 5, 9.0, 9.0), ("a", 9, 0.0, 0.0)])


def test_leading_code(spark):
    v = spark.createDataFrame([("a", D0, "i1", "X", 1), ("a", D0, "i1", "Y", 1), ("a", D0 + timedelta(1), "i2", "Y", None), ("a", D0 + timedelta(9), "i3", "Z", 9), ("a", D0, "i0", "", 5)], "entity string, day date, insp string, code string, n int")
    days = spark.createDataFrame([("a", D0), ("a", D0 + timedelta(1)), ("a", D0 + timedelta(2))], "entity string, day date")
    got = {r["day"]: tuple(r)[2:] for r in h.code_history(days, v, entity="entity", day="day", inspection="insp", code="code", count="n").collect()}
    assert got == {D0: (None,) * 6, D0 + timedelta(1): (2, 1, 2, "X", 1, 1), D0 + timedelta(2): (2, 2, 2, "Y", 1, 2)}


def test_model_columns():
    h.check_model_columns(["score_mean"], ["score_mean"])
    for columns in (["other"], ["score_target"]):
        with pytest.raises(ValueError):
            h.check_model_columns(columns, ["score_mean", "score_target"])
