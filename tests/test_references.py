from datetime import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inspectra.functions.keys import plain_id
from inspectra.operators import references as r

KEYS = "k string, t timestamp"
day = lambda n: dt(2024, 1, n)


def _refs(spark, rows):
    return r.references(spark.createDataFrame(rows, "no long, k string, t timestamp, key string"), "child", "k", "no", "x", "t")


def _deltas(spark, live, retired):
    a = r.existence_deltas(spark.createDataFrame(live, KEYS), "x", F.col("k"), F.col("t"))
    return a.unionByName(r.existence_deltas(spark.createDataFrame(retired, "k string, a timestamp, z timestamp"), "x", F.col("k"), F.col("a"), F.col("z")))


def test_ids_are_compared_in_one_spelling(spark):
    ids = [" NYC: 0040000123", "nyc:40000123", "michelin:r:00ab", "", "  ", None, "nyc:0", "7", "007"]
    got = [x[0] for x in spark.createDataFrame([(i,) for i in ids], "k string").select(plain_id(F.col("k"))).collect()]
    assert got == ["nyc:40000123", "nyc:40000123", "michelin:r:00ab", None, None, None, "nyc:0", "7", "7"]


def test_reasons_and_bounds(spark, rows):
    deltas = _deltas(spark, [("x:1", day(5)), ("x:1", day(9)), ("X:01", day(7))], [("x:2", day(1), day(10)), ("x:2", day(1), day(10))])
    refs = _refs(spark, [(1, "x:1", day(5), ""), (2, "x:001", day(4), ""), (3, "x:2", day(9), ""), (4, "x:2", day(10), ""), (5, "x:3", day(1), ""), (6, " ", day(1), ""), (7, None, day(1), ""), (8, "x:2", None, ""), (9, "x:3", None, "")])
    got = {x["child_no"]: (x["reason"], x["period"]) for x in r.orphan_references(refs, deltas).collect()}
    assert got == {2: ("late", "2024-01"), 4: ("deleted", "2024-01"), 5: ("absent", "2024-01"), 8: ("deleted", None), 9: ("absent", None)}


def test_returned_key_is_deleted_in_between_only(spark):
    deltas = _deltas(spark, [("x:1", day(20))], [("x:1", day(1), day(10))])
    refs = _refs(spark, [(n, "x:1", day(n), "") for n in (1, 9, 10, 19, 20)])
    assert {x["child_no"]: x["reason"] for x in r.orphan_references(refs, deltas).collect()} == {10: "deleted", 19: "deleted"}


def test_hot_key_is_split_without_loss(spark, rows):
    deltas = _deltas(spark, [("x:1", day(5))], [])
    refs = _refs(spark, [(n, "x:1", day(1 + n % 9), "") for n in range(300)] + [(1000 + n, f"x:{n + 2}", day(3), "") for n in range(30)])
    plain = rows(r.orphan_references(refs, deltas))
    assert rows(r.orphan_references(refs, deltas, rows=20)) == plain and len(plain) > 100


def test_empty_tables(spark):
    deltas, refs = _deltas(spark, [], []), _refs(spark, [])
    assert r.orphan_references(refs, deltas).count() == 0
    assert r.orphan_references(_refs(spark, [(1, "x:1", day(1), "")]), deltas).count() == 1
    assert r.orphan_report(r.orphan_references(refs, deltas)).count() == 0


def test_state_is_a_sum_of_changes(spark, rows):
    e = spark.createDataFrame([("a", 1), ("b", 1), ("b", -1), ("c", -1)], "key string, delta int")
    f = spark.createDataFrame([("a",), ("b",), ("b",), ("d",)], "key string")
    whole = r.count_state(e, f)
    parts = r.apply_changes(r.apply_changes(r.count_state(e.where("delta > 0"), f.limit(0)), e.where("delta < 0"), f.limit(0)), e.limit(0), f)
    assert rows(whole) == rows(parts)
    assert rows(r.current_orphans(whole)) == [("b", 2), ("d", 1)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 20)), max_size=12), st.lists(st.tuples(st.integers(1, 4), st.integers(1, 9), st.integers(10, 20)), max_size=6))
def test_against_brute_force(spark, references, spans):
    deltas = _deltas(spark, [], [(f"x:{k}", day(a), day(z)) for k, a, z in spans])
    refs = _refs(spark, [(i, f"x:{k}", day(t), "") for i, (k, t) in enumerate(references)])
    want = {}
    for i, (k, t) in enumerate(references):
        own = {(a, z) for kk, a, z in spans if kk == k}
        if not any(a <= t < z for a, z in own):
            want[i] = "absent" if not own else "deleted" if any(z <= t for _, z in own) else "late"
    assert {x["child_no"]: x["reason"] for x in r.orphan_references(refs, deltas).collect()} == want
