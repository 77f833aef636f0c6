from datetime import date

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from inspectra.llm import survivorship as s

FIELDS = [s.Field("name"), s.Field("day", "date")]
SCHEMA = "id string, no long, name string, day date, trust int, snap date, key string, value string, field_name string"
d = lambda n: date(2024, 1, n)


def _survive(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    return {(r["key"], r["field_name"]): (r["record"], r["value"]) for r in s.surviving_values(df, key="id", record="no", fields=FIELDS, trust="trust", snapshot="snap").collect()}


def test_order_of_preference(spark):
    rows = [("a", 1, "Old Name", d(3), 5, d(5)), ("a", 2, "New Name", d(4), 5, d(9)), ("a", 3, "Other", d(5), 1, d(9)), ("b", 4, "alone", d(1), 5, d(5)), (None, 5, "x y", d(1), 5, d(5)), (None, 6, "x y", d(1), 5, d(5))]
    assert _survive(spark, rows) == {("a", "name"): (2, "New Name"), ("a", "day"): (3, "2024-01-05")}


def test_unusable_texts(spark):
    bad = [None, "", " \t", "N/A", "see file", "?", "-", "CafÃ© Rosa", "Caf� Rosa", "TBD"]
    rows = [("a", i, b, None, 9, d(9)) for i, b in enumerate(bad)] + [("a", 99, " Café Rosa ", None, None, None)]
    assert _survive(spark, rows) == {("a", "name"): (99, "Café Rosa")}
    assert _survive(spark, rows[:-1]) == {}


def test_cut_off_values_short_and_long(spark):
    rows = [("a", 1, "Ca", None, 9, d(9)), ("a", 2, "THE GOLDEN HER", None, 9, d(9)), ("a", 3, "The Golden Heron ", None, 1, d(1)), ("a", 4, "Cafe", None, 2, d(9)), ("a", 5, "Cafe Rosa", None, 0, d(9)), ("a", 6, "The Golden Hern", None, 0, d(9))]
    assert _survive(spark, rows)["a", "name"][0] == 3


def test_dates_need_a_snapshot_and_bounds(spark):
    rows = [("a", 1, None, date(1989, 12, 31), 9, d(9)), ("a", 2, None, d(10), 9, d(9)), ("a", 3, None, d(8), 1, None), ("a", 4, None, d(7), 1, d(7)), ("a", 5, None, d(7), 2, d(9)), ("a", 6, None, d(7), 2, d(9))]
    assert _survive(spark, rows) == {("a", "day"): (5, "2024-01-07")}


def test_empty_and_very_long(spark):
    assert _survive(spark, []) == {}
    long = "word " * 20_000
    assert _survive(spark, [("a", 1, long, None, 1, d(1)), ("a", 2, long + "more", None, 1, d(1))])["a", "name"][0] == 2


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["Rosa", "rosa b", "Rosa Bakery", "Rosa Bakery Inc", "none", "", "Zed", "zed Bakery & Sons"]), st.integers(0, 2), st.integers(1, 3)), max_size=10))
def test_against_brute_force(spark, records):
    rows = [(g, i, n, None, t, d(k)) for i, (g, n, t, k) in enumerate(records)]
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        usable = [r for r in own if r[2].strip() and r[2] != "none"]
        whole = [r for r in usable if not any(len(o[2]) > len(r[2]) and o[2].lower().startswith(r[2].lower()) for o in usable)]
        if len(own) >= 2 and whole:
            best = max(whole, key=lambda r: (r[4], r[5], len(r[2]), -r[1]))
            want[g, "name"] = (best[1], best[2])
    assert _survive(spark, rows) == want
