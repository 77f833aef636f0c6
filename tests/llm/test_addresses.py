import itertools
import random

import pytest

from inspectra.llm import addresses as a

SCHEMA = "no long, address string, city string, postal string, record string, place string"


def _pairs(spark, rows):
    df = spark.createDataFrame([(i, *r, "clash", "clash") for i, r in enumerate(rows)], SCHEMA)
    return {tuple(x) for x in a.same_place_pairs(df, record="no", address="address", city="city", postal="postal").collect()}


@pytest.mark.parametrize("text, want", [
    ("12 North Alder-Birch St., Unit 4", ("12", "alderbirch", "street", "n")), ("Alder Birch STREET 12", ("12", "alderbirch", "street", None)), ("No. 12 Alder Birch Strt (rear)", ("12", "alderbirch", "street", None)),
    ("#4B, 12 Alder Birch Blvd W", ("12", "alderbirch", "boulevard", "w")), ("12S. Alderbirch Pkwy - opp. ferry lot", ("12", "alderbirch", "parkway", "s")), ("305, WEST FIRST AVENUE", ("305", "1st", "avenue", "w")),
    ("305 W. 1st Ave Fl 2", ("305", "1st", "avenue", "w")), ("12 No. Alder Birch La, Lakeside, FL 30011", ("12", "alderbirch", "lane", "n")), ("0012 Alder Birch", ("12", "alderbirch", None, None)), ("somewhere", (None, None, None, None)), (None, (None, None, None, None)),
])
def test_components(text, want):
    p = a.parse_address(text, "Lakeside", "30011")
    assert (p["number"], p["name"], p["kind"], p["direction"]) == want


def test_pairs_and_contradictions(spark):
    rows = [("12 Alder Birch St", "Lakeside", "30011"), ("12 ALDERBIRCH STREET, Suite 3", "LAKESIDE", None), ("12 Aldre Birch", None, "30011-1234"), ("12 Alder Birch Ave", "Lakeside", "30011"), ("12 Alder Birch St", "Hilltown", "30500"),
            ("14 Alder Birch St", "Lakeside", "30011"), ("12 N Alder Birch St", "Lakeside", "30011"), ("12 S Alder Birch St", "Lakeside", "30011"), (None, None, None), ("", "Lakeside", ""), ("12 Alder Birch St", "Lakeside", "30011")]
    same = {frozenset(x) for x in itertools.combinations((0, 1, 2, 10), 2)} | {frozenset((i, j)) for i in (0, 1, 2, 10) for j in (6, 7)} | {frozenset((2, 3))}
    got = _pairs(spark, rows)
    assert {frozenset(p) for p in got} == same and all(x < y for x, y in got)


def test_typing_errors_within_the_allowed_edits(spark):
    rows = [("77 Volewell Eskulwell Rd", "Lakeside", "1"), ("77 Volwell Eskulwell Rd", "Lakeside", "1"), ("77 Volewell Eskulwlel Road", "Lakeside", "1"), ("77 Vxxewxll Exkulwxll Rd", "Lakeside", "1"), ("77 1st Rd", "Lakeside", "1"), ("77 2nd Rd", "Lakeside", "1")]
    assert _pairs(spark, rows) == {(0, 1), (0, 2), (1, 2)}


def test_empty_and_long(spark):
    assert _pairs(spark, []) == set()
    assert _pairs(spark, [("1 " + "alder " * 3000 + "St", "L", "1"), ("1 " + "alder " * 3000 + "Street", "L", "1")]) == {(0, 1)}


def _edits(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_every_name_within_the_allowed_edits_is_met(spark):
    rng, letters = random.Random(7), "abcdefghijklmnopqruvwxyz"
    names = ["walnut", "walmut", "madison", "madyson", "madson", "lincoln", "linkoln", "bedford", "bedgord", "22nd", "32nd", "oak", "oaks"]
    for n in (5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 17):
        for _ in range(4):
            names.append(word := "".join(rng.choice(letters) for _ in range(n)))
            for k in (1, 1, 2, 3, 3, 4, 4, 5):
                w = list(word)
                for _ in range(k):
                    at = rng.randrange(len(w))
                    w[at:at + 1] = rng.choice([[], [rng.choice(letters)], [w[at], rng.choice(letters)], [rng.choice(letters), w[at]]])
                names.append("".join(w))
    names = sorted({x for x in names if x} - set(a._KIND) - set(a._DIRECTION) - set(a.ORDINALS))
    allowed = lambda n: 4 if n >= 14 else 3 if n >= 10 else 1 if n >= 6 else 0
    lettered = lambda x: not x[0].isdigit()
    classes = spark.createDataFrame([(i, "7", x, None, None, "lakeside", None) for i, x in enumerate(names)], "class_id long, number string, name string, kind string, direction string, town string, zip string")
    want = {(i, j) for (i, x), (j, y) in itertools.combinations(enumerate(names), 2) if lettered(x) and lettered(y) and _edits(x, y) <= allowed(min(len(x), len(y)))}
    got = a.class_pairs(classes).collect()
    assert {(r[0], r[1]) for r in got} == want and len(got) == len(want) > 100 and all(0 < r["containment"] <= 1 for r in got)
    assert _pairs(spark, [("7 Walnut St", "Lakeside", "1"), ("7 Walmut St", "Lakeside", "1"), ("8 Walmut St", "Lakeside", "1")]) == {(0, 1)}
