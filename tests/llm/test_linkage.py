import itertools
import random

from pyspark.sql import functions as F

from inspectra.llm import linkage as l

LEFT = "seed long, n string, a string, c string, p string, lat string, lon string, name string, place string"
RIGHT = "rec long, ent string, n string, a string, c string, p string, lat string, lon string, name string, words string"
COLUMNS = {"name": "n", "address": "a", "city": "c", "postal": "p", "latitude": "lat", "longitude": "lon"}
LETTERS = "abcdefghijklmnoprstuvwz"


def _sources(spark, left, right):
    x = spark.createDataFrame([(*r, "clash", "clash") for r in left], LEFT)
    y = spark.createDataFrame([(*r, "clash", "clash") for r in right], RIGHT)
    return l.Source(x, ("seed",), **COLUMNS), l.Source(y, ("rec", "ent"), **COLUMNS)


def _link(spark, left, right):
    x, y = _sources(spark, left, right)
    return {r["seed"]: (r["ent"], r["confidence"]) for r in l.link(x, y, left_id="seed", right_id="rec", entity="ent").collect()}


def test_places_tenants_and_namesakes(spark):
    left = [
        (1, "The Golden Heron NYC", "12 Alder Birch St", "Lakeside", "30011", None, None),
        (2, "Heron Golden", None, "Lakeside", "30011", "26.5000", "-81.5000"),
        (3, "Golden Heron", "99 Other Rd", "Lakeside", "30011", None, None),
        (4, "Paper Moon", "12 Alder Birch Street", "Lakeside", "30011", None, None),
        (5, "Vexley Noodle House", "5 Elm Road", "Lakeside", "30011", None, None),
        (6, None, "12 Alder Birch St", "Lakeside", "30011", None, None),
        (7, "Quiet Ladle", None, "Lakeside", "30077", "26.9", "-81.9"),
    ]
    right = [
        (1, "f:1", "Golden Heron Inc.", "12 Alder-Birch STREET", "LAKESIDE", "30011", "26.5001", "-81.5001"),
        (2, "f:1", "Goldne Heron", None, "Lakeside", None, None, None),
        (3, "f:2", "Golden Heron", "7 Far Way", "Hilltown", "30500", "27.9", "-80.1"),
        (4, "f:3", "VEXLEY HOSPITALITY LLC", "5 Elm Rd", "Lakeside", "30011", None, None),
        (5, "f:4", "Quiet Ladle", "8 Oak St", "Lakeside", None, None, None),
        (6, "f:5", "", "12 Alder Birch St", "Lakeside", "30011", "0", "0"),
        (7, None, "Golden Heron", "12 Alder Birch St", "Lakeside", "30011", None, None),
    ]
    got = _link(spark, left, right)
    assert {k: v[0] for k, v in got.items()} == {1: "f:1", 2: "f:1", 5: "f:3", 7: "f:4"}
    assert all(0 <= c <= 1 for _, c in got.values())


def test_empty_sides(spark):
    one = [(1, "Golden Heron", "12 Alder St", "L", "30011", None, None)]
    assert _link(spark, [], [(1, "e", *one[0][1:])]) == {} and _link(spark, one, []) == {}


def _far(a, b):
    return sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(l.bit_vector(a), l.bit_vector(b)))


def test_hashing_finds_every_close_pair_and_meets_few_others(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.randint(5, 9)))
    names = [f"{word()} {word()}" for _ in range(200)]
    for n in names[:40]:  # a letter changed, dropped, or two swapped
        i = rng.randint(1, len(n) - 2)
        names.append(rng.choice([n[:i] + "x" + n[i + 1:], n[:i] + n[i + 1:], n[:i] + n[i + 1] + n[i] + n[i + 2:]]))
    at = (None, "L", "30011", None, None)
    x, y = _sources(spark, [(i, n, *at) for i, n in enumerate(names)], [(i, str(i), n, *at) for i, n in enumerate(names)])
    left, right = l.encode(x, {}), l.encode(y, {})
    found = {(r["seed"], int(r["ent"])) for r in l.close_vectors(left, right, "seed", "ent").collect()}
    every = set(itertools.product(range(len(names)), repeat=2))
    assert found == {(a, b) for a, b in every if _far(l.name_words(names[a]), l.name_words(names[b])) <= l.RADIUS}
    assert sum((i, i) in found for i in range(len(names))) == len(names)
    q, v = l._keys(left, ["seed"], True), l._keys(right, ["ent"], False)
    met = q.join(v.select("ent", "key"), "key").where(F.col("seed").cast("string") != F.col("ent")).select("seed", "ent").distinct().count()
    assert met < 0.05 * len(every)


def test_a_missing_town_or_uncomparable_places_hide_no_pair(spark):
    left = [
        (1, "Golden Heron", "178 Lupet Dale Dr", None, None, None, None), (2, "Paper Moon", "9 Elm Road", "Lakeside", "30011", None, None),
        (3, "Quiet Ladle", None, "Lakeside", "30011", None, None), (4, "Burnt Quince", None, "Hilltown", None, "26.5", "-81.5"),
    ]
    right = [
        (1, "f:1", "Golden Heron", "178 LUPETDALE DRIVE", "Lakeside", "30011", "26.5", "-81.5"),
        (2, "f:2", "Golden Heron", "179 Lupetdale Drive", "Lakeside", "30011", "26.6", "-81.6"),
        (3, "f:3", "Paper Moon", "9 Elm Rd", None, None, None, None),
        (4, "f:4", "Quiet Ladle", "8 Oak St", "Lakeside", None, "26.9", "-81.9"), (5, "f:5", "Burnt Quince", "8 Oak St", "Hilltown", "30500", None, None),
    ]
    assert {k: v[0] for k, v in _link(spark, left, right).items()} == {1: "f:1", 2: "f:3", 3: "f:4", 4: "f:5"}


def test_confidence_is_calibrated_and_recall_is_high(spark):
    """200 entities of two records, a tenant at each third address, namesakes elsewhere: recall and precision of at least 0.9."""
    rng = random.Random(11)
    word = lambda n=7: "".join(rng.choice(LETTERS) for _ in range(n)).title()
    slip = lambda s: s if rng.random() < 0.6 else s[:2] + s[3] + s[2] + s[4:]
    left, right, truth = [], [], {}
    for i in range(200):
        name, street, z = f"{word()} {word(5)}", f"{rng.randint(1, 400)} {word(9)}", f"{30000 + i % 40}"
        lat, lon = f"{25 + i / 100:.3f}", "-81.5"
        right += [(2 * i, f"e{i}", name, f"{street} Street", "Lakeside", z, lat, lon),
                  (2 * i + 1, f"e{i}", slip(name) if i % 5 else None, None if i % 4 == 0 else f"{street} St", "Lakeside", z, lat, lon)]
        if i % 3 == 0:
            right.append((1000 + i, f"t{i}", f"{word()} {word()}", f"{street} St", "Lakeside", z, lat, lon))
        if i % 7 == 0:
            right.append((2000 + i, f"n{i}", name, f"{rng.randint(500, 900)} {word(9)} Rd", "Hilltown", "39999", "29.1", "-80.1"))
        if i % 2 == 0:
            left.append((i, slip(name) + " NYC", None if i % 6 == 0 else f"{street} Str.", "Lakeside", z, lat, lon))
            truth[i] = f"e{i}"
        elif i % 5 == 0:
            left.append((i, f"{word()} {word()}", f"{street} St", "Lakeside", z, lat, lon))  # another tenant
    got = _link(spark, left, right)
    right_ones = sum(truth.get(k) == e for k, (e, _) in got.items())
    print("recall", right_ones / len(truth), "precision", right_ones / len(got))
    assert right_ones >= 0.9 * len(truth) and right_ones >= 0.9 * len(got)
