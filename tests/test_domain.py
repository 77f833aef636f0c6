import math
import os
import random
import unicodedata
from collections import Counter
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inspectra.functions import bounds, names, similarity
from inspectra.operators import evaluation, forms, graph, matching, models, questions, serving
from inspectra.plans import domain_queries

SIDE = "id string, jurisdiction string, name string, address string, city string, postal_code string, latitude double, longitude double"


def test_candidates_by_each_rule(spark):
    left = spark.createDataFrame([("o", "nyc", "golden heron", "12 elm st", "Lake", "11111", 40.0, -74.0)], SIDE)
    right = [("zip", "nyc", "x y", None, None, "11111", None, None), ("num", "nyc", "x y", "12 oak rd", "lake", None, None, None), ("tok", "nyc", "the heron bar", None, "LAKE", None, None, None), ("geo", "nyc", "x y", None, None, None, 40.01, -74.0),
             ("far", "nyc", "x y", None, None, None, 40.03, -74.0), ("fl", "florida", "golden heron", "12 elm st", "Lake", "11111", 40.0, -74.0), ("all", "nyc", "golden heron", "12 elm st", "Lake", "11111", 40.0, -74.0), ("none", "nyc", None, None, None, None, None, None)]
    got = {r["right_id"]: r["rules"] for r in matching.candidate_pairs(left, spark.createDataFrame(right, SIDE)).collect()}
    assert got == {"zip": ["postal_code_exact"], "num": ["street_number_and_city"], "tok": ["shared_name_token_and_city"], "geo": ["geo_proximity"], "all": matching.RULES}


def test_evidence_and_conflicts(spark):
    a = spark.createDataFrame([("o1", "nyc", "golden heron", "12 elm st", "Lake", "11111", None, None), ("o2", "nyc", "golden heron", "12 elm st", "Lake", "11111", None, None), ("o3", "nyc", "paper moon", None, "Lake", "22222", None, None)], SIDE)
    b = spark.createDataFrame([("a1", "nyc", "golden heron", "12 elm st", "lake", "11111", None, None), ("a2", "nyc", "paper moon", "1 a st", "Lake", "33333", None, None)], SIDE)
    pairs = spark.createDataFrame([("o1", "a1"), ("o2", "a1"), ("o3", "a2")], "left_id string, right_id string")
    e = {(r["left_id"], r["right_id"]): r for r in matching.strict_conflicts(matching.evidence(pairs, a, b)).collect()}
    assert e["o1", "a1"]["overall_score"] == 1.0 and e["o1", "a1"]["decision"] == "review" and e["o1", "a1"]["conflicting_candidates"] == ["o2"]
    assert e["o3", "a2"]["required_evidence_missing"] == ["address_similarity"] and e["o3", "a2"]["conflicting_evidence"] == ["postal_code_conflict"] and e["o3", "a2"]["overall_score"] <= 0.9


def _random_sides(spark):
    """Entities that meet by any rule and by several, by several words, across cells, with blanks, NULLs and rivals."""
    rng = random.Random(7)
    def rows(p, n):
        pick = lambda *xs: rng.choice(xs)
        return [(f"{p}{i}", pick("nyc", "nyc", "florida", None), " ".join(rng.sample(["blue", "heron", "cafe", "the", "taqueria", "joes", "oak"], rng.randint(0, 4))) if i % 9 else None,
                 pick("12 oak st", "12 oak street n", "40 elm ave", "elm ave", "", None), pick("Miami", "MIAMI ", "Tampa", "", None), pick("33101", "33102", "10001", None),
                 pick(25.7, 25.701, 25.74, 62.0, None), pick(-80.2, -80.202, -80.17, None)) for i in range(n)]
    sure = ("nyc", "paper moon", "9 pine rd", "Ocala", "34470", None, None)
    make = lambda p, n: spark.createDataFrame([(p, *sure), *rows(p, n)], SIDE)
    return make("o", 120).localCheckpoint(), make("a", 40).localCheckpoint()


def test_decided_pairs_without_a_shuffle_of_pairs(spark, rows):
    a, b = _random_sides(spark)
    pairs = matching.candidate_pairs(a, b)
    assert rows(matching.met_pairs(a, b).select("left_id", "right_id", "rules")) == rows(pairs) == rows(matching.met_pairs(a, b, hot=3).select("left_id", "right_id", "rules"))
    shown = ["left_id", "right_id", "rules", "name_similarity", "address_similarity", "city_region_match", "distance_km", "overall_score", "decision", "conflicting_candidates", "required_evidence_missing", "conflicting_evidence"]
    whole = matching.strict_conflicts(matching.evidence(pairs, a, b)).select(*shown)
    got = matching.decided_pairs(a, b)
    assert rows(got.select(*shown)) == rows(whole) and {r["decision"] for r in whole.collect()} == {"accept", "review", "reject"}
    plan = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString().split("Join")[0]
    assert "Exchange" not in plan and "Window" not in plan


def test_reviewable_pairs_without_a_shuffle_of_rejected_ones(spark, rows):
    a, b = _random_sides(spark)
    shown = ["left_id", "right_id", "rules", "overall_score", "decision", "conflicting_candidates"]
    whole = matching.strict_conflicts(matching.evidence(matching.candidate_pairs(a, b), a, b)).where("decision <> 'reject'")
    got = matching.reviewable_pairs(a, b)
    assert rows(got.select(*shown)) == rows(whole.select(*shown))


def test_decided_pairs_measures_rivals_within_bounds_only(spark, rows, monkeypatch):
    """Before all pairs are measured once, for their rivals only those are measured that can be reviewable."""
    a, b = _random_sides(spark)
    sizes, measured = [], matching.measured
    monkeypatch.setattr(matching, "measured", lambda j: sizes.append(j.count()) or measured(j))
    got = matching.decided_pairs(a, b)
    whole = matching.candidate_pairs(a, b).count()
    assert sizes[1] == whole == got.count() and sizes[0] < whole / 2


@pytest.mark.parametrize("listed", [1, 10**9])
def test_bounds_leave_out_rejected_pairs_only(monkeypatch, listed):
    """Against the score of every pair: repeated, shared and unknown words, blanks, NULLs, long texts, equal and far places, no numbers."""
    monkeypatch.setattr(bounds, "LISTED", listed)
    monkeypatch.setattr(bounds, "BLOCK", 1_000)
    rng = random.Random(5)
    words = ["golden", "heron", "cafe", "the", "taqueria", "joes", "oak", "l", "l", "c", "öß", "harborlight", "zinazel", "pier"]
    def entity(key):
        name = rng.choice([" ".join(rng.choices(words, k=rng.randint(0, 6))), "golden heron cafe", "joes  oak", None, "oak " * 30 + "pier"])
        address = rng.choice([f"{rng.randint(1, 99)} {rng.choice(words)} st", "12 harborlight st", "", None, "12 harborlight pier " * 5])
        lat = rng.choice([40.7, 40.7, 40.705, 41.0, None, float("nan")])
        return {"h": key, "rule": 3 if key == 2 else 0, "name": name, "address": address, "city": rng.choice(["lake", "", "port", None]), "postal_code": rng.choice(["11111", "22222", None]),
                "latitude": lat, "longitude": -74.0, "no_place": lat is None}
    x, y = (pd.DataFrame([entity(rng.randint(0, 3)) for _ in range(n)]).astype({"latitude": float}) for n in (150, 120))
    found = {(i, j) for a, b in bounds.promising(x, y, least=matching.REVIEW, weights=matching.WEIGHTS, score_km=matching.SCORE_KM, near={3: 2.0}) for i, j in zip(a.tolist(), b.tolist())}
    left, right, wanted, together, w = x.to_dict("records"), y.to_dict("records"), set(), 0, matching.WEIGHTS
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if a["h"] != b["h"]:
                continue
            km = math.dist(*([6371.0 * math.radians(e["latitude"]), 0] for e in (a, b))) if not (a["no_place"] or b["no_place"]) else None
            if a["rule"] == 3 and (km is None or not km <= 2.0):
                continue
            together += 1
            at = [(w["name"], similarity.mean_ratios([a["name"] or ""], [b["name"] or ""])[0])]
            at += [(w["address"], similarity.indel(a["address"], b["address"]))] if a["address"] and b["address"] else []
            at += [(w[k], float(a[c] == b[c])) for k, c in (("postal", "postal_code"), ("city", "city")) if a[c] is not None and b[c] is not None]
            at += [(w["distance"], max(0.0, 1 - km / matching.SCORE_KM))] if km is not None and not math.isnan(km) else []
            nan = km is not None and math.isnan(km)  # a score that is no number is above all others
            if nan or sum(p * v for p, v in at) / sum(p for p, _ in at) >= matching.REVIEW:
                wanted.add((i, j))
    free = {(i, j) for i, j in found if math.isnan(left[i]["latitude"]) and not left[i]["no_place"] or math.isnan(right[j]["latitude"]) and not right[j]["no_place"]}
    assert wanted <= found and len(wanted - free) > 100 and len(found - free) < together / 4


def test_promising_pairs_hold_all_reviewable_ones_once(spark):
    a, b = _random_sides(spark)
    whole = matching.evidence(matching.candidate_pairs(a, b), a, b).where("decision <> 'reject'")
    for hot in (3, 20_000):
        got = [(r["left_id"], r["right_id"]) for r in matching.promising_pairs(a, b, hot=hot).collect()]
        assert {(r["left_id"], r["right_id"]) for r in whole.select("left_id", "right_id").collect()} <= {*got} and len(got) == len({*got})


def test_search_moves_no_pairs_and_equals_brute_force(spark, monkeypatch):
    """Blocks on both sides, equal texts (ties by document), repeated words, unknown words and blank texts."""
    monkeypatch.setattr(questions, "BLOCK", 7)
    rng = random.Random(11)
    text = lambda: " ".join(rng.choices(["soap", "sink", "ice", "log", "rice", "fish", "melon", "grill"], k=rng.randint(0, 6)))
    docs, asked = [(f"d{i:02}", text()) for i in range(40)], [(i, text() + " zorp" * (i % 2)) for i in range(30)]
    docs += [(f"e{i}", docs[i][1]) for i in range(15)]
    df = Counter(w for _, t in docs for w in set(t.split()))
    idf = lambda w: math.log((1 + len(docs)) / (1 + df[w])) + 1
    vector = lambda t: {w: c * idf(w) for w, c in sorted(Counter(t.split()).items())}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = set()
    for q, t in asked:
        a, scored = vector(t), []
        for d, u in docs:
            b = vector(u)
            if (dot := sum(a[w] * b[w] for w in a if w in b)) > 0 and dot / norm(a) / norm(b) >= 0.05:
                scored.append((-round(dot / norm(a) / norm(b), 9), d))
        want |= {(q, d, -s) for s, d in sorted(scored)[:3]}
    top = questions.tfidf_top(spark.createDataFrame(docs, "d string, t string"), spark.createDataFrame(asked, "q int, t string"), doc="d", text="t", query="q", query_text="t", k=3)
    assert {(r["q"], r["d"], round(r["score"], 9)) for r in top.collect()} == want
    assert top.schema.simpleString() == "struct<q:int,d:string,score:double>" and "FlatMapCoGroupsInPandas" in top._jdf.queryExecution().optimizedPlan().toString()


def test_similarities_of_many_pairs_are_those_of_each():
    rng = random.Random(5)
    texts = ["", "a", "a a", " x  y ", "é ü", "q" * 64, "q" * 65, "ab" * 32, "word " * 30] + [" ".join(rng.choices(["blue", "heron", "cafe", "joes", "oak", "taqueria"], k=rng.randint(1, 9))) for _ in range(60)]
    pairs = [(x, y) for x in texts for y in texts]
    assert list(similarity._indels(pairs)) == [similarity.indel(x, y) for x, y in pairs]
    assert list(similarity._partials(pairs)) == [similarity.partial(x, y) for x, y in pairs]
    assert list(similarity.mean_ratios(*map(list, zip(*pairs)))) == [(similarity.sorted_ratio(x, y) + similarity.set_ratio(x, y) + similarity.weighted_ratio(x, y)) / 3 for x, y in pairs]


def test_similarities():
    assert similarity.indel("abcd", "abxd") == 0.75 and similarity.indel("", "") == 1.0
    assert similarity.sorted_ratio("rosa cafe", "cafe rosa") == 1.0 and similarity.set_ratio("cafe rosa", "cafe rosa lake") == 1.0
    assert similarity.partial("rosa", "cafe rosa lake") == 1.0 and 0 < similarity.weighted_ratio("rosa", "cafe rosa lake") < 1


def test_normal_forms(spark):
    df = spark.createDataFrame([("Café D’Or & Sons, LLC.", "12 North Elm Street, Suite 4B"), (None, None), ("THE Bar", "#3")], "n string, a string")
    got = [tuple(r) for r in df.select(names.normal_name(F.col("n")), names.telling_tokens(names.normal_name(F.col("n"))), names.normal_address(F.col("a"))["normal"], names.normal_address(F.col("a"))["unit"]).collect()]
    assert got[0] == ("cafe dor and sons", ["dor", "and", "sons"], "12 n elm st", "suite 4b") and got[1][0] is None and got[2][1] == ["the", "bar"]


def test_metrics_against_definitions(spark):
    data = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.4), (1, 0.3), (0, 0.1)]
    df = spark.createDataFrame([(i, y, p, "g") for i, (y, p) in enumerate(data)], "k int, y int, p double, g string")
    m = evaluation.average_precision(df, "y", "p", ["g"]).first()
    steps, auc = sorted({p for _, p in data}, reverse=True), [(1.0 if a > b else 0.5 if a == b else 0.0) for y, a in data if y for z, b in data if not z]
    tp = lambda t: sum(y for y, p in data if p >= t)
    ap = sum((tp(t) - (tp(steps[i - 1]) if i else 0)) / 3 * tp(t) / sum(p >= t for _, p in data) for i, t in enumerate(steps))
    assert abs(m["average_precision"] - ap) < 1e-12 and abs(m["roc_auc"] - sum(auc) / len(auc)) < 1e-12
    one = evaluation.average_precision(df.where("y = 1"), "y", "p", ["g"]).first()
    assert one["average_precision"] is None and evaluation.top_decile(df, "y", "p", "k", ["g"]).first()["top_decile_recall"] is None
    t = evaluation.threshold_metrics(df, "y", "p", ["g"]).first()
    assert (t["tp"], t["fp"], t["tn"], t["fn"]) == (2, 1, 2, 1)


def test_targets_and_split(spark):
    e = spark.createDataFrame([("i1", evaluation.NYC_TYPES[0], 14.0, False), ("i2", evaluation.NYC_TYPES[0], 13.0, None), ("i3", "x " + evaluation.NYC_TYPES[0], 20.0, False), ("i4", evaluation.NYC_TYPES[1], None, False), ("i5", evaluation.NYC_TYPES[1], 20.0, True)], "inspection_id string, inspection_type string, score double, score_conflict boolean")
    y, report = evaluation.nyc_target(e)
    assert {tuple(r) for r in y.collect()} == {("i1", 1), ("i2", 0)} and {r[0]: r[1] for r in report.collect()} == {"kept": 2, "non_qualifying_type": 1, "missing_score": 1, "score_conflict": 1}
    f = spark.createDataFrame([("a", "g1", 1, 0, "met_standards"), ("b", "g2", 1, 0, "met_standards"), ("c", "g2", 1, 1, "met_standards"), ("d", "g3", 1, 0, "temporary_closure"), ("e", "g4", 2, 5, "met_standards")], "inspection_id string, native_inspection_group_id string, native_visit_sequence int, high_priority_count int, disposition_status string").withColumn("inspection_type", F.lit(evaluation.FL_TYPE))
    assert {tuple(r) for r in evaluation.florida_target(f)[0].collect()} == {("a", 0), ("d", 1)}
    days = spark.createDataFrame([(date(2024, m, 1), m % 2) for m in range(1, 9)], "day date, label int")
    split = evaluation.chronological_split(days, "day", ["2024-02-01", "2024-04-01", "2024-06-01", "2024-08-01"])
    assert {r["part"]: r["rows"] for r in evaluation.part_summary(split, "label", "day").collect()} == {"before": 1, "train": 2, "validation": 2, "test": 2, "after": 1}
    with pytest.raises(ValueError):
        evaluation.chronological_split(days, "day", ["2024-02-01", "2024-02-01", "2024-06-01", "2024-08-01"])


def test_bands_and_intervals(spark):
    df = spark.createDataFrame([("a", 0, 5, 0.9), ("b", 3, 0, 0.9), ("c", 3, 2, 0.25), ("d", 3, 1, 0.5)], "e string, depth int, valid int, p double").withColumns({"lo": F.col("p"), "hi": F.col("p")})
    got = {r["e"]: (r["risk_band"], r["p"]) for r in evaluation.banded(df, depth="depth", valid="valid", p="p", lower="lo", upper="hi").collect()}
    assert got == {"a": ("insufficient_history", None), "b": ("insufficient_history", None), "c": ("moderate", 0.25), "d": ("high", 0.5)}
    m = spark.createDataFrame([("x", i / 100, 0.99) for i in range(21)] + [("y", 0.1, 0.5)], "e string, v double, point double")
    r = {x["e"]: x for x in evaluation.interval(m, "e", "v", "point").collect()}
    assert r["x"]["upper"] == 0.99 and abs(r["x"]["lower"] - 0.005) < 1e-12 and r["y"]["lower"] is None


def test_models_learn_and_refuse(spark):
    rows = [(f"r{i % 40}", f"i{i}", date(2024, 1 + i % 6, 1), float(i % 10), float((i * 7) % 5), int(i % 10 > 5)) for i in range(240)]
    df = spark.createDataFrame(rows, "entity string, inspection_id string, day date, signal double, noise double, label int").withColumn("noise", F.when(F.col("noise") > 0, F.col("noise")))
    good = models.select_model(df, df, ["signal", "noise"], "label", boosted=False)
    assert good.name == "logistic" and good.average_precision > 0.95
    assert models.select_model(df, df.withColumn("label", F.lit(1) - F.col("label")), ["signal"], "label", boosted=False).status == "insufficient_performance"
    s = models.scored(good.model, df, ["signal", "noise"])
    method = models.calibrate(s, "label")
    assert method[0] == "sigmoid" and models.calibrated(s, method).where("calibrated BETWEEN 0 AND 1").count() == 240
    assert models.calibrate(s.limit(5), "label")[0] == "raw"
    t = models.bootstrap_multiplicities(df, "entity", 3)
    assert {r[0]: r[1] for r in t.groupBy("member").agg(F.sum("times")).collect()} == {0: 40, 1: 40, 2: 40}
    assert models.readiness(model_status="selected", calibration="sigmoid", members=20, needed=20, features=["a"], splits_ok=True, test_ok=True) == "ready"


def test_graph(spark):
    r = spark.createDataFrame([("r1", "nyc", "A", "Lake", None, "Thai "), ("r1", "nyc", "B", "Lake", None, "Thai ")], "restaurant_id string, jurisdiction string, name string, city string, postal_code string, cuisine string")
    i = spark.createDataFrame([("i1", "r1", date(2024, 1, 1), "T", 5.0), ("i2", "zz", date(2024, 1, 2), "T", 7.0)], "inspection_id string, restaurant_id string, inspection_date date, inspection_type string, score double")
    v = spark.createDataFrame([(f"v{k}", "i1", "r1", "nyc", date(2024, 1, k), "04l", f"d{k}", "critical", k - 1) for k in (1, 2, 3)], "violation_event_id string, inspection_id string, restaurant_id string, jurisdiction string, inspection_date date, violation_code_norm string, violation_description string, severity string, count int")
    nodes, edges, conflicts = graph.build_graph(restaurants=r, inspections=i, violations=v)
    assert {r["node_id"] for r in conflicts.collect()} == {"r1"} and nodes.where("node_type = 'location'").first()["node_id"] == "location:nyc:lake:_unknown"
    assert edges.where("edge_type = 'has_inspection'").count() == 1 and graph.dangling_edges(nodes, edges).count() == 0
    assert graph.neighbours(edges, nodes.where("node_type = 'restaurant'"), ["has_inspection", "documented_violation"]).count() == 3
    c = graph.recurring_codes(v).first()
    assert (c["occurrences"], c["inspections"], c["citations"], c["violation_description"]) == (3, 1, 4, "d3")
    with pytest.raises(ValueError):
        graph.check_capacity(nodes, edges, max_nodes=2)


def test_questions(spark):
    asked = {"What is the latest inspection?": ("matched", "latest_inspection_summary"), "Is there a trend in the forecast?": ("ambiguous", None), "Hello": ("unknown", None), "Can we guarantee an A?": ("prohibited", None), "Any recurring or repeat issue?": ("prohibited", None)}
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert {r[0]: (r[1]["outcome"], r[1]["intent"]) for r in df.select("q", questions.intent(F.col("q"))).collect()} == asked
    assert df.where(questions.prohibited(F.col("q"), whole_words=True)).count() == 1
    docs = spark.createDataFrame([("d1", "cold holding of food"), ("d2", "hand washing"), ("d3", "cold water for hand washing")], "d string, t string")
    top = questions.tfidf_top(docs, spark.createDataFrame([("q", "hand washing")], "q string, t string"), doc="d", text="t", query="q", query_text="t", k=2).collect()
    assert [r["d"] for r in sorted(top, key=lambda r: -r["score"])] == ["d2", "d3"] and abs(max(r["score"] for r in top) - 1) < 1e-9
    claims = spark.createDataFrame([("c1", "award_context", "nyc"), ("c2", "guidance_for_code", "nyc"), ("c3", "latest_inspection", "nyc")], "claim_id string, claim_type string, jurisdiction string")
    cites = spark.createDataFrame([("c1", "record", "nyc"), ("c3", "record", "nyc")], "claim_id string, evidence string, jurisdiction string")
    assert {r[0] for r in questions.unauthorized_claims(claims, cites).collect()} == {"c1", "c2"}


def test_forms(spark):
    text = "City of New York\nCAMIS: 12345   DBA: Joe's\nInspection Date - 01/05/2024\tScore: 12\nScore: 13\nViolation Code: 04L\nDescription: Mice seen\nNot Critical\nViolation Code: 10B Critical"
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "doc string, text string")
    f = {r["field"]: (r["status"], r["value"]) for r in forms.fields(docs, "doc", "text", forms.NYC_LABELS).where("doc = 'a'").collect()}
    assert f["camis"] == ("found", "12345") and f["restaurant_name"] == ("found", "Joe's") and f["score"] == ("ambiguous", None) and f["grade"] == ("missing", None)
    assert [tuple(r) for r in forms.violation_rows(docs, "doc", "text").collect()] == [("a", "04L", "Mice seen", False), ("a", "10B", None, True)]
    assert docs.select(forms.jurisdiction(F.col("text"))).first()[0] == "nyc"
    packed = "Violation Code: 04L, Description: Mice seen  Critical Flag: Critical\nViolation Code 08A.\nnothing here\nViolation Description - Holes in wall Critical Flag: Not Critical\nVIOLATION CODE: 02B\nDescription: Hot food Violation Code: 02G"
    d = spark.createDataFrame([("p", packed, "clash")], "doc string, text string, code string")
    assert [tuple(r) for r in forms.violation_rows(d, "doc", "text").collect()] == [
        ("p", "04L", "Mice seen", True), ("p", "08A", "Holes in wall", False), ("p", "02B", None, None), ("p", "02G", None, None)]
    v = spark.createDataFrame([("q", "Restaurant Name: The Score Bar\tGrade: " + "A" * 81 + "\nDBA:\nScore 7")], "doc string, text string")
    g = {r["field"]: r["value"] for r in forms.fields(v, "doc", "text", forms.NYC_LABELS).collect()}
    assert g["restaurant_name"] == "The Score Bar" and g["grade"] is None


def test_blocks_beyond_a_limit_reject_the_document(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    schema = f"document_id string, page int, text string, source string, bounding_box {box}, ocr_confidence double"
    ok = ("ok", 1, "a", "ocr", (0.0, 0.0, 1.0, 1.0), 0.9)
    rows = [ok, ("bad", 1, "a", "ocr", None, 0.9), ("bad", 1, "b", "ocr", None, 1.2), ("inf", 1, "b", "embedded_text", (0.0, 0.0, float("inf"), 1.0), None)]
    blocks = spark.createDataFrame(rows + [("many", 2, f"{i:03}", "embedded_text", None, None) for i in range(501)], schema)
    assert {r["document_id"] for r in forms.valid_blocks(blocks).collect()} == {"ok"}
    assert {(r["document_id"], r["problem"], r["blocks"]) for r in forms.block_problems(blocks).collect()} == {
        ("bad", "ocr_confidence", 1), ("inf", "bounding_box", 1), ("many", "blocks_per_page", 501)}
    b = spark.createDataFrame([(bytearray(b"%PDF-1.7 x"),), (bytearray(b"\x89PNG\r\n\x1a\n.."),), (bytearray(b"\xff\xd8\xff\xe0"),), (bytearray(b"GIF"),)], "b binary")
    assert [r[0] for r in b.select(forms.media_type(F.col("b"))).collect()] == ["application/pdf", "image/png", "image/jpeg", None]


def test_serving(spark, rows):
    r = spark.createDataFrame([(f"r{i}", f"name {i % 3}") for i in range(7)], "k string, n string")
    page, total = serving.search_page(r, name="n", key="k", query="name 1", limit=1, offset=1)
    assert rows(page) == [("r4", "name 1")] and total.first()[0] == 2
    assert serving.search_page(r, name="n", key="k", query="%")[1].first()[0] == 0
    with pytest.raises(ValueError):
        serving.search_page(r, name="n", key="k", limit=51)
    with pytest.raises(ValueError):
        serving.check_restaurant_id("xx:1")
    assert rows(serving.upsert(r.limit(2), spark.createDataFrame([("r0", "new")], "k string, n string"), ["k"])) == [("r0", "new"), ("r1", "name 1")]


def test_the_package_stands_without_the_llm_folder():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['inspectra.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p2_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_every_name_is_normalised(spark, tmp_path):
    texts = ["Joe’s “Grill”, LLC", "Tab\tBar", "Caf� Inc", "東京 Ramen Co", "ﬁne Dining", "Łódź & Sons", "Éclair", "plain name ltd", "", None]
    spark.createDataFrame(list(enumerate(texts)), "record_no long, name string").write.parquet(str(tmp_path / "restaurants.parquet"))

    def brute(x):
        x = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold().replace("&", " and ")
        return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else "" if c in "'’" else " " for c in x).split())

    got = {r["record_no"]: (r["normal"], r["bare"]) for r in domain_queries.normal_names(spark, str(tmp_path)).collect()}
    assert got == {i: (brute(t), " ".join(w for w in brute(t).split() if w not in names.LEGAL)) for i, t in enumerate(texts) if t is not None}


def test_owner_questions_search_the_guidance_pages(spark, tmp_path):
    docs = [("g1", "guidance_page", "the cold holding of food"), ("g2", "guidance_page", "hand washing and soap"), ("g3", "guidance_page", "who are you and what is this"), ("q1", "owner_qa", "what is the rule for hand washing"), ("q2", "owner_qa", "who are you"), ("x", "forum_crawl", "hand washing")]
    spark.createDataFrame(docs, "doc_id string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r["question_id"], r["doc_id"]) for r in domain_queries.tfidf_top(spark, str(tmp_path)).collect()] == [("q1", "g2")]
