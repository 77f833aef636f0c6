from datetime import date

import pytest
from pyspark.sql import functions as F

from inspectra import schemas
from inspectra.functions import parse
from inspectra.operators import awards, ingest_florida, ingest_nyc, resolve

NYC = ", ".join(f"{c} string" for c in [*schemas.NYC_REQUIRED, "dba", "extra"])


def _nyc(spark, rows):
    base = {"camis": "41", "inspection_date": "01/05/2024", "inspection_type": "Cycle  Inspection", "critical_flag": "Critical", "record_date": "2024-09-01", "score": "12", "action": "Cited"}
    names = [f.split()[0] for f in NYC.split(", ")]
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], NYC)


def test_rejections_in_order_and_counts(spark):
    raw = _nyc(spark, [{}, {"camis": " "}, {"camis": "x1"}, {"camis": None, "inspection_date": "1900-01-01"}, {"inspection_date": "soon"}, {"inspection_date": "1/1/1900"}])
    report = {r[0]: r[1] for r in ingest_nyc.build_events(raw)[2].collect()}
    assert report == {"kept": 1, "invalid_camis": 3, "unparseable_date": 1, "placeholder_date": 1}


def test_conflicts_and_violations(spark):
    raw = _nyc(spark, [
        {"violation_code": "04L", "violation_description": "Mice  seen", "score": "12", "grade": "A", "grade_date": "2024-01-06"}, {"violation_code": "04l", "violation_description": "mice seen", "score": "27", "critical_flag": "Not Critical", "record_date": "2024-08-01"},
        {"violation_code": "10B", "score": "12", "dba": "Old", "record_date": "2024-08-01"}, {"violation_code": None, "dba": "New", "action": "Missing"}])
    events, violations, _ = ingest_nyc.build_events(raw)
    e = events.first()
    assert events.count() == 1 and events.columns == schemas.INSPECTION_EVENTS.names
    assert (e["inspection_id"], e["score"], e["score_conflict"], e["score_conflict_values"]) == ("nyc:41:2024-01-05:Cycle Inspection", 12.0, True, [12.0, 27.0])
    assert (e["grade"], e["grade_date"], e["dba"], e["action"], e["action_conflict"]) == ("A", date(2024, 1, 6), "New", "Cited", False)
    assert (e["violation_count"], e["critical_violation_count"], e["source_snapshot_date"]) == (2, 2, date(2024, 9, 1))
    assert violations.count() == 2 and {v["severity"] for v in violations.collect()} == {"critical"}


def test_tie_at_the_latest_date_gives_null(spark):
    e = ingest_nyc.build_events(_nyc(spark, [{"score": "12"}, {"score": "27"}]))[0].first()
    assert (e["score"], e["score_conflict"]) == (None, True)


def test_order_of_rows_does_not_matter(spark, rows):
    raw = _nyc(spark, [{"camis": str(40 + i % 3), "score": str(i), "violation_code": f"0{i % 4}A", "record_date": f"2024-0{1 + i % 5}-01", "dba": f"N{i % 2}"} for i in range(20)])
    a = ingest_nyc.build_events(raw)
    b = ingest_nyc.build_events(raw.orderBy(F.rand(3)).repartition(7))
    assert rows(a[0]) == rows(b[0]) and rows(a[1]) == rows(b[1])


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="grade_date"):
        ingest_nyc.build_events(_nyc(spark, []).drop("grade_date"))


def _florida(spark, rows):
    base = dict.fromkeys(schemas.FL_REQUIRED, "0") | {
        "license_type_code": "2010", "license_number": "777", "inspection_number": "9", "visit_number": "1", "inspection_class": "Food", "inspection_type": "Routine - Food", "inspection_disposition": "Warning Issued",
        "inspection_date": "1/5/2024", "total_violations": "3", "high_priority_count": "1", "intermediate_count": "1", "basic_count": "1", "violation_02": "3", "inspection_visit_id": "v"}
    return spark.createDataFrame([tuple((base | r)[c] for c in schemas.FL_REQUIRED) for r in rows], ", ".join(f"{c} string" for c in schemas.FL_REQUIRED))


def test_florida_cascade_dedup_and_matrix(spark):
    raw = _florida(spark, [{"inspection_visit_id": "a"}, {"inspection_visit_id": "a"}, {"inspection_visit_id": "b"}, {"inspection_visit_id": "b", "total_violations": "4"}, {"inspection_visit_id": "c", "basic_count": "-1", "violation_07": "abc", "inspection_disposition": "Callback – Complied"},
                           {"license_type_code": "2001"}, {"license_number": " "}, {"inspection_visit_id": None}, {"visit_number": "x"}, {"inspection_date": "soon"}])
    events, violations, report, conflicts = ingest_florida.build_events(raw)
    assert {r[0]: r[1] for r in report.collect()} == {"kept": 5, "out_of_scope": 1, "missing_license": 1, "missing_visit_id": 1, "invalid_identity": 1, "unparseable_date": 1}
    assert {(e["inspection_id"], e["disposition_status"], e["basic_count"]) for e in events.collect()} == {("florida:a", "follow_up_required", 1), ("florida:c", "met_standards", None)}
    assert [tuple(r) for r in conflicts.collect()] == [("b", 2)]
    assert {(v["violation_code"], v["count"]) for v in violations.collect()} == {("02", 3)} and violations.count() == 2
    visits, _ = ingest_florida.deduplicated(ingest_florida.staged(raw).where("reject IS NULL"))
    assert ingest_florida.reconciliation(visits).first().asDict() == {"visits": 2, "total_differs_from_priorities": 0, "total_differs_from_categories": 0, "malformed_rows": 1, "unknown_dispositions": 0}


def test_award_reasons_identity_and_conflicts(spark):
    names = [*awards.REQUIRED, *awards.OPTIONAL]
    good = {"name_as_published": "Café Rosa LLC", "city": "Lakeside", "region": "FL", "jurisdiction_candidate": "florida", "distinction": "one_star", "guide_name": "G", "guide_year": "2024", "source_url": "u", "source_title": "t", "source_publisher": "p", "source_access_date": "2024-02-01",
            "source_license_note": "l", "provenance_confidence": "verified_primary", "address_as_published": "12 Elm Street", "curator_restaurant_ref": "r"}
    rows = [good, good | {"name_as_published": "CAFE ROSA", "city": "Hilltown"}, good | {"guide_year": "soon"}, good | {"city": " "}, good | {"distinction": "four"}, good | {"source_access_date": "01/02/2024"}, good | {"announced_date": "x"}, good | {"address_as_published": "13 Elm St"}, good | {"provenance_confidence": None}]
    b = awards.build(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} string" for n in names)))
    assert {r[0]: r[1] for r in b["rejected"].collect()} == {"malformed_guide_year": 1, "missing_required_field": 1, "unsupported_distinction": 1, "missing_provenance": 1, "malformed_announced_date": 1, "invalid_provenance_confidence": 1}
    assert b["restaurants"].count() == 2 and {r["kind"] for r in b["conflicts"].collect()} == {"city_region", "identity_drift"}
    assert awards.orphan_events(b["events"], b["restaurants"].limit(0)).count() == b["events"].count()


def test_lenient_values(spark):
    v = spark.createDataFrame([(" 1/5/2024 ", "12", "3.5"), ("2024-01-05T00:00", "12.0", "nan"), ("01/05/2024", "-1", "x"), (None, "", None), ("13/40/2024", " ", " 2 ")], "d string, n string, x string")
    got = [tuple(r) for r in v.select(parse.iso_or_slash_date(F.col("d")), parse.count_value(F.col("n")), parse.count_malformed(F.col("n")), parse.lenient_double(F.col("x"))).collect()]
    day = date(2024, 1, 5)
    assert got == [(day, 12, False, 3.5), (day, None, True, None), (day, None, True, None), (None, None, False, None), (None, None, False, 2.0)]


def test_headers(spark):
    assert parse.canonical_headers(["﻿CAMIS", " Inspection Date", "grade", "New One"], schemas.NYC_HEADERS) == ["camis", "inspection_date", "grade", "New One"]
    assert parse.canonical_headers(["INSP_NO", "Violation 07", "V_08", "License Number"], schemas.FL_HEADERS) == ["inspection_number", "violation_07", "violation_08", "license_number"]
    with pytest.raises(ValueError, match="GRADE"):
        parse.canonical_headers(["grade", "GRADE"], schemas.NYC_HEADERS)


def test_keep_first_and_duplicates_with_nulls(spark, rows):
    df = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("k", 1, None), ("k", 1, "c")], "k string, n int, v string")
    assert rows(resolve.keep_first(df, ["k"], [F.asc("n"), F.asc_nulls_last("v")])) == [("k", 1, "c"), (None, 1, "a")]
    assert rows(resolve.unique_violations(df, ["k"])) == [("k", 2), (None, 2)]
