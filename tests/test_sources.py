import hashlib
import json
import math
import zipfile

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from inspectra import schemas
from inspectra.operators import models
from inspectra.plans import tables
from inspectra.sources import artifacts, corpus, files
from inspectra.streaming import state


def _workbook(path, rows):
    cell = lambda r, c, v: "" if v is None else f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_csv_strict_decoding_and_headers(spark, tmp_path):
    for name, data in (("a.csv", "\ufeffCAMIS,DBA\n1,Caf\u00e9\n".encode()), ("b.csv", "CAMIS,DBA\n2,\"Caf\u00e9, b\"\n".encode("windows-1252"))):
        (tmp_path / name).write_bytes(data)
    got = {(r["camis"], r["dba"], r["source_file"], r["source_encoding"]) for r in files.read_csv_strict(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv")], schemas.NYC_HEADERS).collect()}
    assert got == {("1", "Caf\u00e9", "a.csv", "utf-8-sig"), ("2", "Caf\u00e9, b", "b.csv", "windows-1252")}
    with pytest.raises(UnicodeDecodeError):
        files.decode_strictly(b"\x81\xff")


def test_csv_all_text_sorted_columns(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text("DBA,CAMIS,:@computed_region_x\n\"line\nbreak\",007,9\n")
    df = files.read_csv(spark, str(p), schemas.NYC_HEADERS)
    assert df.columns == ["camis", "dba"] and tuple(df.first()) == ("007", "line\nbreak")


def test_workbooks_and_mixed_extracts(spark, tmp_path):
    _workbook(tmp_path / "z.xlsx", [["INSP_NO", "V_01", "DBA_NAME"], ["1", None, "x"], ["2", "3", None]])
    df = files.read_workbook(spark, str(tmp_path / "z.xlsx"), schemas.FL_HEADERS)
    assert {tuple(r) for r in df.collect()} == {("1", None, "x"), ("2", "3", None)} and df.columns == ["inspection_number", "violation_01", "dba"]
    (tmp_path / "a.csv").write_text("Inspection Number,Violation 01\n9,1\n")
    both = files.read_extracts(spark, [str(tmp_path / "z.xlsx"), str(tmp_path / "a.csv")], schemas.FL_HEADERS, ["inspection_number"])
    assert {r["source_file"] for r in both.collect()} == {"a.csv", "z.xlsx"} and both.count() == 3
    assert files.read_extracts(spark, [], schemas.FL_HEADERS, ["inspection_number"]).count() == 0
    with pytest.raises(ValueError):
        files.read_extracts(spark, ["x.pdf"], schemas.FL_HEADERS, [])


def test_optional_tables_sidecars_and_paths(spark, tmp_path):
    assert files.optional_table(spark, str(tmp_path / "none.parquet")) is None
    (tmp_path / "m.json").write_text('{"a": 1}')
    assert files.read_sidecar(str(tmp_path / "m.json"), {"a": int}) == {"a": 1}
    with pytest.raises(ValueError, match="'b'"):
        files.read_sidecar(str(tmp_path / "m.json"), {"b": str})
    for bad in ("../x", "/x", "a\\b", "", "c:/x"):
        with pytest.raises(ValueError):
            files.safe_path(str(tmp_path), bad)


def test_one_jurisdiction_never_removes_another(spark, tmp_path):
    df = spark.createDataFrame([("nyc", 1), ("florida", 2)], "jurisdiction string, n int")
    files.write_partitioned(df, str(tmp_path / "p"), "jurisdiction")
    files.write_partitioned(df.where("n = 2").withColumn("n", F.lit(5)), str(tmp_path / "p"), "jurisdiction")
    assert {(r["jurisdiction"], r["n"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("nyc", 1), ("florida", 5)}


def test_corpus_is_loaded_whole_or_not(spark, tmp_path):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    doc = json.dumps({"jurisdiction": "nyc", "passages": [{"passage_id": "p1", "text": "wash hands", "sha256": sha(b"wash hands"), "topics": ["hands"], "permitted_uses": ["cite"]}]}).encode()
    (tmp_path / "d.json").write_bytes(doc)
    entry = {"document_id": "d", "jurisdiction": "nyc", "source_url": "https://example.gov/d", "file": "d.json", "sha256": sha(doc)}
    manifest = tmp_path / "manifest.json"
    manifest.write_text(json.dumps({"documents": [entry]}))
    outcome, passages = corpus.load(spark, str(manifest), ["example.gov"])
    assert outcome == "loaded" and passages.count() == 1
    assert corpus.load(spark, str(manifest), ["other.gov"])[0] == "invalid" and corpus.load(spark, str(tmp_path / "x.json"))[0] == "absent"
    manifest.write_text(json.dumps({"documents": [entry | {"sha256": "0"}, entry | {"file": "../d.json", "document_id": "e"}]}))
    assert {r["problem"] for r in corpus.audit(spark, str(manifest))[1].collect()} == {"document_checksum", "unreadable_file"}


def test_artifacts_are_complete_checked_and_replaced(tmp_path):
    folder = str(tmp_path / "m")
    artifacts.write_artifact(folder, {"metadata.json": {"jurisdiction": "nyc", "readiness": "ready"}})
    assert artifacts.read_metadata(folder, jurisdiction="nyc")[1] is None and artifacts.read_metadata(folder, jurisdiction="florida") == (None, "other_jurisdiction")
    with pytest.raises(FileExistsError):
        artifacts.write_artifact(folder, {})
    artifacts.write_artifact(folder, {"metadata.json": {"jurisdiction": "nyc", "readiness": "uncalibrated"}}, force=True)
    assert artifacts.read_metadata(folder, jurisdiction="nyc") == (None, "not_ready")
    (tmp_path / "m" / "metadata.json").write_text("{}")
    assert artifacts.broken_files(folder) == ["metadata.json"] and artifacts.read_metadata(folder, jurisdiction="nyc") == (None, "checksum")
    with pytest.raises(PermissionError):
        artifacts.load_model(folder, trusted=False, jurisdiction="nyc")


def test_streamed_counts_equal_the_batch(spark, rows, tmp_path):
    e, f = tmp_path / "e", tmp_path / "f"
    spark.createDataFrame([("a", 1), ("b", 1), ("b", -1)], "key string, delta int").write.parquet(str(e))
    spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "key string").write.parquet(str(f))
    q = state.keep_reference_counts(spark.readStream.schema("key string, delta int").parquet(str(e)), spark.readStream.schema("key string").parquet(str(f)), str(tmp_path / "s"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert rows(state.orphans_now(spark, str(tmp_path / "s"))) == [("b", 2), ("c", 1)]


def test_pipeline_from_extract_to_prediction(spark, tmp_path):
    raw = spark.createDataFrame([(str(40 + i % 12), f"2024-{1 + i // 20:02d}-{1 + i % 20:02d}", "Cycle Inspection / Initial Inspection", "Cited", "04L", "Mice", "Critical", str(5 + (i % 12) * 3), "A", None, "2025-01-01", f"Name {i % 12}") for i in range(240)],
                                ", ".join(f"{c} string" for c in [*schemas.NYC_REQUIRED, "dba"]))
    t = tables.build_tables(raw, None)
    files.write_tables(t, str(tmp_path))
    events, violations = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("inspection_events", "violation_events"))
    assert t["restaurants"].count() == 12
    f = tables.features(events, violations, "nyc")
    frame = f.join(events.select("inspection_id", (F.col("score") >= 20).cast("int").alias("label")), "inspection_id").where("history_depth > 0").select("inspection_id", "entity", "day", "label", "score_mean", "history_depth", "prior_citations").cache()
    columns = ["score_mean", "history_depth", "prior_citations"]
    status = tables.train(frame, columns, ["2024-01-01", "2024-07-01", "2024-10-01", "2025-01-01"], str(tmp_path / "artifact"), jurisdiction="nyc", target="score", version="1")
    assert status == "ready"
    assert artifacts.read_metadata(str(tmp_path / "artifact"), jurisdiction="nyc")[0]["model"] == "logistic"
    model = artifacts.load_model(str(tmp_path / "artifact"), trusted=True, jurisdiction="nyc")
    p = tables.score(model, events, violations, columns, jurisdiction="nyc", target="score", version="1", as_of="2025-01-01", generated_at=F.lit("2025-01-02").cast("timestamp"))
    assert p.count() == 12 and p.where("risk_band = 'insufficient_history'").count() == 0 and p.select("prediction_id").distinct().count() == 12


def test_scores_are_calibrated_and_have_the_intervals_of_the_members(spark, tmp_path):
    raw = spark.createDataFrame([(str(40 + i % 12), f"2024-{1 + i // 20:02d}-{1 + i % 20:02d}", "Cycle Inspection / Initial Inspection", "Cited", "04L", "Mice", "Critical", str(5 + (i % 12) * 3), "A", None, "2025-01-01", f"Name {i % 12}") for i in range(240)],
                                ", ".join(f"{c} string" for c in [*schemas.NYC_REQUIRED, "dba"]))
    files.write_tables(tables.build_tables(raw, None), str(tmp_path))
    events, violations = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("inspection_events", "violation_events"))
    frame = tables.features(events, violations, "nyc").join(events.select("inspection_id", (F.col("score") >= 20).cast("int").alias("label")), "inspection_id").where("history_depth > 0").select("inspection_id", "entity", "day", "label", "score_mean").cache()
    bounds, same = ["2024-01-01", "2024-07-01", "2024-10-01", "2025-01-01"], {"jurisdiction": "nyc", "target": "score", "version": "1"}
    assert tables.train(frame, ["score_mean"], bounds, str(tmp_path / "none"), members=0, **same) == "insufficient_uncertainty"
    folder = str(tmp_path / "artifact")
    assert tables.train(frame, ["score_mean"], bounds, folder, members=4, needed=3, **same) == "ready"
    trained = artifacts.load_model(folder, trusted=True, jurisdiction="nyc")
    assert (tmp_path / "artifact" / "calibration.json").exists() and trained.calibration[0] == "sigmoid" and len(trained.members) == 4 and trained.needed == 3
    one = lambda t: {r["restaurant_id"]: r for r in tables.score(t, events, violations, ["score_mean"], as_of="2025-01-01", generated_at=F.lit("2025-01-02").cast("timestamp"), **same).collect()}
    got, raw_scores = one(trained), one(models.Trained(trained.model, ("raw", None), [], 3))
    assert len(got) == 12 and all(0 <= r["lower"] <= r["probability"] <= r["upper"] <= 1 for r in got.values()) and any(r["lower"] < r["upper"] for r in got.values())
    assert all(r["lower"] is None and r["upper"] is None for r in raw_scores.values())
    b, a = trained.calibration[1].intercept, trained.calibration[1].coefficients[0]
    assert all(abs(r["probability"] - 1 / (1 + math.exp(-(a * raw_scores[k]["probability"] + b)))) < 1e-9 for k, r in got.items())
    assert any(abs(r["probability"] - raw_scores[k]["probability"]) > 1e-6 for k, r in got.items())
    rows = spark.createDataFrame([(i, i / 10, i % 2) for i in range(11)], "k int, p double, label int")
    iso = IsotonicRegression(featuresCol="probability_1", labelCol="label").fit(rows.select(F.col("p").alias("probability_1"), F.col("label").cast("double")))
    assert models.calibrated(rows, ("isotonic", iso), "p").where("calibrated IS NOT NULL").count() == 11
