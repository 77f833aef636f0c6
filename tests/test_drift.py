from datetime import date

from inspectra.operators import drift

FILES = "file_id long, feed string, snapshot_date date, delimiter string, header_line string, value string, path string"
ROWS = "file_id long, row_no int, raw_line string, path string"


def _changes(spark, files, rows):
    f = spark.createDataFrame([(i, feed, date(2024, m, 1), d, h, "x", "y") for i, feed, m, d, h in files], FILES)
    r = spark.createDataFrame([(i, n, line, "z") for i, lines in rows.items() for n, line in enumerate(lines)], ROWS)
    return {tuple(x) for x in drift.schema_changes(f, r).collect()}


def test_kinds_of_change(spark):
    files = [(1, "a", 1, ",", "CAMIS,score,Latitude,gone"), (2, "a", 2, ";", "﻿ Camis ID; score ;Latitude;SEATS"), (3, "b", 1, ",", "only,first")]
    rows = {1: ["40000001,12,40.5,x y z", '40000002,13,40.6,"q, r"', "40000003,,40.7,"], 2: ["40000001;12.0;40.5;80", "40000002;11.0;see;90", "40000004;10.0;40.8;70"]}
    assert _changes(spark, files, rows) == {
        (2, "renamed", "CAMIS", "Camis ID"), (2, "retyped", "score", "score"), (2, "retyped", "Latitude", "Latitude"), (2, "removed", "gone", ""), (2, "added", "", "SEATS")}


def test_case_only_rename_and_retype_together(spark):
    files = [(1, "a", 1, ",", "day,n"), (2, "a", 2, ",", "DAY,n")]
    rows = {1: ["01/02/2024,1", "1/3/2024,2"], 2: ["2024-02-01,1", "2024-02-02T00:00:00,2"]}
    assert _changes(spark, files, rows) == {(2, "renamed", "day", "DAY"), (2, "retyped", "day", "DAY")}


def test_same_content_under_unknown_header(spark):
    files = [(1, "a", 1, ",", "left,keyfield,right"), (2, "a", 2, ",", "left,zzz,right")]
    lines = [f"a,{7000000 + i * 37},b" for i in range(8)]
    assert _changes(spark, files, {1: lines, 2: lines}) == {(2, "renamed", "keyfield", "zzz")}


def test_order_delimiter_and_blank_columns_change_nothing(spark):
    files = [(1, "a", 1, ",", "x,y,z"), (2, "a", 2, "|", "z|x |y"), (3, "a", 3, "|", "z|x|y")]
    assert _changes(spark, files, {1: ["1,,t"], 2: ["t|1|", "u|2|"], 3: []}) == set()


def test_empty_tables(spark):
    assert _changes(spark, [], {}) == set()
    assert _changes(spark, [(1, "a", 1, ",", "x")], {}) == set()


def test_value_kinds(spark):
    values = {"12": "whole number", " -3 ": "whole number", "1.50": "decimal number", "2024-01-05": "ISO date", "2024-01-05T00:00:00": "ISO date", "1/5/2024": "slash date", "1,5": "text", "": None, "  ": None}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r[0]: r[1] for r in df.select("v", drift.value_kind(df["v"])).collect()} == values


FS, RS = "file_id long, feed string, snapshot_date date, delimiter string, header_line string", "file_id long, row_no int, raw_line string"


def _tables(f, r):
    parsed = drift.parsed_rows(f, r)
    stats = drift.path_statistics(drift.paths_of(parsed))
    types = drift.field_types(drift.column_lineage(f, drift.schema_changes(f, r, stats=stats)), stats)
    return drift.consistent_table(parsed, types), drift.consistent_rows(drift.paths_of(parsed), types)


def test_consistent_table_is_typed_and_reports_failed_casts(spark):
    f = spark.createDataFrame([(1, "a", date(2024, 1, 1), ",", "camis,score,day"), (2, "a", date(2024, 2, 1), ",", "Camis ID,score,day"), (3, "b", date(2024, 2, 1), ";", "extra;CAMIS")], FS)
    lines = {1: ["40000001,12,1/2/2024", "40000002,abc,1/3/2024", "40000003,7,"], 2: ["40000001,9,2024-02-01", "40000002,8,2024-02-02"], 3: ["x;40000009"]}
    r = spark.createDataFrame([(i, n, x) for i, xs in lines.items() for n, x in enumerate(xs)], RS)
    wide, long = _tables(f, r)
    assert dict(wide.dtypes) == {"file_id": "bigint", "row_no": "int", "camis": "double", "score": "double", "day": "date", "extra": "string"}
    got = {(x["file_id"], x["row_no"]): (x["camis"], x["score"], x["day"], x["extra"]) for x in wide.collect()}
    assert got == {
        (1, 0): (40000001.0, 12.0, date(2024, 1, 2), None), (1, 1): (40000002.0, None, date(2024, 1, 3), None), (1, 2): (40000003.0, 7.0, None, None),
        (2, 0): (40000001.0, 9.0, date(2024, 2, 1), None), (2, 1): (40000002.0, 8.0, date(2024, 2, 2), None), (3, 0): (40000009.0, None, None, "x")}
    assert [tuple(x) for x in drift.failed_casts(long).collect()] == [(1, "score", 3, 1)]


def test_any_number_of_delimiters_and_quotes(spark):
    signs = ["||", "\\", "]", "^", "-", ".", "*", "a", " "] + [chr(0x2500 + i) for i in range(70)]
    f = spark.createDataFrame([(i, f"f{i}", date(2024, 1, 1), d, f"h1{d}h2{d}h3") for i, d in enumerate(signs) if d not in "h"], FS)
    r = spark.createDataFrame([(i, 0, f'x{d}"1{d}2 ""q"""{d}') for i, d in enumerate(signs)], RS)
    got = {(x["file_id"], x["path"]): x["value"] for x in drift.load_paths(f, r).collect()}
    assert got == {(i, h): v for i, d in enumerate(signs) for h, v in (("h1", "x"), ("h2", f'1{d}2 "q"'), ("h3", None))}


def test_headers_are_learnt_from_other_transitions(spark):
    """A rename whose data say nothing is told from the same rename in other feeds; planted cases, found at 0.9 or more."""
    files, rows, truth = [], {}, set()
    ids = lambda k: [str(7_000_000 + 13 * i + k) for i in range(12)]
    for k in range(20):
        a, b = 2 * k + 1, 2 * k + 2
        files += [(a, f"f{k}", 1, ",", "left,keyfield,other"), (b, f"f{k}", 2, ",", "left,zzz,other" if k % 2 else "zzz,left,other")]
        rows[a] = [f"a,{v},b" for v in ids(0)]
        rows[b] = [f"a,{v},b" for v in ids(0)] if k % 2 else [f"LT-{v[:3]} of {v[3:]},a,b" for v in ids(5)]
        truth.add((b, "renamed", "keyfield", "zzz"))
    got = {x for x in _changes(spark, files, rows) if x[1] == "renamed"}
    assert len(got & truth) >= 0.9 * len(truth) and got <= truth


def test_cells_without_a_header_are_kept_by_position(spark):
    f = spark.createDataFrame([(1, "a", date(2024, 1, 1), ",", "camis,,score")], "file_id long, feed string, snapshot_date date, delimiter string, header_line string")
    r = spark.createDataFrame([(1, 0, '40000001,x,12,5,"p, q"'), (1, 1, "40000002,,7,abc"), (1, 2, "40000003,z,8,6"), (1, 3, "40000004")], "file_id long, row_no int, raw_line string")
    paths = drift.load_paths(f, r)
    got = {(x["row_no"], x["path"]): x["value"] for x in paths.collect()}
    assert got == {
        (0, "camis"): "40000001", (0, "column 2"): "x", (0, "score"): "12", (0, "column 4"): "5", (0, "column 5"): "p, q", (1, "camis"): "40000002", (1, "column 2"): None, (1, "score"): "7", (1, "column 4"): "abc",
        (2, "camis"): "40000003", (2, "column 2"): "z", (2, "score"): "8", (2, "column 4"): "6", (3, "camis"): "40000004", (3, "column 2"): None, (3, "score"): None}
    _, long = _tables(f, r)
    assert {x["field"] for x in long.collect()} == {"camis", "column_2", "score", "column_4", "column_5"}
    assert [tuple(x) for x in drift.failed_casts(long).collect()] == [(1, "column_4", 3, 1)]


def test_a_blank_header_cell_moves_no_column(spark):
    files = [(1, "a", 1, ",", "a,,c"), (2, "a", 2, ",", "a,,c")]
    assert _changes(spark, files, {1: ["1,2,3"], 2: ["1,x,3"]}) == set()
    f = spark.createDataFrame([(1, "a", date(2024, 1, 1), ",", "a,,c")], FS)
    assert [(x["path"], x["value"]) for x in drift.load_paths(f, spark.createDataFrame([(1, 0, "1,2,3")], RS)).orderBy("position").collect()] == [("a", "1"), ("column 2", "2"), ("c", "3")]
