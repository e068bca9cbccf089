"""Documents, sources and sinks by hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from gradus.functions import text as T
from gradus.operators import documents as D
from gradus.sources import files

ELEMENT = "document string, page long, kind string, element_id string, order_index long, payload map<string,string>"


def test_pages_as_text(spark):
    cells = [{"row_index": 0, "column_index": 0, "text": " a "}, {"row_index": 1, "column_index": 1, "text": "b"}]
    rows = [
        ("d", 1, "text", "t1", 2, {"raw_text": " first "}),
        ("d", 1, "text", "t2", None, {"raw_text": "", "normalized_text": "last"}),
        ("d", 1, "text", "t0", 1, {"raw_text": "  "}),
        ("d", 1, "table", "b1", None, {"caption": "Cap", "rows": "2", "columns": "1", "cells": json.dumps(cells)}),
        ("d", 1, "table", "b2", 9, {"cells": "[]"}),
        ("d", 2, "formula", "f", 1, {}),
        ("d", 2, "image", "i", 2, {"caption": "sky"}),
        ("d", 2, "diagram", "g", 3, {}),
        ("d", 2, "chemical", "c", 4, {"text_labels": '["x", "y"]'}),
    ]
    pages = spark.createDataFrame([("d", 2, []), ("d", 1, ["b1", "none", "b1"]), ("d", 3, None)], "document string, page long, reading_order array<string>")
    got = D.render(spark.createDataFrame(rows, ELEMENT), pages).collect()
    one = "--- Page 1 ---\nCap\na\n\tb\n\nfirst\n\n[TABLE]\n\nlast"
    assert [tuple(r) for r in got] == [("d", one + "\n\n--- Page 2 ---\n[FORMULA]\n\n[IMAGE: sky]\n\n[DIAGRAM]\n\nx y\n\n--- Page 3 ---\n")]


def test_comparable_texts(spark):
    rows = [
        ("text", {"text": "a  “b”"}, 'a "b"'),
        ("math_formula", {"latex": "x ^ 2"}, T.latex_form("x ^ 2")),
        ("chemical_formula", {"raw_formula": "H 2 O"}, "H2O"),
        ("table", {"cells": '[{"text": "a"}, {"text": "b", "normalized_text": "c"}]'}, "a c"),
        ("image", {"text": "x"}, ""),
        ("table", {}, ""),
    ]
    df = spark.createDataFrame(rows, "object_type string, payload map<string,string>, want string")
    assert all(r.got == r.want for r in df.select("want", D.comparable(F.col("object_type"), F.col("payload")).alias("got")).collect())
    p = spark.createDataFrame([("math_formula", {"latex": "y", "normalized_latex": "z z"})], "t string, p map<string,string>")
    assert p.select(D.comparable(F.col("t"), F.col("p"), predicted=True)).first()[0] == "z z"


def test_evaluations_must_equal_the_official_ones(spark):
    make = lambda score, matched: spark.createDataFrame([(1, score, matched)], "id long, score double, matched boolean")
    a = make(50.0, True)
    assert D.match_evaluation(a.drop("matched"), a.drop("score"), make(50.0 + 1e-9, True), ["id"]).first().score == 50.0
    for other in (make(50.1, True), make(50.0, False), a.limit(0)):
        with pytest.raises(Exception, match="official"):
            D.match_evaluation(a.drop("matched"), a.drop("score"), other, ["id"]).collect()


def test_flat_texts(spark):
    values = [{"text": " a\n b", "x": "no"}, {"x": "yes", "y": [1, None, {"caption": "c"}]}, "s", 1.5, None, []]
    df = spark.createDataFrame([(json.dumps(v),) for v in values] + [(None,)], "j string")
    assert [r[0] for r in df.select(T.flatten_text(F.col("j"))).collect()] == ["a b", "yes 1 c", "s", "1.5", "", "", None]


def test_whole_json_files(spark, tmp_path):
    o = {"object_id": "a", "document_id": "d", "page": 1, "object_type": "text", "reference": {"text": "t", "cells": [{"row": 1}]}}
    for name, v in {"list": [o, o | {"object_id": "b"}], "objects": {"objects": [o | {"object_id": "c"}]}, "one": o | {"object_id": "e"}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(v, indent=1))
    rows = files.read_payload(spark, str(tmp_path)).collect()
    assert sorted(r.object_id for r in rows) == ["a", "b", "c", "e"] and rows[0].reference["cells"] == '[{"row":1}]'
    (tmp_path / "bad.json").write_text('{"x": 1}')
    with pytest.raises(Exception, match="no objects"):
        files.read_payload(spark, str(tmp_path / "bad.json")).collect()
    assert files.read_manifest(spark, str(tmp_path / "bad.json")).count() == 0
    assert files.read_manifest(spark, str(tmp_path / "objects.json")).count() == 1


def test_clean_dataset(spark, tmp_path):
    tools = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "tool string, score double")
    issues = spark.createDataFrame([("error", "c", "x"), ("warning", "c", "y")], "severity string, code string, tool string")
    files.write_clean(tools, tools, tools, issues, 2, str(tmp_path))
    assert [r.tool for r in files.read_table(spark, f"{tmp_path}/clean_results_dataset.csv").collect()] == ["y"]
    s = spark.read.json(f"{tmp_path}/data_quality_summary.json").first()
    assert (s.raw_tool_rows, s.clean_tool_rows, s.error_count, s.warning_count, s.excluded_tools, s.clean_tools, s.status) == (2, 1, 1, 1, ["x"], ["y"], "needs_attention")


def test_formulas_without_doubles(spark):
    box, inner, far = (0.0, 0.0, 0.5, 0.1), (0.0, 0.0, 0.2, 0.1), (0.0, 0.5, 0.2, 0.6)
    rows = [(1, "a", "C2H6O", box), (1, "b", "C2H6", inner), (1, "b", "H2O", inner), (1, "b", "C2H6", far), (1, "c", "CO2", None), (1, "c", "CO2", None), (1, "d", "CO2", None), (2, "a", "C2H6O", box)]
    df = spark.createDataFrame(rows, "page long, source string, formula string, box struct<x0: double, y0: double, x1: double, y1: double>")
    got = [(r.page, r.source, r.formula, r.box and tuple(r.box)) for r in D.distinct_formulas(df, ["page"]).collect()]
    want = [rows[0], rows[2], rows[3], rows[4], rows[6], rows[7]]
    assert sorted(got, key=repr) == sorted(want, key=repr)
