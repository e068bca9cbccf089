"""Boxes, regions, rows, detectors and texts by hand-made cases and plain versions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions import boxes as B
from gradus.functions import detect
from gradus.functions import text as T
from gradus.operators import regions as R
from gradus.operators import runs, stats
from gradus.plans import registry
from gradus.sources import tables

SF = "/root/testdata/sf0.001"
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_boxes(spark):
    b = lambda *v: B.box(*map(F.lit, v))
    r = one(
        spark,
        n=B.normalize(F.lit(80), F.lit(10), F.lit(20), F.lit(60), F.lit(100), F.lit(200), bottom_left=True),
        wide=B.normalize(F.lit(-5), F.lit(0), F.lit(500), F.lit(60), F.lit(100), F.lit(200)),
        none=B.normalize(F.lit(1), F.lit(1), F.lit(2), F.lit(2), F.lit(0), F.lit(10)),
        poly=B.of_points(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10, 20), (30, 10), (20, 40))]), F.lit(100), F.lit(100)),
        i=B.intersection(b(0, 0, 0.5, 0.5), b(0.25, 0.25, 1, 1)),
        apart=B.intersection(b(0, 0, 0.5, 0.5), b(0.5, 0, 1, 1)),
        more=B.extends(b(0, 0, 1, 1), b(0, 0, 0.5, 0.5), b(0.4, 0.4, 0.6, 0.6)),
        less=B.extends(b(0, 0, 0.5, 0.5), b(0, 0, 0.5, 0.5), b(0.4, 0.4, 0.6, 0.6)),
    )
    assert tuple(r.n) == pytest.approx((0.2, 0.7, 0.8, 0.95)) and tuple(r.wide) == pytest.approx((0, 0, 1, 0.3)) and r.none is None
    assert tuple(r.poly) == pytest.approx((0.1, 0.1, 0.3, 0.4)) and tuple(r.i) == (0.25, 0.25, 0.5, 0.5)
    assert r.apart is None and r.more and not r.less


def test_match_document(spark):
    region, line = (0.0, 0.0, 1.0, 0.4), lambda k: (0.0, 0.1 * k, 1.0, 0.1 * k + (0.08 if k else 0.09))
    truth = spark.createDataFrame(
        [(1, "text", 1, region, "a b c"), (1, "text", 2, (0.0, 0.6, 1.0, 0.7), "far"), (1, "image", 3, (0.0, 0.8, 0.5, 1.0), None), (1, "text", 4, None, "told in words"), (1, "image", 5, None, None)],
        f"page long, object_type string, gt_id long, box {BOX}, text string",
    )
    found = spark.createDataFrame(
        [(1, "text", 10 + k, line(k), f"line {k}", 9 - k, None) for k in range(4)]
        + [(1, "text", 20, line(2), "line 2", 1, None), (1, "text", 21, (0.0, 0.61, 1.0, 0.7), "far", None, 1), (1, "image", 30, (0.0, 0.8, 0.5, 0.95), None, None, None), (1, "text", 40, None, "told in wards", None, None), (1, "image", 50, None, None, None, None)],
        f"page long, object_type string, cand_id long, box {BOX}, text string, position int, order_index int",
    )
    got = {r.gt_id: r for r in R.match_document(truth, found, ["page", "object_type"]).collect()}
    assert len(got) == 5
    whole = got[1]
    assert whole.matched and whole.method == "text_multiblock" and whole.cand_id is None
    assert whole.text.split("\n") == ["line 2", "line 3", "line 1", "line 0"] and whole.source_ids == [20, 13, 11, 10]
    assert (got[2].cand_id, got[2].method, got[3].cand_id) == (21, "bbox_iou", 30)
    assert (got[4].cand_id, got[4].method) == (40, "content_similarity") and got[4].score == pytest.approx(1 - 1 / 13)
    assert not got[5].matched and got[5].score == 0.0 and got[5].source_ids is None


def test_match_document_over_a_table(spark):
    rows = registry.QUERIES["match_document"](spark, SF).collect()
    assert len({r.gt_id for r in rows}) == len(rows) == 100
    used = [c for r in rows for c in (r.source_ids or [])]
    assert len(used) == len(set(used)) and {r.method for r in rows if r.matched} >= {"bbox_iou"}
    assert all(r.matched == (r.source_ids is not None) for r in rows)


def plain_rows(blocks, nearest):
    rows, out = [], {}
    for i, (y, h) in blocks:
        best = None
        for k in range(len(rows) - 1, -1, -1) if nearest else range(max(0, len(rows) - 4), len(rows)):
            mean, tall = sum(rows[k][0]) / len(rows[k][0]), max(rows[k][1])
            if nearest and y - mean > 0.05:
                break
            limit = 0.8 * max(h, tall) if nearest else max(0.006, 0.55 * max(h, tall))
            if abs(y - mean) <= limit and (best is None or nearest and abs(y - mean) < best[0]):
                best = (abs(y - mean), k)
        if best is None:
            rows.append(([], []))
            best = (0, len(rows) - 1)
        rows[best[1]][0].append(y), rows[best[1]][1].append(h)
        out[i] = best[1]
    return out


def test_rows_of_fragments(spark):
    rng = random.Random(2)
    frags = [(i % 3, i, rng.random(), rng.choice([0.1, 0.2, 0.21, 0.4, 0.43]) + rng.random() / 100, rng.choice([0.01, 0.03])) for i in range(120)]
    df = spark.createDataFrame([(p, i, (x, y, x + 0.05, y + h)) for p, i, x, y, h in frags], f"page long, element_id long, box {BOX}")
    for f, nearest in ((R.line_rows, True), (R.layout_rows, False)):
        got = {r.element_id: r.line for r in f(df, ["page"]).collect()}
        for page in range(3):
            own = sorted(((2 * y + h) / 2, x, i, h) for p, i, x, y, h in frags if p == page)
            want = plain_rows([(i, (c, h)) for c, _, i, h in own], nearest)
            assert {i: got[i] for i in want} == want
    g = R.gap_groups(spark.createDataFrame([(1, i, (x, 0.0, x + 0.1, 0.1)) for i, x in enumerate([0.0, 0.1, 0.13, 0.3, 0.41])], f"page long, element_id long, box {BOX}"), ["page"])
    assert [r.grp for r in g.orderBy("element_id").collect()] == [1, 1, 2, 3, 3]


def test_detectors():
    read = lambda t: [(f["latex"], f["wrapper"], f["numbered"]) for f in detect.delimited_math(t)]
    assert read("So $x$ is.\n$y = 1$ (12).\n\\[ z \\]\n$$a\n+b$$ \\(q\\) and $5\\$ $") == [("y = 1", "single", True), ("z", "bracket", False), ("a\n+b", "double", False)]
    assert read("$5 apples\n$x=1$") == [("x=1", "single", False)] and read("$y = 2$, (3)") == [("y = 2", "single", True)]
    assert read("$$a \\eqno (4)$$ $$b\\tag {5}$$") == [("a \\eqno (4)", "double", True), ("b\\tag {5}", "double", True)]
    assert read("\\(q\\) (1).\n, \\(r\\)\nso \\(s\\)") == [("q", "paren", True), ("r", "paren", False)] and read("$$$a$$") == [("$a", "double", False)]
    assert read("$a$$b$") == [] and read("\\[ a $$ b") == [] and read("$x$ (1234)") == []
    assert [[f["latex"] for f in r] for r in detect.numbered_runs("$$a$$\n$$b$$ (2)\ntext\n$$c$$")] == [["a", "b"]]
    assert detect.delimited_math(None) == [] and detect.delimited_math("$$ $$") == []
    only = lambda t: detect.formula_only(t, detect.delimited_math(t))
    assert only("$$a$$ \\[b\\], (3)") and not only("$$a$$ and $$b$$") and only(" ")


def test_formulas_in_texts():
    formulas = lambda t: [f["formula"] for f in detect.linear_formulas(t)]
    assert formulas("H2O and Fe₃O₄, then CuSO4·5H2O, NaHCO3.") == ["H2O", "Fe₃O₄", "CuSO4·5H2O", "NaHCO3"]
    assert formulas("Fe 3 O 4; H<sub>2</sub>O; \\mathrm{H_2O}; \\ce{\\text{CO_2}}; C&#50;H6") == ["Fe 3 O 4", "H2O", "H2O", "CO2", "C2H6"]
    assert formulas("in (H2SO4) we; (NH4)2SO4; C6H12 - 2CH3; 2 H2O; K4[Fe") == ["(H2SO4)", "(NH4)2SO4", "C6H12 - 2CH3", "2 H2O"]
    for label in ("U2", "A1BC", "3CD", "NaCl", "Xy2", "H2", "C100H2", "Fe0O", "КС1", "word2", "it4", "U₁₁ B", "xH2O", "H2Ox", "H2O_", "(H2O"):
        assert formulas(label) in ([], ["H2O"][: label == "(H2O"]), label
    assert formulas("Н2О") == ["Н2О"] and formulas("3CO2") == ["3CO2"] and formulas(None) == []
    for t in ("in (H2SO4) we", "a  Fe 2 O 3 b"):
        for f in detect.linear_formulas(t):
            assert t[f["start"] : f["end"]] == f["formula"]
    assert len(detect.linear_formulas("H2O, " * 20_000)) == 20_000 and detect.linear_formulas("C" * 50_000) == []


def test_texts(spark):
    assert T.dehyphenated("multi-\nlevel well-\nknown", frozenset(["multilevel"])) == "multilevel well-\nknown"
    assert T.segments_of("a b\r\n \nccc ddd eee fff\n\n" + "x" * 25, 10) == ["a b", "ccc ddd", "eee fff", "x" * 10, "x" * 10, "x" * 5]
    names = {None: "document.pdf", "C:\\a\\b?.PDF": "b_.PDF", "con.pdf": "document_con.pdf", "  ": "document.pdf", "x/y": "y.pdf", "ﬁ\tx": "fi_x.pdf"}
    assert {k: T.filename_of(k) for k in names} == names
    assert T.latex_form(r"\frac1{23}") == r"\frac{1}{23}" and T.latex_form(r"x_\alpha y") == r"x_{\alpha}y" and T.latex_form(r"\frac{a}b") == r"\frac{a}{b}"
    for s in (r"\frac1{23}", r"x_\alpha y", r"\frac\alpha2", r"a^\beta_1"):
        assert T.latex_form(T.latex_form(s)) == T.latex_form(s)
    cell = lambda r, c, t: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit(False).alias("header"), F.lit(t).alias("text"))
    r = one(spark, m=T.table_matrix(F.lit(2), F.lit(2), F.array(cell(0, 0, "a"), cell(1, 1, "d"))), s=T.norm_cells(F.array(cell(1, 0, "b"), cell(0, 1, "a"))), q=T.seq_ratio(F.lit("abcd"), F.lit("bcde")))
    assert r.m == [["a", None], [None, "d"]] and [c.text for c in r.s] == ["a", "b"] and r.q == 0.75


def test_pipe_tables():
    assert tables.split_row("a \\\\| b \\| c") == ["a \\\\", "b | c"]
    text = "x\n|a|b|\n|---|:---:|\n|1|\n\nc | d | e\n--- | ---\n| q |\n|---|\n| r | s |"
    assert [[c[5] for c in t] for t in tables.all_markdown_cells(text)] == [["a", "b", "1", ""], ["q", "", "r", "s"]]
    assert tables.loose_markdown_cells("none") is None and len(tables.loose_markdown_cells(text)) == 15
    assert [c[5] for c in tables.csv_cells('\ufeffa,"b,c"\n1\n')] == ["a", "b,c", "1", ""]
    assert tables.text_of("<p>a<b>b</b> &amp;</p> c") == "a b & c" and tables.text_of(None) is None


def test_pareto_in_ranges_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(40)), float(rng.randrange(300))) for i in range(900)] + [(1000, None, 1.0), (1001, 5.0, None)]
    df = spark.createDataFrame(rows, "id long, q double, c double")
    want = {i for i, q, c in rows if None not in (q, c) and not any(None not in (p, d) and p >= q and d <= c and (p > q or d < c) for _, p, d in rows)}
    for ranges in (1, 2, 64):
        assert {r.id for r in stats.pareto(df, "q", "c", ranges=ranges).collect()} == want


def test_paired_bootstrap_and_integrity(spark):
    df = spark.createDataFrame([("a", i, float(i), float(i) - 2.0) for i in range(5)] + [("b", 1, 3.0, 1.0)], "g string, k long, x double, y double")
    got = {r.g: r for r in stats.paired_bootstrap(df, ["g"], "k", "x", "y", draws=50).collect()}
    assert got["a"].delta == got["a"].ci_low == got["a"].ci_high == 2.0 and (got["b"].delta, got["b"].ci_low, got["b"].n) == (2.0, None, 1)
    codes = {r.code for r in registry.QUERIES["run_integrity"](spark, SF).select("code").distinct().collect()}
    assert codes >= {"run_not_successful", "object_count_mismatch", "score_out_of_range", "object_missing", "object_unexpected"}
    with pytest.raises(Exception, match="unknown id: 7"):
        runs.selected(spark.createDataFrame([(1,)], "id long"), "id", [1, 7]).collect()
    assert [r.id for r in runs.selected(spark.createDataFrame([(1,), (2,)], "id long"), "id", [2]).collect()] == [2]
    assert json.dumps(np.arange(2).tolist()) == "[0, 1]"
