"""Object scores against a plain version, and against SQL (test_oracles)."""

import math
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradus.functions import scoring as S
from gradus.functions import text as T
from gradus.plans import registry, scored

SF = "/root/testdata/sf0.001"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    return 1.0 if not a and not b else 1 - edits(a, b) / max(len(a), len(b))


def f1(a, b):
    if not a and not b:
        return 1.0
    both = (Counter(a) & Counter(b)).total()
    return 2 * both / (len(a) + len(b)) if both else 0.0


def iou(a, b):
    w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    both = max(0, w) * max(0, h)
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return both / (area(a) + area(b) - both)


def mean(pairs):
    held = [(w, v) for w, v in pairs if v is not None]
    return sum(w * v for w, v in held) / sum(w for w, _ in held)


def caption(r, p):
    return None if r["caption"] is None else (f1(r["caption"].split(), (p["caption"] or "").split() if p else []) + alike(r["caption"], (p["caption"] or "") if p else "")) / 2


def order(a, b):
    if not a:
        return float(not b)
    at = [b.index(x) for x in a if x in b]
    pairs = [(i, j) for k, i in enumerate(at) for j in at[k + 1 :]]
    return len(at) / len(a) * (sum(i < j for i, j in pairs) / len(pairs) if pairs else 1)


def brute(kind, r, p, c):
    """Score of one object of 0 to 1, with a prediction."""
    found = 1.0
    if c["tp"] is not None and c["policy"] in (None, "exhaustive_page_f1_v1"):
        n = 2 * c["tp"] + c["fp"] + c["fn"]
        found = 2 * c["tp"] / n if n else 1.0
    if kind == "text":
        rate = lambda a, b: max(0.0, 1 - edits(a, b) / len(a))
        return mean([(0.4, rate(r["text"], p["text"])), (0.3, rate(r["text"].split(), p["text"].split())), (0.1, alike(r["text"], p["text"])), (0.2, order(r["reading_order"], p["reading_order"]))])
    if kind == "table":
        place = lambda x: (x["row"], x["col"], x["rowspan"], x["colspan"])
        a, b = {place(x): x["text"] for x in r["cells"]}, {place(x): x["text"] for x in p["cells"]}
        merged = lambda t: [k for k in t if k[2] > 1 or k[3] > 1]
        line = lambda t: ["T"] + [x for row in range(t["rows"]) for x in ["R", *(y for c in sorted((c for c in t["cells"] if c["row"] == row), key=place) for y in ((c["header"], *place(c)[1:]), c["text"], ("e", c["header"]))), "/R"]] + ["/T"]
        return 0.3 * f1(list(a), list(b)) + 0.25 * sum(alike(t, b.get(k, "")) for k, t in a.items()) / len(a) + 0.2 * (1 + 1 + f1(merged(a), merged(b))) / 3 + 0.25 * alike(line(r), line(p))
    if kind == "math_formula":
        a, b = T.latex_form(r["latex"]), T.latex_form(p["latex"])
        import re

        tokens = re.compile(r"\\[A-Za-z]+|\\[^A-Za-z\s]|[A-Za-z]+|\d+(?:\.\d+)?|[{}\[\]()]|[^\s\w]").findall
        return 0.05 * (r["latex"] == p["latex"]) + 0.35 * (a == b) + 0.4 * f1(tokens(a), tokens(b)) + 0.2 * alike(a, b)
    if kind == "chemical_formula":
        import re

        a, b = (x["formula"].replace("₄", "4") for x in (r, p))
        tokens = re.compile(r"[A-Z][a-z]?|\d+|\^|[+-]|[()\[\]{}]|·|[a-z]+|\S").findall
        x, y = T.composition_of(a), T.composition_of(b)
        gap = sum(abs(x.get(k, 0) - y.get(k, 0)) for k in x | y)
        return 0.35 * (a == b) + 0.3 * f1(tokens(a), tokens(b)) + 0.2 * alike(a, b) + 0.15 * (1 - gap / (sum(x.values()) + sum(y.values())))
    if kind == "chemical_structure":
        return 0.3 + 0.25 * iou(r["box"], p["box"]) + 0.25 * f1(" ".join(r["labels"]).split(), " ".join(p["labels"]).split()) + 0.2 * p["extracted"]
    if kind == "image":
        return mean([(0.3, found), (0.25, iou(r["box"], p["box"])), (0.25, float(p["extracted"])), (0.2, caption(r, p))])
    key = [(Counter(r["key_elements"]) & Counter(p["key_elements"])).total() / len(r["key_elements"])] if r["key_elements"] else []
    key += [1 - abs(r["subfigures"] - p["subfigures"]) / max(r["subfigures"], p["subfigures"], 1)] if r["subfigures"] else []
    return mean([(0.2, found), (0.15, iou(r["box"], p["box"])), (0.25, f1(" ".join(r["text_elements"]).split(), " ".join(p["text_elements"]).split())), (0.15, caption(r, p)), (0.25, sum(key) / len(key) if key else None)])


def test_evaluate_object_equals_the_plain_version(spark):
    rows = {r.object_id: r.asDict(recursive=True) for r in scored.matches(spark, SF).collect()}
    got = registry.QUERIES["evaluate_object"](spark, SF).collect()
    assert len(got) == len(rows)
    kinds = set()
    for g in got:
        m = rows[g.object_id]
        assert (g.category, g.subtype) == S.KINDS[m["object_type"]] and g.matched == (m["prediction"] is not None)
        want = 100 * brute(m["object_type"], m["reference"], m["prediction"], m["context"]) if g.matched else 0.0
        assert g.object_score == pytest.approx(want, abs=2e-6), m
        kinds.add((m["object_type"], g.matched))
    assert len(kinds) == 14


def test_metric_rows(spark):
    out = registry.QUERIES["metric_rows"](spark, SF)
    rows = out.collect()
    names = {r.metric_name for r in rows}
    assert {"cer", "wer", "cell_f1", "teds_like", "label_f1", "detection_f1", "detection_recall", "caption", "structured_extraction"} <= names
    assert not any(n.endswith("_score") for n in names)
    for r in rows:
        rate = r.metric_name in ("cer", "wer")
        assert r.higher_is_better != rate and 0 <= r.metric_value <= 100
        assert r.metric_value == pytest.approx(100 * (max(0, 1 - r.raw_value) if rate else min(1, max(0, r.raw_value))), abs=1e-4)


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_reading_order(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    for a, b, want in (("abcd", "abcd", (1, 1, 1)), ("abcd", "dcb", (0.75, 0, 0)), ("abc", "xa", (1 / 3, 1, 1 / 3)), ("", "", (1, 1, 1)), ("", "a", (0, 1, 0)), ("abc", "bac", (1, 2 / 3, 2 / 3))):
        assert tuple(one(spark, x=S.reading_order(arr(*a), arr(*b))).x) == pytest.approx(want)
    assert one(spark, x=S.reading_order(F.lit(None).cast("array<string>"), arr("a"))).x is None
    with pytest.raises(Exception, match="twice"):
        one(spark, x=S.reading_order(arr("a", "a"), arr("a")))


def test_one_table_cell_twice_fails(spark):
    cells = F.array(*[F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit(False).alias("header"), F.lit("a").alias("text"))] * 2)
    with pytest.raises(Exception, match="two table cells"):
        one(spark, s=S.table_parts(F.lit(1), F.lit(1), cells, F.lit(1), F.lit(1), cells)["table_score"])


def test_text_form_equals_the_column(spark):
    texts = ["a  b\n\nc", "“x” ‘y’­ z", "word-\nnext", "3-\n4", "﻿q r​\x07s\r\nt", "é", "", "a‑b―c", " lead and trail \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.norm_text(F.col("t"), paragraphs=False).alias("n")).collect():
        assert T.text_form(r.t) == (r.n or "").strip()
    assert T.text_form(None) == "" and T.text_form("é") == unicodedata.normalize("NFC", "é")
    assert not math.isnan(0.0)
