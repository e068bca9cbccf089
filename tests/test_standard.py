"""Standardized documents with bad ones among them, layout trees against a plain version, structures in Markdown images."""

import collections
import json

import pytest

from gradus.plans import standard as plans
from gradus.sources import layouts as L
from gradus.sources import standard as S


def document(**changes):
    page = {"page_number": 1, "width": 10, "height": 20, "reading_order": ["a"], "text_blocks": [{"element_id": "a", "page_number": 1, "raw_text": "x", "block_type": "heading", "bbox": {"x_min": 0, "y_min": 0, "x_max": 1, "y_max": 1}, "provenance": {"k": 1}}]}
    page["tables"] = [{"element_id": "t", "page_number": 1, "rows": 1, "columns": 1, "caption": {"text": "cap"}, "cells": [{"row_index": 0, "column_index": 0, "text": "c"}]}]
    page["chemical_objects"] = [{"element_id": "c", "page_number": 1, "subtype": "structure", "text_labels": ["N"]}]
    d = {"document_id": "d", "source_pdf": "p", "tool": {"tool_name": "t", "distribution_name": "x"}, "pages": [page]}
    for path, value in changes.items():
        at, *keys = path.split("__")
        node = d
        for k in [at, *keys][:-1]:
            node = node[int(k)] if k.isdigit() else node[k]
        last = [at, *keys][-1]
        if value is KeyError:
            del node[last]
        else:
            node[last] = value
    return json.dumps(d)


CASES = {
    "good": document(), "empty": document(pages=[]), "no_pages": document(pages=KeyError), "extra": document(other=[1]), "cut": document()[:-5], "list": "[]", "blank": "", "words": "no json",
    "name": document(document_id=KeyError), "tool": document(tool__tool_name=None), "number": document(pages__0__page_number=0), "size": document(pages__0__height=0), "wide": document(pages__0__width="wide"),
    "id": document(pages__0__text_blocks__0__element_id=KeyError), "box": document(pages__0__text_blocks__0__bbox__x_max=1.2), "side": document(pages__0__text_blocks__0__bbox__x_max=None), "sure": document(pages__0__text_blocks__0__confidence=2),
    "choice": document(pages__0__text_blocks__0__block_type="poem"), "subtype": document(pages__0__chemical_objects__0__subtype=KeyError), "cell": document(pages__0__tables__0__cells__0__row_index=-1), "span": document(pages__0__tables__0__cells__0__row_span=0), "cellbox": document(pages__0__tables__0__cells__0__bbox={"x_min": 0, "y_min": 0, "x_max": 3, "y_max": 1}),
}
WHY = {
    "cut": "not a document's JSON", "list": "not a document's JSON", "blank": "not a document's JSON", "words": "not a document's JSON", "wide": "not a document's JSON", "name": "a name is missing", "tool": "a name is missing", "number": "a page without number or size", "size": "a page without number or size",
    "id": "an element without id or page", "box": "a box outside its page", "side": "a box outside its page", "cellbox": "a box outside its page", "sure": "a confidence outside 0 to 1", "choice": "an unknown choice", "subtype": "an unknown choice", "cell": "a cell without place", "span": "a cell without place",
}


def test_bad_documents_are_set_aside(spark, tmp_path):
    for name, text in CASES.items():
        (tmp_path / "in" / name[:1]).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name[:1] / f"{name}.json").write_text(text)
    parsed = S.read_standardized(spark, f"file://{tmp_path}/in").cache()
    reasons = collections.defaultdict(set)
    for r in S.issues(parsed).collect():
        reasons[r.name.rsplit("/", 1)[1][:-5]].add(r.reason)
    assert set(reasons) == set(WHY) - {"blank"} | ({"blank"} & set(reasons)) and all(WHY[k] in v for k, v in reasons.items())
    assert S.good(parsed).count() == 4
    e = {(r.document, r.kind): r for r in S.elements(S.good(parsed)).collect()}
    assert e["d", "text"].payload["raw_text"] == "x" and tuple(e["d", "text"].box) == (0, 0, 1, 1) and e["d", "table"].payload["caption"] == "cap"
    assert json.loads(e["d", "table"].payload["cells"])[0]["text"] == "c" and e["d", "chemical"].payload["text_labels"] == '["N"]' and e["d", "chemical"].box is None
    assert [tuple(r)[1:4] for r in S.pages(S.good(parsed)).distinct().collect()] == [(1, 10.0, 20.0)]


def test_a_text_is_parsed_once(spark):
    """Once for the reasons and once for the elements, though rules and filters read it many times."""
    plan = plans.src_std(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2


def plain(blocks):
    """(kept, parent) of each block by the rules of `hierarchy`."""
    tidy = lambda t: " ".join(str(t or "").split())
    parents = {}
    if any("parent_text_index" in b for b in blocks):
        parents = {i: int(b["parent_text_index"]) for i, b in enumerate(blocks) if b.get("parent_text_index") is not None}
    else:
        for i, b in enumerate(blocks):
            whole = tidy(b.get("text"))
            if not b.get("layout_type", "").startswith("LTTextBox") or not whole or not b.get("bbox"):
                continue
            so_far = []
            for j in range(i + 1, len(blocks)):
                c = blocks[j]
                inside = c.get("layout_type", "").startswith("LTTextLine") and c.get("bbox") and all(p <= q + 1e-8 for p, q in zip(b["bbox"][:2], c["bbox"][:2])) and all(p >= q - 1e-8 for p, q in zip(b["bbox"][2:], c["bbox"][2:]))
                if not inside:
                    break
                so_far.append(c.get("text", ""))
                if tidy(" ".join(so_far)) == whole:
                    parents |= {k: i for k in range(i + 1, j + 1)}
                    break
    below = collections.defaultdict(list)
    for child in sorted(parents):
        below[parents[child]].append(blocks[child].get("text", ""))
    return [(bool(tidy(b.get("text"))) and not (i in below and tidy(" ".join(below[i])) == tidy(b.get("text"))), parents.get(i)) for i, b in enumerate(blocks)]


def line(text, y=10, **more):
    return {"text": text, "bbox": [10, y, 50, y + 10], "layout_type": "LTTextLineVertical"} | more


def box(text="one two", **more):
    return {"text": text, "bbox": [10, 10, 50, 40], "layout_type": "LTTextBoxHorizontal"} | more


TREES = [
    [box(), line("one"), line("two", 30)], [box("same same"), line("same"), line("same", 30)], [box("one"), line("one"), line("one", 60)], [box()], [box(), line("other")], [box(), line("one", 60)], [box(), line("one")],
    [box(parent_text_index=None), line("one", parent_text_index=0), line("independent", 60, parent_text_index=None), line("two", 30, parent_text_index=0)], [box("one", parent_text_index=None), line("one", parent_text_index=None)],
    [box(), line("one"), box("x"), line("two")], [box("a b"), line("a"), line(" "), line("b", 30), line("c")], [line("a"), box("a"), line("a", bbox=None), line("a")], [box(bbox=None), line("one two")], [box("  "), line("")], [],
    [box("a b c", parent_text_index=None), box("a b", parent_text_index=0), line("a", parent_text_index=1), line("b", parent_text_index=1), line("c", parent_text_index=0)], [{"text": "no kind"}, line("x")],
]


def test_trees_equal_a_plain_version(spark):
    rows = [(str(i), json.dumps({"pages": [{"page_number": 2, "width": 100, "height": 100, "text_blocks": t, "images": [{"bbox": [0, 0, 10, 20], "name": "n"}], "figures": [{}]}]})) for i, t in enumerate(TREES)]
    got = collections.defaultdict(list)
    for r in L.standardize(spark.createDataFrame(rows, "id string, json string"), "json", "id").orderBy("document", "reading").collect():
        got[int(r.document)].append(r)
    for i, t in enumerate(TREES):
        text = [r for r in got[i] if r.kind == "text"]
        want = [(f"p2_txt_{k:04d}", " ".join(b["text"].split()), parent) for k, (b, (kept, parent)) in enumerate(zip(t, plain(t))) if kept]
        assert [(r.element_id, r.payload["raw_text"], (lambda p: None if p is None else int(p))(r.payload.get("parent_text_index"))) for r in text] == want, i
        assert [(r.kind, r.element_id, r.order_index, r.reading) for r in got[i][len(text) :]] == [("image", "p2_img_0000", 100_000, len(text)), ("diagram", "p2_dia_0000", 200_000, len(text) + 1)]
    first = got[0]
    assert [r.payload["raw_text"] for r in first[:2]] == ["one", "two"] and [(round(r.box.y0, 9), round(r.box.y1, 9)) for r in first[:2]] == [(0.8, 0.9), (0.6, 0.7)] and tuple(first[2].box) == (0, 0.8, 0.1, 1)


@pytest.mark.parametrize("parent", [5, 1, -1, "x"])
def test_a_parent_that_is_no_earlier_block_fails(spark, parent):
    text = json.dumps({"pages": [{"page_number": 1, "text_blocks": [box(), line("one", parent_text_index=parent)]}]})
    with pytest.raises(Exception, match="no such text parent"):
        L.standardize(spark.createDataFrame([("d", text)], "id string, json string"), "json", "id").collect()


def test_documents_as_layouts(spark):
    sf = "/root/testdata/sf0.001"
    want = collections.defaultdict(list)
    for r in plans.layout_json(spark, sf).collect():
        blocks = json.loads(r.json)["pages"][0]["text_blocks"]
        for b in blocks:
            if b.get("bbox"):
                b["bbox"] = json.loads(b["bbox"])
        want[r.doc_id] = [k for k, (kept, _) in enumerate(plain(blocks)) if kept]
    got = collections.defaultdict(list)
    for r in plans.std_layout(spark, sf).orderBy("document", "reading").collect():
        if r.kind == "text":
            got[r.document].append(int(r.element_id[-4:]) if len(r.element_id) == 11 else int(r.element_id.split("_")[-1]))
    assert dict(got) == {k: v for k, v in want.items() if v} and len(got) > 100


def test_layouts_hold_no_more_than_a_page_at_a_time(spark):
    plan = plans.std_layout(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Window", "Join", "Aggregate", "Sort "))


def test_structures_in_images():
    f = L.image_structures
    text = "t\n| Name | ![Struct](https://a.b/?x=%5Cchem%7B*%7BC-O%7D-NH2%28NO2%293%7D) | ![n](http://a.b/c) |\n![z](https://q/%5Cchem{N=O-Cl+-Fe}rest)\n![u](https://q/%5Cchem{N)"
    one, two = f(text)
    assert (one["line"], one["row_label"], one["alt"], one["expression"]) == (1, "Name", "Struct", "*{C-O}-NH2(NO2)3") and one["labels"] == ["NH2", "NO2", "NO2", "NO2"]
    assert (two["line"], two["row_label"], two["expression"], two["labels"]) == (2, "", "N=O-Cl+-Fe", ["N=O", "Cl+"])
    assert f(None) == [] and f("![a](ftp://x/\\chem{N})") == []
    assert L.argument("a\\chem{b{c}{d{e}}}f}", "chem") == "b{c}{d{e}}" and L.argument("\\chem{{}", "chem") is None and L.argument("chem{x}", "chem") is None and L.argument("\\chem{}", "chem") == ""
    assert L.visible_labels("C6H5-NH2-(NO2)3-CH3-O-N+") == ["NH2", "NO2", "NO2", "NO2", "N+"]
