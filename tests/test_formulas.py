"""Formulas of pages against a plain version page by page, and hand-made pages."""

import collections
import re

import pytest

from gradus.functions import detect
from gradus.functions.text import latex_form
from gradus.operators import formulas as M
from gradus.plans import detectors

SF = "/root/testdata/sf0.01"
BLOCK = "page long, element_id long, place long, reading int, order_index int, text string, box struct<x0: double, y0: double, x1: double, y1: double>"


def union(boxes):
    boxes = [b for b in boxes if b]
    return tuple(f(b[k] for b in boxes) for f, k in ((min, 0), (min, 1), (max, 2), (max, 3))) if boxes else None


class Kept:
    def __init__(self, own):
        self.seen = {(latex_form(x or ""), b) for x, b in own}

    def new(self, latex, box):
        key = (latex_form(latex), box)
        if not key[0] or key in self.seen:
            return False
        self.seen.add(key)
        return True


def plain_explicit(blocks, own):
    order = lambda b: (0, b["reading"]) if b["reading"] is not None else (1, b["order_index"]) if b["order_index"] is not None else (2, b["box"][1], b["box"][0]) if b["box"] else (3,)
    blocks = sorted(blocks, key=lambda b: (*order(b), *[0] * (3 - len(order(b))), b["place"]))
    kept, out, serial = Kept(own), [], 0
    for b in blocks:
        for f in detect.delimited_math(b["text"]):
            if kept.new(f["latex"], b["box"]):
                out.append(("explicit", serial, f["latex"], b["box"], b["order_index"], [b["element_id"]]))
            serial += 1
    groups = [([f["latex"] for f in run], b["box"], b["order_index"], [b["element_id"]]) for b in blocks for run in detect.numbered_runs(b["text"])]
    run, numbered = [], False
    for b in [*blocks, {"text": "end"}]:
        found = detect.delimited_math(b["text"])
        if found and detect.formula_only(b["text"], found):
            run += [(f, b) for f in found]
            numbered |= any(f["numbered"] for f in found)
        elif run and re.fullmatch(r"\(\d{1,3}\)[.,]?", b["text"].strip()):
            numbered = True
        else:
            if len(run) > 1 and numbered:
                groups.append(([f["latex"] for f, _ in run], union(b["box"] for _, b in run), min((b["order_index"] for _, b in run if b["order_index"] is not None), default=None), [b["element_id"] for _, b in run]))
            run, numbered = [], False
    had = set()
    for latexes, box, index, ids in groups:
        key = tuple(map(latex_form, latexes))
        if key in had:
            continue
        had.add(key)
        if kept.new(r" \quad ".join(latexes), box):
            out.append(("group", serial, r" \quad ".join(latexes), box, index, ids))
        serial += 1
    return out


def plain_layout(blocks, own):
    if own:
        return []
    blocks = [b for b in sorted(blocks, key=lambda b: b["place"]) if b["box"] and b["text"].strip()]
    mid = lambda b: (b["box"][1] + b["box"][3]) / 2
    rows = []
    for b in sorted(blocks, key=lambda b: (mid(b), b["box"][0])):
        for row in rows[-4:]:
            if abs(mid(b) - sum(map(mid, row)) / len(row)) <= max(0.006, 0.55 * max(x["box"][3] - x["box"][1] for x in [*row, b])):
                row.append(b)
                break
        else:
            rows.append([b])
    centre = [sum(map(mid, r)) / len(r) for r in rows]
    rows = [sorted(r, key=lambda b: b["box"][0]) for r in rows]
    kept, out, signal = Kept([]), [], re.compile(r"[=<>≤≥∑∫ΓΔαβτλπ∞∂^_]|\\(?:frac|dfrac|sum|int|partial|alpha|beta|gamma|Gamma|Delta|infty)")
    prose = lambda t: len(re.findall("[А-Яа-яЁё]{3,}", t)) >= 3 or len(t.strip()) > 50 and len(re.findall("[A-Za-zА-Яа-яЁё]{3,}", t)) >= 6
    maths = lambda t: bool(signal.search(t)) or bool(t.strip()) and len(t.strip()) <= 30 and len(re.findall("[A-Za-zА-Яа-яЁё]{3,}", t)) <= 2 and bool(re.search(r"[()0-9+\-*/]", t))
    for serial, a in enumerate(b for b in blocks if re.fullmatch(r"\(\d{1,3}\)[.,]?", b["text"].strip())):
        own_rows = [[b for b in r if b is not a and b["box"][0] < a["box"][0] + 0.02] for r in rows]
        texts = [" ".join(b["text"] for b in r) for r in own_rows]
        first = {k for k in range(len(rows)) if abs(centre[k] - mid(a)) <= 0.055 and maths(texts[k]) and not prose(texts[k])}
        if not any(-0.02 <= a["box"][0] - b["box"][2] <= 0.25 for k in first for b in own_rows[k]):
            continue
        chosen, last = set(first), mid(a)
        for k in range(min(range(len(rows)), key=lambda k: abs(centre[k] - mid(a))) + 1, len(rows)):
            if centre[k] - mid(a) > 0.22 or centre[k] - last > 0.045:
                break
            if not prose(texts[k]) and (maths(texts[k]) or len(texts[k]) <= 18):
                chosen.add(k)
                last = centre[k]
            elif centre[k] - mid(a) > 0.055:
                break
        some = {}
        for b in sorted((b for k in sorted(chosen) for b in own_rows[k] if not prose(b["text"])), key=lambda b: (mid(b), b["box"][0])):
            some.setdefault((b["text"], b["box"]), b)
        some = list(some.values())
        text = " ".join(b["text"] for b in some).strip()
        box = union([*(b["box"] for b in some), a["box"]])
        if some and signal.search(text) and kept.new(text, box):
            index = min((b["order_index"] for b in some if b["order_index"] is not None), default=a["order_index"])
            out.append(("layout", serial, text, box, index, [b["element_id"] for b in some]))
    return out


def pages_of(blocks, own):
    pages, had = collections.defaultdict(list), collections.defaultdict(list)
    for r in blocks.collect():
        pages[r.page].append(r.asDict() | {"box": tuple(r.box) if r.box else None})
    for r in own.collect():
        had[r.page].append((r.latex, tuple(r.box) if r.box else None))
    return pages, had


def same(df, want, latex="latex"):
    close = lambda b: None if b is None else tuple(round(v, 9) for v in b)
    got = collections.defaultdict(list)
    for r in df.orderBy("page", "serial").collect():
        d = r.asDict()
        got[r.page].append((d.get("kind", "layout"), r.serial, d[latex], close(r.box), r.order_index, list(r.source_ids)))
    assert dict(got) == {k: [(a, b, c, close(d), e, f) for a, b, c, d, e, f in v] for k, v in want.items() if v}


@pytest.fixture(scope="module")
def sheets(spark):
    blocks, own = (x.cache() for x in detectors.sheets(spark, SF))
    return blocks, own, *pages_of(blocks, own)


def test_explicit(sheets):
    blocks, own, pages, had = sheets
    want = {k: plain_explicit(v, had[k]) for k, v in pages.items()}
    assert {"explicit", "group"} == {f[0] for v in want.values() for f in v} and any(len(f[5]) > 1 for v in want.values() for f in v)
    same(M.explicit(blocks, own, ["page"]), want)


def test_layout(sheets):
    blocks, own, pages, had = sheets
    want = {k: plain_layout(v, had[k]) for k, v in pages.items()}
    assert sum(map(len, want.values())) > 10
    same(M.beside_numbers(blocks, own, ["page"]), want, "text")


def test_enriched(sheets):
    blocks, own, pages, had = sheets
    want = {k: plain_explicit(v, had[k]) for k, v in pages.items()}
    want = {k: w or plain_layout(pages[k], had[k]) for k, w in want.items()}
    assert {f[0] for v in want.values() for f in v} == {"explicit", "group", "layout"}
    same(M.enrich(blocks, own, ["page"]), want, "text")


def test_hand_made_pages(spark):
    box = lambda x, y, w=0.2: (x, y, x + w, y + 0.02)
    rows = [
        (1, 1, 1, 2, None, "$$b$$ (7)", None), (1, 2, 2, 1, None, "$$a$$", None), (1, 3, 3, None, 9, "(8).", None), (1, 4, 4, None, None, "text $$a$$", None), (1, 5, 5, None, None, "", None),
        (2, 6, 6, None, None, "x = y", box(0.3, 0.3)), (2, 7, 7, None, 4, "(1)", box(0.6, 0.3, 0.05)), (2, 8, 8, None, None, "+ z", box(0.3, 0.335)), (2, 9, 9, None, None, "слово другое третье", box(0.3, 0.37)), (2, 10, 10, None, None, "= q", box(0.3, 0.405)),
        (3, 11, 11, None, None, "x = y", box(0.05, 0.3, 0.1)), (3, 12, 12, None, None, "(1)", box(0.6, 0.3, 0.05)),
    ]
    blocks = spark.createDataFrame(rows, BLOCK)
    own = spark.createDataFrame([], "page long, latex string, box struct<x0: double, y0: double, x1: double, y1: double>")
    pages, _ = pages_of(blocks, own)
    same(M.explicit(blocks, own, ["page"]), {k: plain_explicit(v, []) for k, v in pages.items()})
    got = {(r.page, r.kind): r for r in M.enrich(blocks, own, ["page"]).collect()}
    assert got[1, "group"].latex == r"a \quad b" and got[1, "group"].source_ids == [2, 1]
    assert got[2, "layout"].text == "x = y + z" and got[2, "layout"].order_index == 4 and (3, "layout") not in got
    assert M.enrich(blocks.limit(0), own, ["page"]).count() == 0
