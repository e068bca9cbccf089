"""Chemical structures of tables and layouts against a plain version page by page."""

import collections
import re

import pytest

from gradus.functions.detect import element_symbols
from gradus.operators import structures as S
from gradus.plans import detectors

SF = "/root/testdata/sf0.001"


def fold(t):
    return " ".join(t.lower().split())


def header(t):
    t = fold(t)
    return "структурн" in t and "формул" in t or "structural" in t and "formula" in t or "chemical" in t and "structure" in t


def number(t):
    return bool(re.fullmatch(r"[\s0-9.,+\-]+", t))


def label(t):
    t = re.sub(r"[^A-Za-zА-Яа-я0-9+=.()\-]", "", t).translate(str.maketrans("АВЕКМНОРСТХ", "ABEKMHOPCTX"))
    if not t or len(t) > 16:
        return False
    symbols = element_symbols(t)
    return t in {"N", "O", "S", "+", "-", "N."} or "=" in t and any(c in t for c in "NOS") or bool(symbols and any(s not in "CH" for s in symbols))


def area(a, b):
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1])) if a and b else 0.0


def labels_in(blocks, box):
    return [b["text"].strip() for b in blocks if area(b["box"], box) > 0 and label(b["text"])]


def plain_tables(page):
    out = []
    for t in page["tables"]:
        cells = [c for c in page["cells"] if c["table_id"] == t["table_id"]]
        head = [c for c in cells if c["row"] == 0]
        if not (header(" ".join(c["text"] for c in head)) or any(fold(c["text"]).startswith("structure:") for c in cells)):
            continue
        col = next((c["col"] for c in head if header(c["text"])), None)
        if col is None:
            a = [c["col"] for c in head if "structur" in fold(c["text"]) or "структурн" in fold(c["text"])]
            b = [c["col"] for c in head if "formula" in fold(c["text"]) or "формул" in fold(c["text"])]
            col = a[0] if a and b and a[0] == b[0] else 1 if t["columns"] >= 4 else None
        name_col = min((c["col"] for c in head), default=0)
        body = [c for c in cells if c["row"] > 0]
        starts = sorted({c["row"] for c in body if c["col"] == name_col and c["text"].strip()}) or sorted({c["row"] for c in body if fold(c["text"]).startswith("structure:")})
        images = re.findall(r"""<img\b[^>]*\bsrc=["']([^"']+)["'][^>]*>""", t["html"] or "", re.I)
        wide = t["columns"] if col is not None else max(4, t["columns"])
        for item, r in enumerate(starts):
            end, box = ([*starts, t["rows"]])[item + 1], None
            name = next((c for c in body if (c["row"], c["col"]) == (r, name_col)), None)
            own = next((c for c in body if (c["row"], c["col"]) == (r, col)), None)
            if t["box"] and t["rows"] > 0:
                x0, y0, x1, y1 = t["box"]
                down = [y0 + (y1 - y0) * k / t["rows"] for k in (r, end)]
                if col is not None:
                    over = [x0 + (x1 - x0) * k / wide for k in (col, col + 1)]
                else:
                    left = [c["box"][2] for c in body if c["row"] in starts and c["col"] == name_col and c["box"]]
                    right = [c["box"][0] for c in body if number(c["text"]) and c["box"]]
                    if not left or not right:
                        continue
                    over = [max(left), min(right)]
                if over[1] > over[0] and down[1] > down[0]:
                    box = (over[0], down[0], over[1], down[1])
            met = [i for i in page["images"] if area(i["box"], box) > 0]
            image = max(met, key=lambda i: area(i["box"], box)) if met else None
            text = own["text"] if own else ""
            final = image["box"] if image else own["box"] if own and own["box"] and (not text.strip() or not number(text)) else None
            final = final or box
            if final is None:
                continue
            found = [re.sub(r"^structure\s*:\s*", "", text.strip(), flags=re.I)] if text.strip() and not number(text) else []
            found = [f for f in found if f] + labels_in(page["blocks"], final)
            asset = image["asset"] if image and image["asset"] else images[item] if item < len(images) else None
            out.append((final, list(dict.fromkeys(found)), asset, "table"))
    return out


def plain_header(blocks):
    mid = lambda b: (b["box"][1] + b["box"][3]) / 2
    best = None
    for a in (b for b in blocks if any(w in fold(b["text"]) for w in ("structur", "структурн"))):
        for b in (b for b in blocks if any(w in fold(b["text"]) for w in ("formula", "формул"))):
            if abs(mid(a) - mid(b)) > 0.02 or b["box"][0] < a["box"][0] or b["box"][0] - a["box"][2] > 0.08:
                continue
            box = (min(a["box"][0], b["box"][0]), min(a["box"][1], b["box"][1]), max(a["box"][2], b["box"][2]), max(a["box"][3], b["box"][3]))
            same = [x for x in blocks if abs(mid(x) - (box[1] + box[3]) / 2) <= 0.02]
            score = any(x["box"][2] <= box[0] and fold(x["text"]) in S.NAMES for x in same) + any(x["box"][0] > box[2] for x in same)
            if best is None or (score, box[1]) > best[:2]:
                best = (score, box[1], box)
    if best and best[0] == 2:
        return best[2]
    rows = []
    for b in sorted((b for b in blocks if len(b["text"].strip()) <= 40 and b["text"].strip() and b["box"][2] - b["box"][0] <= 0.25), key=lambda b: (mid(b), b["box"][0], b["element_id"])):
        near, least = None, float("inf")
        for row in reversed(rows):
            centre = sum(map(mid, row)) / len(row)
            if mid(b) - centre > 0.05:
                break
            away = abs(mid(b) - centre)
            if away <= 0.8 * max(x["box"][3] - x["box"][1] for x in [*row, b]) and away < least:
                near, least = row, away
        rows.append([b]) if near is None else near.append(b)
    for row in rows:
        groups = []
        for b in sorted(row, key=lambda b: (b["box"][0], b["element_id"])):
            last = groups[-1][-1]["box"] if groups else None
            if last and b["box"][0] - last[2] <= 0.035 and min(b["box"][2], last[2]) - max(b["box"][0], last[0]) <= 0.5 * min(b["box"][2] - b["box"][0], last[2] - last[0]):
                groups[-1].append(b)
            else:
                groups.append([b])
        for g in groups:
            if len(g) > 1 and header(" ".join(b["text"].strip() for b in g)):
                boxes = [b["box"] for b in g]
                return tuple(f(x[k] for x in boxes) for f, k in ((min, 0), (min, 1), (max, 2), (max, 3)))
    return next((b["box"] for b in blocks if header(b["text"])), None)


def plain_page(page):
    blocks = [b for b in page["blocks"] if b["box"]]
    h = plain_header(blocks)
    if h is None:
        return []
    mid = lambda b: (b["box"][1] + b["box"][3]) / 2
    x = lambda b: (b["box"][0] + b["box"][2]) / 2
    shown = [i for i in page["images"] if i["box"] and h[3] <= i["box"][1] <= h[3] + 0.55 and h[0] - 0.18 <= x(i) <= h[2] + 0.18]
    if shown:
        return [(i["box"], list(dict.fromkeys(labels_in(page["blocks"], i["box"]))), i["asset"], "image") for i in sorted(shown, key=lambda i: (i["box"][1], i["box"][0]))]
    same = [b for b in blocks if abs(mid(b) - (h[1] + h[3]) / 2) <= 0.02]
    left, right = next((b for b in same if fold(b["text"]) in S.NAMES), None), [b["box"][0] for b in same if b["box"][0] > h[2]]
    if left is None or not right:
        return []
    low, high = (left["box"][2] + h[0]) / 2, (h[2] + min(right)) / 2
    labels = [b for b in blocks if h[3] < b["box"][1] < h[3] + 0.55 and low <= x(b) <= high and label(b["text"])]
    if not labels:
        return []
    lowest, groups = max(b["box"][3] for b in labels), []
    for b in sorted((b for b in blocks if h[3] < b["box"][1] <= lowest and x(b) < low and b["text"].strip()), key=lambda b: (b["box"][1], b["box"][0])):
        if groups and b["box"][1] - max(g["box"][3] for g in groups[-1]) <= 0.022:
            groups[-1].append(b)
        else:
            groups.append([b])
    groups, out = [g for g in groups if any(len(b["text"].strip()) >= 3 for b in g)], []
    top, end = (lambda g: min(b["box"][1] for b in g)), (lambda g: max(b["box"][3] for b in g))
    for k, g in enumerate(groups):
        a = h[3] if k == 0 else (end(groups[k - 1]) + top(g)) / 2
        z = lowest + 0.012 if k + 1 == len(groups) else (end(g) + top(groups[k + 1])) / 2
        own = [b["text"].strip() for b in labels if a <= mid(b) < z]
        if len(own) > 1:
            out.append(((max(0.0, low), max(0.0, a), min(1.0, high), min(1.0, z)), list(dict.fromkeys(own)), None, "layout"))
    return out


@pytest.fixture(scope="module")
def parts(spark):
    c = {k: v.cache() for k, v in detectors.catalogue(spark, SF).items()}
    pages = collections.defaultdict(lambda: {k: [] for k in c})
    for k, v in c.items():
        for r in v.collect():
            pages[r.page][k].append(r.asDict() | {"box": tuple(r.box) if r.box else None})
    for page in pages.values():
        for rows in page.values():
            rows.sort(key=lambda r: r["place"])
    return c, pages


def same(df, pages, plain):
    got = collections.defaultdict(list)
    for r in df.orderBy("page", "number").collect():
        got[r.page].append((tuple(r.box), list(r.labels), r.asset, r.source))
        assert r.number == len(got[r.page]) - 1
    want = {k: w for k, p in pages.items() if (w := plain(p))}
    close = lambda rows: [(tuple(round(x, 9) for x in b), *rest) for b, *rest in rows]
    assert {k: close(v) for k, v in got.items()} == {k: close(v) for k, v in want.items()}
    return collections.Counter(r[3] for rows in want.values() for r in rows)


def test_tables(parts):
    c, pages = parts
    assert same(S.in_tables(**c, keys=["page"]), pages, plain_tables)["table"] > 60


def test_pages(parts):
    c, pages = parts
    n = same(S.on_pages(c["images"], c["blocks"], ["page"]), pages, plain_page)
    assert n["image"] > 5 and n["layout"] > 5


def test_enriched(parts):
    c, pages = parts
    known = c["blocks"].where("page % 7 = 0")
    n = same(S.enrich(**c, known=known, keys=["page"]), {k: p for k, p in pages.items() if k % 7}, lambda p: plain_tables(p) or plain_page(p))
    assert set(n) == {"table", "image", "layout"}


def test_empty_pages(parts):
    c = {k: v.where("false") for k, v in parts[0].items()}
    assert S.enrich(**c, known=c["blocks"], keys=["page"]).count() == 0


def test_labels_and_headers():
    for t in ("N", "o h", "CH3", "=O", "R-N=", "12", "", "plain text", "Cl", "C6H6", "Н2О", "COOH." * 5, "+", None):
        assert S.label_like(t) == label(t or ""), t
