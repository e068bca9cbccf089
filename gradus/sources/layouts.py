"""Layout output of text parsers as elements of pages: trees of text blocks, images and figures, and structures in Markdown images."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gradus.functions import boxes as B
from gradus.functions import metrics as M
from gradus.functions import text as T
from gradus.functions.detect import ELEMENTS, element_symbols

_LOOSE = "array<map<string, string>>"
RAW = f"struct<pages: array<struct<page_number: int, width: double, height: double, text_blocks: {_LOOSE}, images: {_LOOSE}, figures: {_LOOSE}>>>"
#: Kinds of layout boxes and lines, and where the orders of images and figures begin.
BOXES, LINES = "LTTextBox", "LTTextLine"
ORDERS = {"images": ("img", "image", 100_000), "figures": ("dia", "diagram", 200_000)}


def _box(m: Column) -> Column:
    b = F.from_json(m["bbox"], "array<double>")
    side = lambda i: F.try_element_at(b, F.lit(i))
    return F.when(F.size(b) == 4, B.normalize(side(1), side(2), side(3), side(4), F.col("width"), F.col("height"), bottom_left=True))


def _joined(blocks: Column) -> Column:
    return T.collapse_ws(F.array_join(F.transform(blocks, lambda x: x["text"]), " "))


def _held(places: Column) -> Column:
    return F.filter(places, lambda i: i.isNotNull())


def hierarchy(pages: DataFrame) -> DataFrame:
    """pages with blocks: of the text_blocks those (idx, m, text, parent: idx, null of a root) that aren't blank and whose text their children don't repeat.

    A page of which any block names a parent has the parents that are named; one that isn't an earlier block fails the query. On other pages a box is
    the parent of the lines right behind it, up to the first at which their texts make its own, if all of these lie within it. Texts
    alone, or other lines of the page, never make a child. A page is one row, as in its document's text: nothing is shuffled or sorted over pages.
    """
    kind = lambda m: F.coalesce(m["layout_type"], F.lit(""))
    block = lambda m, i: F.struct(i.alias("idx"), m.alias("m"), T.collapse_ws(F.coalesce(m["text"], F.lit(""))).alias("text"), F.from_json(m["bbox"], "array<double>").alias("corners"), F.startswith(kind(m), F.lit(LINES)).alias("line"), F.startswith(kind(m), F.lit(BOXES)).alias("box"))
    rows = M.kept(pages, _b=F.transform(F.coalesce("text_blocks", F.array().cast(_LOOSE)), block))
    b, heads, near = F.col("_b"), F.col("_heads"), 1e-8
    named = F.coalesce(F.exists(b, lambda x: F.map_contains_key(x["m"], "parent_text_index")), F.lit(False))
    rows = M.kept(rows, _named=named, _heads=_held(F.transform(b, lambda x: F.when(~x["line"], x["idx"]))))

    def told(x):
        name = x["m"]["parent_text_index"]
        number = name.try_cast("int")
        wrong = name.isNotNull() & ~F.coalesce(number.between(0, x["idx"] - 1), F.lit(False))
        return F.when(wrong, F.raise_error(F.concat_ws(" ", F.lit("no such text parent:"), "document", "page", x["idx"])).cast("int")).otherwise(number)

    def within(a, c):
        return F.coalesce(F.size(a) == 4, F.lit(False)) & F.coalesce(F.size(c) == 4, F.lit(False)) & F.coalesce((F.get(a, 0) <= F.get(c, 0) + near) & (F.get(a, 1) <= F.get(c, 1) + near) & (F.get(a, 2) >= F.get(c, 2) - near) & (F.get(a, 3) >= F.get(c, 3) - near), F.lit(False))

    def longer(acc, c):
        n = acc["n"] + F.length(c["text"]) + F.when((acc["n"] > 0) & (c["text"] != ""), 1).otherwise(0)
        return M.let(lambda v: F.struct(v["n"].alias("n"), (acc["lines"] + 1).alias("lines"), F.coalesce(acc["at"], F.when(v["n"] == acc["want"], acc["lines"] + 1)).alias("at"), acc["want"].alias("want")), n=n)

    def family(h, k):
        """The block before a run of lines, and these: the parent of each."""
        lines = F.slice(b, h + 2, F.coalesce(F.get(heads, k + 1), F.size(b)) - h - 1)

        def children(v):
            out = F.array_position(F.transform(v["lines"], lambda c: within(v["head"]["corners"], c["corners"])), F.lit(False)).cast("int")
            return M.let(lambda w: F.when(w["out"] == 0, v["lines"]).otherwise(F.slice(v["lines"], 1, F.greatest(w["out"] - 1, F.lit(0)))), out=out)

        def count(v):
            """How many lines have the head's length, if they have its text."""
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("lines"), F.lit(None).cast("int").alias("at"), F.length(v["head"]["text"]).alias("want"))
            at = F.aggregate(v["inside"], start, longer)["at"]
            return M.let(lambda w: F.when(v["head"]["box"] & (v["head"]["text"] != "") & w["at"].isNotNull() & (_joined(F.slice(v["inside"], 1, F.coalesce(w["at"], F.lit(0)))) == v["head"]["text"]), w["at"]).otherwise(0), at=at)

        n = M.let(lambda v: M.let(count, head=v["head"], inside=children(v)), head=F.get(b, h), lines=lines)
        return M.let(lambda v: F.concat(F.array(F.lit(None).cast("int")), F.transform(v["lines"], lambda c, i: F.when(i < v["n"], h))), n=n, lines=lines)

    before = F.transform(F.slice(b, 1, F.coalesce(F.get(heads, F.lit(0)), F.size(b))), lambda x: F.lit(None).cast("int"))
    rows = M.kept(rows, _parents=F.when(F.col("_named"), F.transform(b, told)).otherwise(F.concat(before, F.flatten(F.transform(heads, family)))))
    # children in the order of parents: those of one are neighbours
    kids = F.array_sort(F.filter(F.transform(b, lambda x, i: F.struct(F.get("_parents", i).alias("parent"), i.alias("idx"), x["text"].alias("text"))), lambda x: x["parent"].isNotNull()))
    rows = M.kept(rows, _kids=kids)
    kids, starts = F.col("_kids"), F.col("_starts")
    rows = M.kept(rows, _starts=_held(F.transform(kids, lambda x, i: F.when((i == 0) | (x["parent"] != F.get(kids, F.greatest(i - 1, F.lit(0)))["parent"]), i))))
    own = lambda i, j: F.slice(kids, i + 1, F.coalesce(F.get(starts, j + 1), F.size(kids)) - i)
    repeated = _held(F.transform(starts, lambda i, j: M.let(lambda v: F.when(_joined(own(i, j)) == F.get(b, v["p"])["text"], v["p"]), p=F.get(kids, i)["parent"])))
    stay = F.array_except(F.transform(F.filter(b, lambda x: x["text"] != ""), lambda x: x["idx"]), repeated)
    each = lambda i: M.let(lambda v: F.struct(v["x"]["idx"].alias("idx"), v["x"]["m"].alias("m"), v["x"]["text"].alias("text"), F.get("_parents", i).alias("parent")), x=F.get(b, i))
    return M.kept(rows, blocks=F.transform(stay, each)).drop("_b", "_named", "_heads", "_parents", "_kids", "_starts")


def standardize(texts: DataFrame, text: str, document: str) -> DataFrame:
    """Elements of a parser's JSON, a text a document: document, page, kind, element_id, order_index, box, payload, reading (its place in the page's order).

    Text blocks whose text their children repeat, and blank ones, go; boxes count from the bottom there and from the top here. Images follow the
    text, figures follow them.
    """
    pages = texts.select(F.col(document).alias("document"), F.explode(F.from_json(text, RAW)["pages"]).alias("p")).select("document", F.col("p.page_number").alias("page"), *[F.coalesce(F.nullif(F.col(f"p.{s}"), F.lit(0.0)), F.lit(1.0)).alias(s) for s in ("width", "height")], *[f"p.{k}" for k in ("text_blocks", "images", "figures")])
    order = lambda m, i: F.coalesce(m["order_index"].cast("int"), i)
    own = lambda *names: F.map_filter(F.create_map(*[x for n, v in names for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    row = lambda kind, mark, i, m, start, payload, k: F.struct(F.lit(kind).alias("kind"), F.format_string(f"p%d_{mark}_%04d", "page", i).alias("element_id"), (start + order(m, i)).alias("order_index"), _box(m).alias("box"), payload.alias("payload"), F.lit(k).alias("_k"), i.alias("idx"))
    said = lambda x: own(("raw_text", x["text"]), ("block_type", F.lit("paragraph")), ("layout_type", x["m"]["layout_type"]), ("parent_text_index", x["parent"].cast("string")))
    parts = [F.transform("blocks", lambda x: row("text", "txt", x["idx"], x["m"], 0, said(x), 0))]
    for k, (field, (mark, kind, start)) in enumerate(ORDERS.items(), 1):
        names = ("name", "srcsize", "bits", "asset_path", "extraction_success") if field == "images" else ("name", "vector_count", "image_count", "text_count")
        made = lambda m, i: row(kind, mark, i, m, start, own(*[(n, m[n]) for n in names]), k)  # noqa: B023, E731
        parts.append(F.transform(F.coalesce(field, F.array().cast(_LOOSE)), made))  # which is called at once
    every = M.kept(hierarchy(pages).select("document", "page", "width", "height", "blocks", "images", "figures"), _e=F.concat(*parts))
    e = F.col("_e")
    places = F.array_sort(F.transform(e, lambda x, i: F.struct(x["order_index"].alias("o"), x["_k"].alias("k"), x["idx"].alias("idx"), i.alias("at"))))
    out = every.select("document", "page", "_e", F.posexplode(places).alias("reading", "at")).select("document", "page", "reading", F.get(e, F.col("at.at")).alias("e"))
    return out.select("document", "page", *[f"e.{c}" for c in ("kind", "element_id", "order_index", "box", "payload")], "reading")


_IMAGE = re.compile(r"!\[([^]]*)\]\((https?://[^)\s]+)\)")
_BOND = re.compile(r"([A-Z][a-z]?)\s*=\s*([A-Z][a-z]?)")
_GROUP = re.compile(r"[A-Z][A-Za-z0-9]*(?:[+-](?=-|[)\]]|$))?")


def argument(text: str, command: str) -> str | None:
    """What stands in the braces of a command, with braces of its own; null without the command or its closing brace."""
    _, found, rest = text.partition(f"\\{command}{{")
    depth = 1
    for m in re.finditer("[{}]", rest) if found else ():
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return rest[: m.start()]
    return None


def visible_labels(expression: str) -> list[str]:
    """Double bonds of elements, then groups with other elements than C and H, each as often as brackets around it say; a lone symbol only with a charge."""
    bonds = [m for m in _BOND.finditer(expression) if {m[1], m[2]} <= ELEMENTS]
    rest = list(expression)
    for m in bonds:
        rest[m.start() : m.end()] = " " * (m.end() - m.start())
    rest, out = "".join(rest), [f"{m[1]}={m[2]}" for m in bonds]
    for m in _GROUP.finditer(rest):
        symbols = element_symbols(m[0])
        if symbols and set(symbols) - {"C", "H"} and (len(symbols) > 1 or m[0][-1] in "+-"):
            times = re.match(r"\)(\d+)", rest[m.end() :]) if rest[m.start() - 1 : m.start()] == "(" else None
            out += [m[0]] * (max(1, int(times[1])) if times else 1)
    return out


def image_structures(text: str | None) -> list[dict]:
    """Structures that a Markdown text's images hold in their addresses: line, row_label (the last filled cell before the image's), alt, url, expression, labels."""
    out = []
    for n, line in enumerate((text or "").splitlines()):
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        for m in _IMAGE.finditer(line):
            expression = argument(unquote(m[2]), "chem")
            if expression:
                at = next((i for i, c in enumerate(cells) if i and m[2] in c), 0)
                out.append({"line": n, "row_label": next((c for c in reversed(cells[:at]) if c), ""), "alt": m[1].strip(), "url": m[2], "expression": expression.strip(), "labels": visible_labels(expression)})
    return out


@F.pandas_udf(ArrayType(StructType([StructField("line", IntegerType()), *[StructField(k, StringType()) for k in ("row_label", "alt", "url", "expression")], StructField("labels", ArrayType(StringType()))])))
def markdown_structures(s: pd.Series) -> pd.Series:
    return s.map(image_structures)
