"""Chemical structures that a page shows without naming them: in tables with a column for them, or under a header of its layout.

Inputs are elements of pages: tables (keys, table_id, place, rows, columns, box, html), their cells (keys, table_id, place, row,
col, text, box), images (keys, image_id, place, asset, box) and text blocks (keys, element_id, place, text, box); place is the
order in the page, or the table. Every result is a row a structure: keys, number (its order in the page), box, labels, asset,
source (the rule that found it) and what it rests on.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from gradus.functions import boxes as B
from gradus.functions import text as T
from gradus.functions.detect import LATIN, LOOKALIKES, element_symbols
from gradus.operators.documents import overlapping, stripped
from gradus.operators.regions import gap_groups, line_rows
from gradus.operators.stages import cut, meet

#: Words of headers in both languages, headers of names, labels that are read as such alone, what may stay in a
#: label and how long it is, and what a number is written with.
STRUCTURAL, FORMULA = ("структурн", "structur"), ("формул", "formula")
HEADERS = (("структурн", "формул"), ("structural", "formula"), ("chemical", "structure"))
NAMES = ("название", "name", "compound")
MARK = "structure:"
LABELS = frozenset(("N", "O", "S", "+", "-", "N."))
LABEL_OTHER, LABEL_LENGTH = r"[^A-Za-zА-Яа-я0-9+=.()\-]", 16
NUMERIC = r"(?U)^[\s0-9.,+\-]+$"
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def folded(c: Column) -> Column:
    return T.collapse_ws(F.lower(c))


def has_any(c: Column, words) -> Column:
    return F.greatest(*[F.contains(c, F.lit(w)) for w in words])


def is_header(c: Column) -> Column:
    """Whether a text names a column of structures."""
    f = folded(c)
    return F.greatest(*[F.contains(f, F.lit(a)) & F.contains(f, F.lit(b)) for a, b in HEADERS])


def marked(c: Column) -> Column:
    """Whether a text begins with the mark of structures; white space is only looked at where the mark is, as it holds none."""
    return F.contains(F.lower(c), F.lit(MARK)) & F.startswith(folded(c), F.lit(MARK))


def numeric(c: Column) -> Column:
    return F.coalesce(c.rlike(NUMERIC), F.lit(False))


def label_like(text: str | None) -> bool:
    """Whether a text may label a part of a structure: a sign, a double bond of an element, or elements, not only C and H."""
    kept = re.sub(LABEL_OTHER, "", text or "")
    if not kept or len(kept) > LABEL_LENGTH:
        return False
    latin = kept.translate(str.maketrans(LOOKALIKES, LATIN))
    symbols = element_symbols(latin)
    return latin in LABELS or "=" in latin and bool({"N", "O", "S"} & set(latin)) or bool(symbols and set(symbols) - {"C", "H"})


@F.pandas_udf(BooleanType())
def is_label(s: pd.Series) -> pd.Series:
    known = {t: label_like(t) for t in set(s)}
    return pd.Series([known[t] for t in s], dtype=bool)


def _labelled(found: DataFrame, blocks: DataFrame, keys: list[str], first: Column | None = None) -> DataFrame:
    """Adds labels: the distinct ones among the blocks that meet the box, in the page's order, behind `first` if there is one.

    found has a column `_at`, its own number; only blocks that look like labels meet the boxes.
    """
    marks = blocks.where(F.col("box").isNotNull() & is_label("text")).select(*keys, "place", "text", "box")
    met = overlapping(found.select(*keys, "_at", "box"), marks, keys).groupBy(*keys, "_at").agg(F.array_sort(F.collect_list(F.struct("other_place", stripped(F.col("other_text")).alias("text")))).alias("_met"))
    own = F.transform(F.coalesce("_met", F.array().cast("array<struct<other_place: long, text: string>>")), lambda m: m["text"])
    labels = own if first is None else F.concat(F.when(first != "", F.array(first)).otherwise(F.array().cast("array<string>")), own)
    return meet(found, met, [*keys, "_at"], "left").withColumn("labels", F.array_distinct(labels)).drop("_met")


def in_tables(tables: DataFrame, cells: DataFrame, images: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Structures of the records of tables that have a column for them.

    A table counts if its first row names such a column, in one cell or in all together, or a cell is marked as a structure.
    The column is that of the first cell that names it; else the one where the first "structural" and the first "formula" meet; else
    the second of four or more; else it is unknown and lies between the names and the numbers. A record begins at each row with a name
    in the first header cell's column (or, without names, at each marked cell) and ends at the next. Its box is that of the
    image that shares most with its part of the grid (the first of equal ones), else of its structure cell unless that holds a number,
    else the part of the grid itself; without any it isn't a structure. Labels are the cell's text, if no number, and the
    blocks in the box that look like labels.

    Cells are grouped by table and row and records are windows over a table; what a table says of itself is joined to its records,
    not sorted with its cells. Only boxes of one page meet.
    """
    own = [*keys, "table_id"]
    head = F.col("row") == 0
    token = lambda words: F.min_by("col", F.when(head & has_any(folded(F.col("text")), words), F.col("place")))
    named_col = F.min_by("col", F.when(head & is_header(F.col("text")), F.col("place")))
    about = cells.groupBy(*own).agg(
        named_col.alias("named"), token(STRUCTURAL).alias("a"), token(FORMULA).alias("b"), F.coalesce(F.min(F.when(head, F.col("col"))), F.lit(0)).alias("name_col"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(head, F.struct("place", "text")))), lambda c: c["text"]), " ").alias("header"), F.max(marked(F.col("text"))).alias("marked"),
    )
    about = meet(about.where(is_header(F.col("header")) | F.col("marked")), tables.select(*own, "columns"), own)
    about = about.withColumn("structure_col", F.coalesce("named", F.when(F.col("a") == F.col("b"), F.col("a")), F.when(F.col("columns") >= 4, F.lit(1))))

    name, structure = F.col("col") == F.col("name_col"), F.col("col") == F.col("structure_col")
    body = meet(cells.where("row > 0"), about.select(*own, "name_col", "structure_col"), own)
    one = lambda test: F.min(F.when(test, F.struct("place", "text", "box")))
    rows = body.groupBy(*own, "structure_col", "row").agg(
        one(name).alias("name"), one(structure).alias("cell"), F.max(name & (stripped(F.col("text")) != "")).alias("starts"), F.max(marked(F.col("text"))).alias("marked"),
        F.max(F.when(name, F.col("box.x1"))).alias("left"), F.min(F.when(numeric(F.col("text")), F.col("box.x0"))).alias("right"),
    )
    whole = Window.partitionBy(*own)
    rows = rows.withColumn("right", F.min("right").over(whole)).withColumn("starts", F.when(F.max("starts").over(whole), F.col("starts")).otherwise(F.col("marked"))).where("starts")
    order = whole.orderBy("row")
    rows = rows.withColumn("left", F.max("left").over(whole)).withColumn("next", F.lead("row").over(order)).withColumn("item", F.row_number().over(order) - 1)
    rows = meet(rows, tables.select(*own, F.col("place").alias("table_place"), "rows", "columns", F.col("box").alias("table_box"), "html"), own).withColumn("until", F.coalesce("next", "rows"))

    t, col, wide = F.col("table_box"), F.col("structure_col"), F.when(F.col("structure_col").isNull(), F.greatest("columns", F.lit(4))).otherwise(F.col("columns"))
    x0 = F.when(col.isNull(), F.col("left")).otherwise(t["x0"] + (t["x1"] - t["x0"]) * col / wide)
    x1 = F.when(col.isNull(), F.col("right")).otherwise(t["x0"] + (t["x1"] - t["x0"]) * (col + 1) / wide)
    grid = B.box(x0, t["y0"] + (t["y1"] - t["y0"]) * F.col("row") / F.col("rows"), x1, t["y0"] + (t["y1"] - t["y0"]) * F.col("until") / F.col("rows"))
    rows = rows.withColumn("grid", F.when(F.col("rows") > 0, grid))
    g = F.col("grid")
    placeless = t.isNotNull() & (F.col("rows") > 0) & col.isNull() & (F.col("left").isNull() | F.col("right").isNull())  # such a record is left out
    rows = rows.where(~F.coalesce(placeless, F.lit(False))).withColumn("grid", F.when((g["x1"] > g["x0"]) & (g["y1"] > g["y0"]), g)).withColumn("_at", F.struct("table_place", "item"))

    rows = cut(rows)
    best = F.max(F.struct("area", (-F.col("other_place")).alias("later"), F.col("other_image_id").alias("image_id"), F.col("other_asset").alias("asset"), F.col("other_box").alias("box")))
    shown = overlapping(rows.select(*keys, "_at", F.col("grid").alias("box")), images.select(*keys, "image_id", "place", "asset", "box"), keys).groupBy(*keys, "_at").agg(best.alias("image"))
    rows = meet(rows, shown, [*keys, "_at"], "left")
    text = F.coalesce(stripped(F.col("cell.text")), F.lit(""))
    rows = rows.withColumn("box", F.coalesce(F.col("image.box"), F.when((text == "") | ~numeric(F.col("cell.text")), F.col("cell.box")), F.col("grid"))).where("box is not null")
    first = F.when((text != "") & ~numeric(F.col("cell.text")), F.regexp_replace(text, r"(?iU)^structure\s*:\s*", "")).otherwise("")
    sources = F.regexp_extract_all("html", F.lit(r"""(?i)<img\b[^>]*\bsrc=["']([^"']+)["'][^>]*>"""), F.lit(1))
    out = _labelled(rows, blocks, keys, first)
    asset = F.coalesce(F.nullif(F.col("image.asset"), F.lit("")), F.try_element_at(sources, F.col("item") + 1))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_at")) - 1
    return out.select(*keys, number.alias("number"), "box", "labels", asset.alias("asset"), F.lit("table").alias("source"), "table_id", F.coalesce(stripped(F.col("name.text")), F.lit("")).alias("name"))


def headers(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, box, names, right): the header of a column of structures in a page's layout, whether a header of names stands left of
    it, and where its right neighbour begins (null without one).

    First choice: a "structural" block and a "formula" block close behind it in one line, between a header of names and another
    one; of several the lowest, then the first. Else the first line of short blocks that names such a column, else the first block that does.
    """
    held = blocks.where(F.col("box").isNotNull()).select(*keys, "element_id", "place", "text", "box", B.centre(F.col("box")).alias("c"))
    told = held.withColumn("f", folded(F.col("text")))
    a, b = (told.where(has_any(F.col("f"), words)).select(*keys, F.col("place").alias(f"{n}_place"), F.col("box").alias(n), F.col("c").alias(f"{n}_c")) for n, words in (("a", STRUCTURAL), ("b", FORMULA)))
    near = (F.abs(F.col("a_c") - F.col("b_c")) <= 0.02) & (F.col("b.x0") >= F.col("a.x0")) & (F.col("b.x0") - F.col("a.x1") <= 0.08)
    around = B.box(F.least("a.x0", "b.x0"), F.least("a.y0", "b.y0"), F.greatest("a.x1", "b.x1"), F.greatest("a.y1", "b.y1"))
    pairs = meet(a, b, keys).where(near).select(*keys, "a_place", "b_place", around.alias("box"))
    same = told.select(*keys, F.col("box").alias("other"), F.col("c").alias("other_c"), F.col("f").isin(*NAMES).alias("is_name"), F.col("place").alias("other_place"))

    def beside(found: DataFrame, by: list[str]) -> DataFrame:
        """Adds the first name header of the line and the left end of the next block to the right of the box."""
        met = meet(found, same, keys).where(F.abs(F.col("other_c") - B.centre(F.col("box"))) <= 0.02)
        left = F.max(F.col("is_name") & (F.col("other.x1") <= F.col("box.x0")))
        return met.groupBy(*keys, *by, "box").agg(left.alias("named"), F.min(F.when(F.col("other.x0") > F.col("box.x1"), F.col("other.x0"))).alias("right"), F.min_by("other.x1", F.when(F.col("is_name"), F.col("other_place"))).alias("name_end"))

    paired = beside(pairs, ["a_place", "b_place"]).where("named and right is not null")
    paired = paired.groupBy(*keys).agg(F.max_by(F.struct("box", "right", "name_end"), F.struct("box.y0", -F.col("a_place"), -F.col("b_place"))).alias("h"))
    paired = cut(paired)
    short = held.where((stripped(F.col("text")) != "") & (F.length(stripped(F.col("text"))) <= 40) & (F.col("box.x1") - F.col("box.x0") <= 0.25))
    lines = gap_groups(line_rows(short.select(*keys, "element_id", "text", "box"), keys), [*keys, "line"])
    parts = F.array_sort(F.collect_list(F.struct("box.x0", "element_id", stripped(F.col("text")).alias("text"))))
    lines = lines.groupBy(*keys, "line", "grp").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), B.union("box").alias("box"), F.count("*").alias("n")).where((F.col("n") > 1) & is_header(F.col("text")))
    second = lines.select(*keys, F.struct(F.lit(1).alias("kind"), F.col("line").cast("long").alias("i"), F.col("grp").cast("long").alias("j"), "box").alias("o"))
    third = held.where(is_header(F.col("text"))).select(*keys, F.struct(F.lit(2).alias("kind"), F.col("place").cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "box").alias("o"))
    rest = second.unionByName(third).groupBy(*keys).agg(F.min("o").alias("o"))
    rest = cut(meet(rest, paired.select(*keys), keys, "left_anti").select(*keys, "o.box"))
    rest = meet(rest, beside(rest, []).drop("named"), [*keys, "box"], "left")
    return paired.select(*keys, "h.*").unionByName(rest.select(*keys, "box", "right", "name_end"))


def _columns(left: Column, right: Column, of: Column) -> Column:
    return ((of["x0"] + of["x1"]) / 2).between(left, right)


def on_pages(images: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Structures under a header of a page's layout.

    Each image that begins below the header, at most 0.55 of the page lower, with its middle within 0.18 of the header's ends, is
    one, with the labels in it. A page without such images, but with a header of names and one to the right, has its structures
    in the bands of its names: names lie left of the middle between the headers; blocks of them with gaps up to 0.022 are one name, of which one block
    has three characters; a band reaches to the middles between names, the first to the header and the last to the lowest label.
    A band of two labels or more is one.
    """
    top = cut(headers(blocks, keys).select(*keys, F.col("box").alias("h"), "right", "name_end"))
    h, b = F.col("h"), F.col("box")
    under = (b["y0"] >= h["y1"]) & (b["y0"] <= h["y1"] + 0.55) & _columns(h["x0"] - 0.18, h["x1"] + 0.18, b)
    shown = meet(images.where("box is not null"), top, keys).where(under).withColumn("_at", F.struct("box.y0", "box.x0", "place"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("_at")) - 1
    shown = _labelled(shown.select(*keys, "_at", "box", "asset", F.array("image_id").alias("from_ids")), blocks, keys).select(*keys, order.alias("number"), "box", "labels", "asset", F.lit("image").alias("source"), "from_ids")
    shown = cut(shown)

    bare = meet(top.where("name_end is not null and right is not null"), shown.select(*keys).distinct(), keys, "left_anti")
    left, right = (F.col("name_end") + h["x0"]) / 2, (h["x1"] + F.col("right")) / 2
    held = meet(blocks.where("box is not null").select(*keys, "element_id", "place", "text", "box"), bare.withColumns({"low": left, "high": right}), keys).where(b["y0"] > h["y1"])
    held = cut(held)
    labels = held.where((b["y0"] < h["y1"] + 0.55) & _columns(F.col("low"), F.col("high"), b) & is_label("text"))
    lowest = labels.groupBy(*keys).agg(F.max("box.y1").alias("lowest"))
    names = meet(held, lowest, keys).where((b["y0"] <= F.col("lowest")) & ((b["x0"] + b["x1"]) / 2 < F.col("low")) & (stripped(F.col("text")) != ""))
    down = Window.partitionBy(*keys).orderBy("box.y0", "box.x0", "place")
    # within a run of names the lowest end so far is the group's: a later group begins below it
    names = names.withColumn("_ends", F.max("box.y1").over(down.rowsBetween(Window.unboundedPreceding, -1)))
    names = names.withColumn("grp", F.sum(F.when(F.col("_ends").isNull() | (b["y0"] - F.col("_ends") > 0.022), 1).otherwise(0)).over(down))
    facts = ["low", "high", "lowest", "h"]
    groups = names.groupBy(*keys, "grp", *facts).agg(F.min("box.y0").alias("y0"), F.max("box.y1").alias("y1"), F.max(F.length(stripped(F.col("text")))).alias("longest"), F.transform(F.array_sort(F.collect_list(F.struct("box.y0", "box.x0", "place", "element_id"))), lambda n: n["element_id"]).alias("from_ids")).where("longest >= 3")
    by = Window.partitionBy(*keys).orderBy("grp")
    start = F.coalesce((F.lag("y1").over(by) + F.col("y0")) / 2, h["y1"])
    stop = F.coalesce((F.col("y1") + F.lead("y0").over(by)) / 2, F.col("lowest") + 0.012)
    bands = groups.select(*keys, "grp", "low", "high", "from_ids", start.alias("start"), stop.alias("stop"))
    own = meet(bands, labels.select(*keys, "place", "text", B.centre(b).alias("c")), keys).where((F.col("c") >= F.col("start")) & (F.col("c") < F.col("stop")))
    texts = F.array_sort(F.collect_list(F.struct("place", stripped(F.col("text")).alias("text"))))
    made = own.groupBy(*keys, "grp", "low", "high", "start", "stop", "from_ids").agg(texts.alias("t")).where("size(t) >= 2")
    unit = lambda v: F.greatest(F.lit(0.0), v)
    box = B.box(unit(F.col("low")), unit(F.col("start")), F.least(F.lit(1.0), "high"), F.least(F.lit(1.0), "stop"))
    number = F.row_number().over(by) - 1
    made = made.select(*keys, number.alias("number"), box.alias("box"), F.array_distinct(F.transform("t", lambda x: x["text"])).alias("labels"), F.lit(None).cast("string").alias("asset"), F.lit("layout").alias("source"), F.col("from_ids").cast(dict(shown.dtypes)["from_ids"]))
    return shown.unionByName(made)


def enrich(tables: DataFrame, cells: DataFrame, images: DataFrame, blocks: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Structures of all pages that have none of their own (`known`, by keys): those in tables; for pages without, those of the layout."""
    own = cut(known.select(*keys).distinct())
    parts = [meet(x, own, keys, "left_anti") for x in (tables, cells, images, blocks)]
    found = cut(in_tables(*parts, keys).select(*keys, "number", "box", "labels", "asset", "source"))
    images, blocks = (meet(x, found.select(*keys).distinct(), keys, "left_anti") for x in parts[2:])
    return found.unionByName(on_pages(images, cut(blocks), keys).select(*keys, "number", "box", "labels", "asset", "source"))
