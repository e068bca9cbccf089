"""Formulas that a page shows without having them as objects: written between delimiters, or set beside an equation's number.

Blocks are rows of keys, element_id, place (their order in the page), reading (place in the reading order, null outside it),
order_index, text and box; formulas that a page has are rows of keys, latex and box.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gradus.functions import boxes as B
from gradus.functions import detect
from gradus.functions import text as T
from gradus.operators.documents import stripped
from gradus.operators.regions import cluster_rows
from gradus.operators.stages import cut

#: What stands between the formulas of a group, the signs and commands of mathematics, and what a word is.
BETWEEN = r" \quad "
SIGNS = "=<>≤≥∑∫ΓΔαβτλπ∞∂^_"
MATH_COMMANDS = ("frac", "dfrac", "sum", "int", "partial", "alpha", "beta", "gamma", "Gamma", "Delta", "infty")
_SIGNAL = re.compile("[%s]|\\\\(?:%s)" % (re.escape(SIGNS), "|".join(MATH_COMMANDS)))
_WORD, _CYRILLIC = re.compile("[A-Za-zА-Яа-яЁё]{3,}"), re.compile("[А-Яа-яЁё]{3,}")


@F.pandas_udf(ArrayType(StringType()))
def normal_forms(s: pd.Series) -> pd.Series:
    return s.map(lambda latexes: [T.latex_form(x) for x in latexes])


def _new(found: DataFrame, formulas: DataFrame, keys: list[str], serial: str) -> DataFrame:
    """Found formulas but those whose normal form is empty or, with the same box, a page has already or found before."""
    had = formulas.select(*keys, F.lit(-1).cast("long").alias("_s"), T.norm_latex(F.coalesce("latex", F.lit(""))).alias("_normal"), "box")
    mine = found.select(*keys, F.col(serial).cast("long").alias("_s"), T.norm_latex("latex").alias("_normal"), "box").where("_normal <> ''")
    both = had.unionByName(mine).groupBy(*keys, "_normal", "box").agg(F.min("_s").alias(serial)).where(F.col(serial) >= 0)  # null boxes are alike
    return found.join(both.select(*keys, serial), [*keys, serial], "left_semi")


def explicit(blocks: DataFrame, formulas: DataFrame, keys: list[str]) -> DataFrame:
    """Displayed formulas between delimiters: keys, serial, kind, latex, box, order_index, wrapper, source_ids.

    Blocks of a page are one sequence: in reading order, then by order_index, then from top to bottom, then in page order. First come
    all formulas, each with its block's box, then groups: numbered runs within a block, and runs over neighbouring blocks that hold
    nothing but formulas, two at least, one of them numbered; a block that is an equation's number belongs to the run before
    it and numbers it. A group that repeats another's formulas is the same. What a page has already, or that was found before, is left out.

    A page's blocks meet in one window, as a page's text does in its layout; runs are gaps and islands there.
    """
    b = F.col("box")
    at = F.coalesce("reading", "order_index", F.lit(0)).cast("double")
    kind = F.when(F.col("reading").isNotNull(), 0).when(F.col("order_index").isNotNull(), 1).when(b.isNotNull(), 2).otherwise(3)
    low = F.when(kind == 2, F.struct(b["y0"].alias("y"), b["x0"].alias("x"))).otherwise(F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("x")))
    order = Window.partitionBy(*keys).orderBy(kind, F.when(kind < 2, at).otherwise(0.0), low["y"], low["x"], "place")
    held = blocks.select(*keys, "element_id", "order_index", "box", "text", F.row_number().over(order).alias("n"), detect.math_of_block("text").alias("m"))
    held = cut(held.select(*keys, "element_id", "order_index", "box", "n", "m.spans", "m.only", "m.runs", F.regexp_like(stripped(F.col("text")), F.lit(f"^{detect.NUMBER}$")).alias("number")))

    found = held.select(*keys, "element_id", "order_index", "box", "n", F.posexplode("spans").alias("k", "s"))
    whole = Window.partitionBy(*keys)
    single = found.select(*keys, (F.row_number().over(whole.orderBy("n", "k")) - 1).alias("serial"), F.lit("explicit").alias("kind"), "s.latex", "box", "order_index", "s.wrapper", F.array("element_id").alias("source_ids"))

    inside = held.where(F.size("runs") > 0).select(*keys, F.lit(0).alias("across"), "n", F.posexplode("runs").alias("k", "latexes"), F.col("box"), "order_index", F.array("element_id").alias("source_ids"))
    full = F.col("only") & (F.size("spans") > 0)
    # a run breaks at every block that is neither full of formulas nor a number
    island = F.sum(F.when(full | F.col("number"), 0).otherwise(1)).over(whole.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    runs = held.withColumn("island", island).where(full | F.col("number")).withColumn("first", F.min(F.when(full, F.col("n"))).over(Window.partitionBy(*keys, "island"))).where("n >= first")
    parts = F.array_sort(F.collect_list(F.when(full, F.struct("n", "spans", "element_id"))))
    numbered = F.max(F.when(full, F.exists("spans", lambda s: s["numbered"])).otherwise(F.lit(True)))
    across = runs.withColumn("order_index", F.when(full, F.col("order_index"))).withColumn("box", F.when(full, b)).groupBy(*keys, "island").agg(
        F.min("n").alias("n"), parts.alias("p"), numbered.alias("numbered"), B.union("box").alias("box"), F.min("order_index").alias("order_index")
    )
    latexes = F.flatten(F.transform("p", lambda p: F.transform(p["spans"], lambda s: s["latex"])))
    ids = F.flatten(F.transform("p", lambda p: F.transform(p["spans"], lambda s: p["element_id"])))
    across = across.where("numbered").select(*keys, F.lit(1).alias("across"), "n", F.lit(0).alias("k"), latexes.alias("latexes"), "box", "order_index", ids.alias("source_ids")).where("size(latexes) > 1")

    groups = inside.unionByName(across).withColumn("g", F.row_number().over(whole.orderBy("across", "n", "k")))
    groups = groups.withColumn("_n", normal_forms("latexes")).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_n").orderBy("g"))).where("_r = 1")
    many = single.groupBy(*keys).agg(F.count("*").alias("many"))
    groups = groups.join(many, keys).withColumn("serial", F.col("many").cast("int") + F.row_number().over(whole.orderBy("g")) - 1)
    groups = groups.select(*keys, "serial", F.lit("group").alias("kind"), F.array_join("latexes", BETWEEN).alias("latex"), "box", "order_index", F.lit(None).cast("string").alias("wrapper"), "source_ids")
    every = cut(single.unionByName(groups))
    return _new(every, formulas, keys, "serial")


def traits(text: str) -> tuple[bool, bool]:
    """Whether a row is mathematical (a sign, or a short row with few words and a digit or operator), and whether it is prose."""
    text = text.strip()
    words = len(_WORD.findall(text))
    short = bool(text) and len(text) <= 30 and words <= 2 and any(c.isascii() and c.isdigit() or c in "()+-*/" for c in text)
    return _SIGNAL.search(text) is not None or short, len(_CYRILLIC.findall(text)) >= 3 or len(text) > 50 and words >= 6


def _beside_numbers(x0, y0, x1, y1, text: list[str]):
    """(anchor, chosen blocks) of a page's blocks with boxes, in page order."""
    middle, tall = (y0 + y1) / 2, y1 - y0
    order = np.lexsort((np.arange(len(text)), x0, middle))
    line = cluster_rows(middle[order], tall[order], nearest=False, back=4, tolerance=lambda h: max(0.006, 0.55 * h), stop=None)
    members = np.split(order[np.argsort(line, kind="stable")], np.cumsum(np.bincount(line))[:-1])
    centre = np.array([middle[r].mean() for r in members])
    rows = [r[np.argsort(x0[r], kind="stable")] for r in members]
    prose_block = [traits(t)[1] for t in text]
    for anchor in (i for i, t in enumerate(text) if detect.EQUATION_NUMBER.fullmatch(t.strip())):
        own = middle[anchor]

        def view(k):
            left = [i for i in rows[k] if i != anchor and x0[i] < x0[anchor] + 0.02]
            joined = " ".join(text[i] for i in left)
            return left, joined, *traits(joined)

        near = [k for k in np.flatnonzero(np.abs(centre - own) <= 0.055) if (v := view(k))[2] and not v[3]]
        if not any(-0.02 <= x0[anchor] - x1[i] <= 0.25 for k in near for i in view(k)[0]):
            continue
        chosen, last = set(near), own
        for k in range(int(np.argmin(np.abs(centre - own))) + 1, len(rows)):
            left, joined, mathematical, prose = view(k)
            below = centre[k] - own
            if below > 0.22 or centre[k] - last > 0.045 or below > 0.055 and (prose or not mathematical and len(joined) > 18):
                break
            if not prose and (mathematical or len(joined) <= 18):
                chosen.add(k)
                last = centre[k]
        some = sorted((i for k in sorted(chosen) for i in view(k)[0] if not prose_block[i]), key=lambda i: (middle[i], x0[i]))
        once = list({(text[i], x0[i], y0[i], x1[i], y1[i]): i for i in reversed(some)}.values())[::-1]
        if once and _SIGNAL.search(" ".join(text[i] for i in once)):
            yield anchor, once


def beside_numbers(blocks: DataFrame, formulas: DataFrame, keys: list[str]) -> DataFrame:
    """Formulas by layout, on pages without any: keys, serial (of its number among the page's), number, text, box, order_index, source_ids.

    Blocks with boxes make rows. Around each block that is an equation's number, mathematical rows within 0.055 of its height belong to it if
    one of their blocks ends close to its left; then the rows below, as long as they follow within 0.045, reach no further than 0.22 down and are
    mathematical or short. Of these rows all blocks left of the number but prose make the formula, each once.
    Only a page's own blocks meet, in one task a page; numbers look at rows, not at all pairs of blocks.
    """
    bare = blocks.join(formulas.select(*keys).distinct(), keys, "left_anti").where((stripped(F.col("text")) != "") & F.col("box").isNotNull())
    flat = bare.select(*keys, "place", "element_id", "order_index", "text", "box.x0", "box.y0", "box.x1", "box.y1")
    kinds = dict(flat.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"serial int, number string, text string, x0 double, y0 double, x1 double, y1 double, order_index double, source_ids array<{kinds['element_id']}>"])

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("place", kind="stable").reset_index(drop=True)
        box, text = page[["x0", "y0", "x1", "y1"]].to_numpy(float).T, page["text"].tolist()
        numbers = [i for i, t in enumerate(text) if detect.EQUATION_NUMBER.fullmatch(t.strip())]
        out = []
        for anchor, some in _beside_numbers(*box, text) if numbers else ():
            both = [*some, anchor]
            index = page["order_index"].iloc[some].min()
            index = page["order_index"].iloc[anchor] if pd.isna(index) else index
            sides = [f(side[both]) for f, side in zip((np.min, np.min, np.max, np.max), box)]
            out.append((*(page[k].iloc[0] for k in keys), numbers.index(anchor), text[anchor].strip(), " ".join(text[i] for i in some).strip(), *sides, index, page["element_id"].iloc[some].tolist()))
        return pd.DataFrame(out, columns=[*keys, "serial", "number", "text", "x0", "y0", "x1", "y1", "order_index", "source_ids"])

    found = flat.groupBy(*keys).applyInPandas(run, schema)
    box = B.box(*map(F.col, ("x0", "y0", "x1", "y1")))
    found = found.select(*keys, "serial", "number", F.col("text").alias("latex"), box.alias("box"), F.col("order_index").cast("int").alias("order_index"), "source_ids")
    return _new(cut(found), formulas, keys, "serial").withColumnRenamed("latex", "text")


def enrich(blocks: DataFrame, formulas: DataFrame, keys: list[str]) -> DataFrame:
    """Formulas between delimiters of all pages, then formulas by layout of the pages that still have none: keys, kind, serial, latex (of the
    first), text, box, order_index, source_ids."""
    written = cut(explicit(blocks, formulas, keys))
    had = formulas.select(*keys, "latex", "box").unionByName(written.select(*keys, "latex", "box"))
    laid = beside_numbers(blocks, had, keys)
    out = ["kind", "serial", "latex", "text", "box", "order_index", "source_ids"]
    one = written.withColumn("text", F.col("latex")).select(*keys, *out)
    return one.unionByName(laid.withColumns({"kind": F.lit("layout"), "latex": F.lit(None).cast("string")}).select(*keys, *out))
