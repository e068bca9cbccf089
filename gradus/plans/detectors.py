"""Registered queries of detectors over pages that the parts are laid out on."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions import boxes as B
from gradus.operators import formulas as M
from gradus.operators import structures as S
from gradus.plans import views as V
from gradus.plans.registry import query, rounded


def _box(*sides):
    return B.box(*[F.lit(v) if isinstance(v, float) else v for v in sides])


def catalogue(spark, sf_dir) -> dict:
    """Pages of six parts each, by turns: tables with a column of structures, with its header in two cells, without one but with
    marked cells; images under a header; names and labels under a header. tables, cells, images, blocks, by page."""
    p = V.table(spark, sf_dir, "part")
    page, i = F.floor(F.col("p_partkey") / 6), (F.col("p_partkey") % 6).cast("int")
    p = p.select(page.alias("page"), i.alias("i"), (page % 5).cast("int").alias("k"), "p_partkey", "p_name", "p_size", "p_retailprice", ((F.col("p_partkey") % 8) / 100.0).alias("shift")).repartition("page")
    k, size = F.col("k"), F.col("p_size")
    wide = F.when(k == 1, 4).otherwise(3)
    tables = p.where("k < 3").groupBy("page", "k").agg(F.min("p_partkey").alias("least")).select(
        "page", F.lit("t").alias("table_id"), F.lit(0).cast("long").alias("place"), F.lit(13).alias("rows"), wide.alias("columns"), F.when(F.col("least") % 4 > 0, _box(0.1, 0.1, 0.9, 0.75)).alias("box"),
        F.concat(F.lit("<table><img src='a.png'><IMG alt='' src=\"b"), F.col("page"), F.lit(".png\"></table>")).alias("html"),
    )

    def cell(row, col, text):
        row, col = F.lit(row) if isinstance(row, int) else row, F.lit(col) if isinstance(col, int) else col
        x0, y0 = 0.1 + 0.8 * col / wide, 0.1 + 0.05 * row
        box = F.when(F.col("p_partkey") % 7 > 0, _box(x0, y0, x0 + 0.8 / wide - 0.01, y0 + 0.04))
        return F.struct((row * 10 + col).cast("long").alias("place"), row.cast("int").alias("row"), col.cast("int").alias("col"), text.cast("string").alias("text"), box.alias("box"))

    written = F.element_at(F.array(F.lit(""), F.concat(F.lit("Structure : R"), size), size.cast("string"), F.lit("N")), size % 4 + 1)
    marked = F.when(k == 2, F.when(size % 2 == 0, "Structure: OH").otherwise("free")).otherwise(written)
    start = 1 + 2 * F.col("i")
    body = [cell(start, 0, F.when(F.col("p_partkey") % 11 > 0, F.col("p_name")).otherwise(" ")), cell(start, 1, marked), cell(start, wide - 1, F.col("p_retailprice")), cell(start + 1, 1, F.lit(""))]
    titles = [cell(0, 0, F.lit("Name")), cell(0, 1, F.when(k == 0, "Structural  formula").when(k == 1, "Structural").otherwise("Drawing")), cell(0, 2, F.when(k == 1, "formula").otherwise("Mass")), cell(0, 3, F.lit("Mass"))]
    heads = F.filter(F.when(F.col("i") == 0, F.array(*titles)).otherwise(F.array().cast(f"array<struct<place: bigint, row: int, col: int, text: string, box: {S.BOX}>>")), lambda c: c["col"] < wide)
    cells = p.where("k < 3").select("page", F.lit("t").alias("table_id"), F.explode(F.concat(F.array(*body), heads)).alias("c")).select("page", "table_id", "c.*")

    y = F.when(k < 3, 0.15 + 0.1 * F.col("i")).otherwise(0.22 + 0.09 * F.col("i"))
    images = p.where((size % 3 == 0) & (k != 4)).select("page", F.col("p_partkey").alias("image_id"), F.col("p_partkey").alias("place"), F.when(size % 2 == 0, F.concat(F.lit("i"), "p_partkey")).alias("asset"), _box(0.38 + F.col("shift"), y, 0.5 + F.col("shift"), y + 0.07).alias("box"))
    label = F.element_at(F.array(*map(F.lit, ("N", "OH ", "CH3", "=O", "12", "plain text"))), size % 6 + 1)
    block = lambda at, n, text, box: F.struct((at * 10 + n).alias("place"), text.cast("string").alias("text"), box.alias("box"))
    at = F.col("p_partkey")
    own = F.array(
        block(at, 1, label, _box(0.42 + F.col("shift"), y + 0.01, 0.44 + F.col("shift"), y + 0.03)), block(at, 2, F.lit("N"), F.when(size % 5 > 0, _box(0.45, y + 0.02, 0.47, y + 0.04))),
        block(at, 3, F.when(k > 2, F.substring("p_name", 1, 12)), F.when(k > 2, _box(0.05, y, 0.2, y + 0.02 + F.col("shift") / 4))), block(at, 4, F.when((k == 4) & (size % 2 == 0), "O"), _box(0.5, y + 0.03, 0.52, y + 0.05)),
    )
    top = F.array(
        block(F.lit(0), 1, F.lit("Name"), _box(0.05, 0.15, 0.12, 0.17)), block(F.lit(0), 2, F.lit("Structural"), _box(0.4, 0.15, 0.47, 0.17)),
        block(F.lit(0), 3, F.lit("formula"), _box(0.48, 0.15, 0.55, 0.17)), block(F.lit(0), 4, F.when(F.col("page") % 3 > 0, "Mass"), _box(0.8, 0.15, 0.9, 0.17)), block(F.lit(0), 5, F.lit("Structural formula of all"), _box(0.1, 0.02, 0.9, 0.05)),
    )
    blocks = p.select("page", F.explode(F.when((k > 2) & (F.col("i") == 1), F.concat(own, top)).otherwise(own)).alias("b")).select("page", "b.*").where("text is not null")
    return {"tables": tables, "cells": cells, "images": images, "blocks": blocks.withColumn("element_id", F.col("place"))}


def _shown(df):
    b = F.col("box")
    return rounded(df.select("page", "number", "source", F.array_join("labels", "|").alias("labels"), "asset", *[b[n].alias(n) for n in ("x0", "y0", "x1", "y1")], *[c for c in df.columns if c == "name"]))


@query()
def det_chem_table(spark, sf_dir):
    """Structures in the tables of pages of parts."""
    return _shown(S.in_tables(**catalogue(spark, sf_dir), keys=["page"]))


@query()
def det_chem_page(spark, sf_dir):
    """Structures under the headers of pages of parts."""
    c = catalogue(spark, sf_dir)
    return _shown(S.on_pages(c["images"], c["blocks"], ["page"]))


@query()
def det_chem_enrich(spark, sf_dir):
    """Structures of all pages but every seventh, which has its own."""
    c = catalogue(spark, sf_dir)
    return _shown(S.enrich(**c, known=c["blocks"].where("page % 7 = 0"), keys=["page"]))


def sheets(spark, sf_dir):
    """Pages of sixteen parts each as blocks: formulas between delimiters, numbers, prose; on every third page rows of plain mathematics and
    numbers to their right. Every fifth page has formulas of its own."""
    p = V.table(spark, sf_dir, "part")
    i, page, size = (F.col("p_partkey") % 16).cast("int"), F.floor(F.col("p_partkey") / 16), F.col("p_size")
    k = size % 8
    number = F.concat(F.lit("("), F.col("p_partkey") % 1000, F.lit(")"))
    written = (
        F.when(k == 0, F.concat(F.lit("$$x_"), size % 3, F.lit(" = "), size % 5, F.lit("$$"))).when(k == 1, F.concat(F.lit("\\[ a + b_{"), size % 3, F.lit("} \\]")))
        .when(k == 2, number).when(k == 3, F.col("p_name")).when(k == 4, F.lit("see $x$ here")).when(k == 5, F.concat(F.lit("$$a$$\n$$b_"), size % 3, F.lit("$$ (2)")))
        .when(k == 6, F.concat(F.lit("\\( y = "), size % 4, F.lit(" \\), (3)"))).otherwise(F.lit("$$q$$"))
    )
    plain = F.element_at(F.array(F.concat(F.lit("x = "), size), number, F.concat(F.lit("2 + "), size), F.lit("слово другое третье"), F.col("p_brand"), number, F.lit("∑ y"), F.concat_ws(" and ", "p_name", "p_name", "p_name")), k + 1)
    laid = page % 3 == 2
    y = 0.05 + 0.028 * i + F.col("p_partkey") % 3 / 400.0
    x = F.when(laid & k.isin(1, 5), 0.6 + i / 200.0).otherwise(0.1 + k / 15.0)
    box = F.when(size % 11 > 0, B.box(x, y, x + F.when(laid & k.isin(1, 5), 0.05).otherwise(0.3), y + 0.02))
    blocks = p.select(page.alias("page"), F.col("p_partkey").alias("element_id"), F.col("p_partkey").alias("place"), F.when(size % 3 > 0, (i * 7) % 16).alias("reading"), F.when(size % 4 > 0, i).alias("order_index"), F.when(laid, plain).otherwise(written).alias("text"), box.alias("box"))
    own = blocks.where((F.col("page") % 5 == 0) & (F.col("place") % 8 == 0)).select("page", F.lit("x_{0}=0").alias("latex"), "box")
    return blocks, own


def _formulas(df):
    b = F.col("box")
    return rounded(df.select("page", *[c for c in ("kind", "serial", "latex", "text", "number", "wrapper", "order_index") if c in df.columns], *[b[n].alias(n) for n in ("x0", "y0", "x1", "y1")], F.concat_ws(",", F.col("source_ids").cast("array<string>")).alias("source_ids")))


@query()
def det_math_explicit(spark, sf_dir):
    """Formulas between delimiters on pages of parts, and their numbered groups, within blocks and across."""
    return _formulas(M.explicit(*sheets(spark, sf_dir), ["page"]))


@query()
def det_math_layout(spark, sf_dir):
    """Formulas beside numbers on the pages of parts that have none of their own."""
    return _formulas(M.beside_numbers(*sheets(spark, sf_dir), ["page"]))


@query()
def det_math_enrich(spark, sf_dir):
    return _formulas(M.enrich(*sheets(spark, sf_dir), ["page"]))
