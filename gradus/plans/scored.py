"""Registered queries of object scores, over pairs of neighbouring parts as reference and prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions import scoring as S
from gradus.plans import views as V
from gradus.plans.registry import query, rounded

TYPES = list(S.KINDS)


def _box(c: str):
    x, y = (F.col(f"{c}.p_partkey") % 7) / 10.0, (F.col(f"{c}.p_partkey") % 5) / 10.0
    return F.struct(x.alias("x0"), y.alias("y0"), (x + 0.1 + (F.col(f"{c}.p_size") % 10) / 40.0).alias("x1"), (y + 0.1 + (F.col(f"{c}.p_size") % 7) / 40.0).alias("y1"))


def _payload(c: str):
    n, size, name = F.col(f"{c}.p_partkey"), F.col(f"{c}.p_size"), F.col(f"{c}.p_name")
    cell = lambda r, k, head: F.struct(F.lit(r).alias("row"), F.lit(k).alias("col"), F.lit(1).alias("rowspan"), F.when(size % 6 == 0, 1 + F.lit(k)).otherwise(1).alias("colspan"), F.lit(head).alias("header"), F.concat_ws(" ", name, F.lit(str(k))).alias("text"))
    cells = F.array(cell(0, 0, True), cell(0, 1, True), cell(1, 0, False), cell(1, 1, False))
    size_text = size.cast("string")
    return F.struct(
        F.concat_ws(" ", name, F.col(f"{c}.p_type"), F.col(f"{c}.p_brand")).alias("text"),
        F.slice(F.array(*[F.lit(x) for x in "abcdef"]), (n % 3 + 1).cast("int"), (size % 4 + 1).cast("int")).alias("reading_order"),
        F.lit(2).alias("rows"), F.lit(2).alias("columns"), F.slice(cells, 1, (size % 4 + 1).cast("int")).alias("cells"),
        F.concat(F.lit("\\dfrac{x_"), size_text, F.lit("}{"), (n % 3).cast("string"), F.lit("} + \\alpha")).alias("latex"), F.lit(None).cast("string").alias("normalized_latex"),
        F.concat(F.lit("Fe"), (n % 3 + 1).cast("string"), F.lit("(SO₄)"), (size % 3 + 1).cast("string")).alias("formula"),
        _box(c).alias("box"), F.array(name, F.col(f"{c}.p_brand")).alias("labels"), (size % 3 > 0).alias("extracted"),
        F.when(size % 4 > 0, F.concat_ws(" ", name, F.col(f"{c}.p_type"))).alias("caption"),
        F.array(name, F.col(f"{c}.p_type")).alias("text_elements"), F.slice(F.array(name, F.col(f"{c}.p_brand")), 1, (size % 3).cast("int")).alias("key_elements"), (size % 3).cast("int").alias("subfigures"),
    ).cast(S.PAYLOAD)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a reference object of the type that its key tells, with the next part as its prediction; one in five was missed."""
    p = V.table(spark, sf_dir, "part")
    a, b = p.alias("a"), p.alias("b")
    j = V.spread(a.join(b.hint("merge"), (F.col("b.p_partkey") == F.col("a.p_partkey") + 1) & (F.col("a.p_size") % 5 > 0), "left"), "a.p_partkey")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("a.p_partkey") % len(TYPES) + 1).cast("int"))
    counted = lambda m, k: F.when(F.col("a.p_size") % 3 > 0, (F.col("a.p_size") % m).cast("int")).alias(k)
    context = F.struct(F.when(F.col("a.p_size") % 7 == 0, "exhaustive_page_f1_v1").when(F.col("a.p_size") % 7 == 1, "sampled_gt_recall_v1").alias("policy"), counted(4, "tp"), counted(3, "fp"), counted(2, "fn")).cast(S.CONTEXT)
    return j.select(F.col("a.p_partkey").alias("object_id"), kind.alias("object_type"), _payload("a").alias("reference"), F.when(F.col("b.p_partkey").isNotNull(), _payload("b")).alias("prediction"), context.alias("context"))


_PAIRS = """v AS (SELECT a.p_partkey AS object_id, b.p_partkey IS NOT NULL AS there, b.p_size % 3 > 0 AS extracted, a.p_size AS size, a.p_name AS an, b.p_name AS bn, a.p_brand AS ab, b.p_brand AS bb,
    CASE WHEN a.p_size % 4 > 0 THEN a.p_name || ' ' || a.p_type END AS ac, CASE WHEN b.p_size % 4 > 0 THEN b.p_name || ' ' || b.p_type ELSE '' END AS bc,
    (a.p_partkey % 7) / 10.0::DOUBLE AS ax0, (a.p_partkey % 5) / 10.0::DOUBLE AS ay0, ax0 + 0.1::DOUBLE + (a.p_size % 10) / 40.0::DOUBLE AS ax1, ay0 + 0.1::DOUBLE + (a.p_size % 7) / 40.0::DOUBLE AS ay1,
    (b.p_partkey % 7) / 10.0::DOUBLE AS bx0, (b.p_partkey % 5) / 10.0::DOUBLE AS by0, bx0 + 0.1::DOUBLE + (b.p_size % 10) / 40.0::DOUBLE AS bx1, by0 + 0.1::DOUBLE + (b.p_size % 7) / 40.0::DOUBLE AS by1
    FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1 AND a.p_size % 5 > 0)"""
_IOU = """i AS (SELECT *, greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0)) AS shared,
    CASE WHEN there THEN shared / ((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - shared) ELSE 0.0 END AS iou, CASE WHEN there THEN 1.0 ELSE 0.0 END AS detection, CASE WHEN there AND extracted THEN 1.0 ELSE 0.0 END AS extraction FROM v)"""
_F1 = "CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len(list_intersect({a}, {b})) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


@query("SELECT object_id, round(iou, 6) AS iou, round(c, 6) AS caption, round((0.3 * detection + 0.25 * iou + 0.25 * extraction + coalesce(0.2 * c, 0)) / CASE WHEN c IS NULL THEN 0.8 ELSE 1.0 END, 6) AS image_score FROM c", _PAIRS, _IOU,
       "w AS (SELECT *, CASE WHEN there THEN bc ELSE '' END AS pc, string_split(ac, ' ') AS aw, CASE WHEN pc = '' THEN [] ELSE string_split(pc, ' ') END AS bw FROM i)",
       f"c AS (SELECT *, CASE WHEN ac IS NOT NULL THEN ({_F1.format(a='aw', b='bw')} + 1 - levenshtein(ac, pc) / greatest(length(ac), length(pc))) / 2 END AS c FROM w)")
def image_metrics(spark, sf_dir):
    """Place, extraction and caption of each part taken as an image."""
    m = matches(spark, sf_dir)
    r, p = F.col("reference"), F.col("prediction")
    x = S.image_parts(r["box"], p["box"], r["caption"], p["caption"], p.isNotNull(), p["extracted"])
    return rounded(m.select("object_id", *[x[k].alias(k) for k in ("iou", "caption", "image_score")]))


@query("SELECT object_id, round(iou, 6) AS iou, round(f, 6) AS label_f1, round(CASE WHEN there THEN (0.25 * iou + 0.25 * f + 0.2 * extraction) / 0.7 END, 6) AS structured_extraction, round(0.3 * detection + 0.25 * iou + 0.25 * f + 0.2 * extraction, 6) AS chem_structure_score FROM f", _PAIRS, _IOU,
       "w AS (SELECT *, string_split(an || ' ' || ab, ' ') AS aw, CASE WHEN there THEN string_split(bn || ' ' || bb, ' ') ELSE [] END AS bw FROM i)", f"f AS (SELECT *, {_F1.format(a='aw', b='bw')} AS f FROM w)")
def chem_structure(spark, sf_dir):
    """Place, labels and extraction of each part taken as a chemical structure."""
    m = matches(spark, sf_dir)
    r, p = F.col("reference"), F.col("prediction")
    x = S.structure_parts(r["box"], p["box"], r["labels"], p["labels"], p.isNotNull(), p["extracted"])
    return rounded(m.select("object_id", *[x[k].alias(k) for k in ("iou", "label_f1", "structured_extraction", "chem_structure_score")]))


@query("""SELECT object_id, coalesce(policy, CASE WHEN tp IS NOT NULL THEN 'legacy_exhaustive_page_f1' ELSE 'object_presence_recall' END) AS policy,
    round(CASE WHEN tp IS NOT NULL AND coalesce(policy, 'exhaustive_page_f1_v1') = 'exhaustive_page_f1_v1' THEN CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END WHEN there THEN 1.0 ELSE 0.0 END, 6) AS detection FROM x""", _PAIRS,
       "x AS (SELECT *, CASE size % 7 WHEN 0 THEN 'exhaustive_page_f1_v1' WHEN 1 THEN 'sampled_gt_recall_v1' END AS policy, CASE WHEN size % 3 > 0 THEN size % 4 END AS tp, CASE WHEN size % 3 > 0 THEN size % 3 END AS fp, CASE WHEN size % 3 > 0 THEN size % 2 END AS fn FROM v)")
def detection_policy(spark, sf_dir):
    """Which rule scores the detection of each object, and what it gives."""
    score, _, name = S.detection_by_policy(F.col("context"), F.col("prediction").isNotNull())
    return rounded(matches(spark, sf_dir).select("object_id", name.alias("policy"), score.alias("detection")))


def _parts(spark, sf_dir, parts) -> DataFrame:
    r, p = F.col("reference"), F.col("prediction")
    return rounded(matches(spark, sf_dir).select("object_id", *[v.cast("double").alias(k) for k, v in parts(r, p).items()]))


@query()
def diagram_metrics(spark, sf_dir):
    return _parts(spark, sf_dir, lambda r, p: S.diagram_parts(r, p, p.isNotNull()))


@query()
def math_metrics(spark, sf_dir):
    return _parts(spark, sf_dir, lambda r, p: S.math_parts(r["latex"], p["latex"], r["normalized_latex"], p["normalized_latex"]))


@query()
def chem_linear(spark, sf_dir):
    return _parts(spark, sf_dir, lambda r, p: S.formula_parts(r["formula"], p["formula"]))


@query()
def table_metrics(spark, sf_dir):
    return _parts(spark, sf_dir, lambda r, p: S.table_parts(*(x[k] for x in (r, p) for k in ("rows", "columns", "cells"))))


@query()
def evaluate_object(spark, sf_dir):
    """Every part scored by the rules of its type."""
    return rounded(S.evaluate_objects(matches(spark, sf_dir)).select("object_id", "object_type", "category", "subtype", "matched", "policy", "object_score"))


@query()
def metric_rows(spark, sf_dir):
    """Long form of all metrics of all objects."""
    out = S.metric_records(S.evaluate_objects(matches(spark, sf_dir)))
    return rounded(out.select("object_id", "object_type", "metric_name", "raw_value", "metric_value", "higher_is_better"))
