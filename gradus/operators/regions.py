"""Matching of a document: one-to-one by place or content, and text regions made of several blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions import boxes as B
from gradus.functions.metrics import box_ios, box_iou, edit_similarity
from gradus.operators.matching import assignment
from gradus.operators.stages import cut, meet

VISUAL = ("image", "diagram", "chemical_structure")


def scored_pairs(truth: DataFrame, found: DataFrame, keys: list[str], least_iou: float = 0.10, least_alike: float = 0.25) -> DataFrame:
    """Pairs of equal keys that may match: by IoU where both have boxes, by edits of their texts where one has none (never for visual types).

    truth: keys, gt_id, box, text; found: keys, cand_id, box, text; keys hold object_type.
    """
    pairs = truth.select(*keys, "gt_id", F.col("box").alias("a"), F.col("text").alias("at")).join(found.select(*keys, "cand_id", F.col("box").alias("b"), F.col("text").alias("bt")), keys)
    placed = F.col("a").isNotNull() & F.col("b").isNotNull()
    near = pairs.where(placed).withColumn("score", box_iou(F.col("a"), F.col("b"))).where(F.col("score") >= least_iou).withColumn("method", F.lit("bbox_iou"))
    told = pairs.where(~placed & ~F.col("object_type").isin(*VISUAL)).withColumn("score", edit_similarity(F.coalesce("at", F.lit("")), F.coalesce("bt", F.lit("")))).where(F.col("score") >= least_alike).withColumn("method", F.lit("content_similarity"))
    return near.unionByName(told).select(*keys, "gt_id", "cand_id", "score", "method")


def assign_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of scored pairs, the one-to-one choice of greatest total within each group of equal keys (one page's objects of a type)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        g, c = np.unique(rows["gt_id"]), np.unique(rows["cand_id"])
        w = np.full((len(g), len(c)), -1.0)
        w[np.searchsorted(g, rows["gt_id"]), np.searchsorted(c, rows["cand_id"])] = rows["score"]
        hit = {(g[i], c[j]) for i, j in enumerate(assignment(w)) if j >= 0}
        return rows[[k in hit for k in zip(rows["gt_id"], rows["cand_id"])]]

    return pairs.groupBy(*keys).applyInPandas(run, pairs.schema)


def ordered_blocks(blocks: DataFrame, group: list[str]) -> DataFrame:
    """Blocks with `at`, their place: by reading position, then order index, then from top left; equal texts of equal boxes once, the first one; empty texts not at all."""
    tier = F.when(F.col("position").isNotNull(), 0).when(F.col("order_index").isNotNull(), 1).otherwise(2)
    key = [tier, F.coalesce(F.col("position").cast("double"), F.col("order_index").cast("double"), F.col("box.y0")), F.when(tier == 2, F.col("box.x0")).otherwise(0.0), F.col("cand_id")]
    rows = blocks.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    same = Window.partitionBy(*group, F.trim("text"), "box").orderBy(*key)
    rows = rows.withColumn("_n", F.row_number().over(same)).where(F.col("box").isNull() | (F.col("_n") == 1)).drop("_n")
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(*group).orderBy(*key)))


def text_aggregate(blocks: DataFrame, group: list[str]) -> DataFrame:
    """One text a group of blocks: lines in reading order, the box around all, the ids it was made of."""
    rows = ordered_blocks(blocks, group)
    parts = F.array_sort(F.collect_list(F.struct("at", F.trim("text").alias("text"), "cand_id")))
    out = rows.groupBy(*group).agg(parts.alias("parts"), B.union("box").alias("box"), F.max("overlap").alias("overlap"))
    return out.select(*group, F.array_join(F.col("parts.text"), "\n").alias("text"), "box", F.col("parts.cand_id").alias("source_ids"), "overlap")


def match_document(truth: DataFrame, found: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """One row a reference object, matched or not: keys, gt_id, matched, method, score, cand_id, text, source_ids.

    Text regions whose block leaves some of them out, or that have none, take the free blocks that lie in them (by half
    of the smaller box at least), each block in one region only: most overlap, then IoU, then the smallest gt_id. A
    block that holds the whole region stays alone. Pairs, regions and owned blocks are worked out once. found also has position (in the reading order) and order_index.
    """
    hits = cut(assign_pairs(scored_pairs(truth, found, keys), keys))
    blocks = found.select(*keys, "cand_id", "box", "text", "position", "order_index")
    one = hits.join(blocks.select(*keys, "cand_id", F.col("box").alias("anchor"), "text"), [*keys, "cand_id"])
    regions = truth.where("object_type = 'text' and box is not null").select(*keys, "gt_id", F.col("box").alias("region")).join(one.select(*keys, "gt_id", F.col("cand_id").alias("anchor_id"), "anchor"), [*keys, "gt_id"], "left")
    whole = F.col("anchor_id").isNotNull() & (F.col("anchor").isNull() | B.contains(F.col("anchor"), F.col("region")) | (box_ios(F.col("region"), F.col("anchor")) < least))
    regions = cut(regions.where(~F.coalesce(whole, F.lit(False))))
    free = blocks.where("object_type = 'text' and box is not null and trim(coalesce(text, '')) <> ''").join(hits.select(*keys, "cand_id"), [*keys, "cand_id"], "left_anti")
    pairs = free.join(regions, keys).withColumn("overlap", box_ios(F.col("region"), F.col("box"))).withColumn("iou", box_iou(F.col("region"), F.col("box"))).where(F.col("overlap") >= least)
    pairs = pairs.where(F.col("anchor_id").isNull() | (~B.contains(F.col("box"), F.col("region")) & B.extends(F.col("region"), F.col("anchor"), F.col("box"))))
    first = Window.partitionBy(*keys, "cand_id").orderBy(F.desc("overlap"), F.desc("iou"), "gt_id")
    owned = pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*keys, "gt_id", "anchor_id", "cand_id", "box", "text", "position", "order_index", "overlap")
    owned = cut(owned)
    grown = owned.select(*keys, "gt_id", "anchor_id").distinct()
    anchors = grown.where("anchor_id is not null").join(blocks.withColumnRenamed("cand_id", "anchor_id"), [*keys, "anchor_id"]).join(regions.select(*keys, "gt_id", "region"), [*keys, "gt_id"])
    anchors = anchors.select(*keys, "gt_id", "anchor_id", F.col("anchor_id").alias("cand_id"), "box", "text", "position", "order_index", box_ios(F.col("region"), F.col("box")).alias("overlap"))
    made = text_aggregate(owned.unionByName(anchors), [*keys, "gt_id", "anchor_id"]).where("anchor_id is null or array_contains(source_ids, anchor_id)")
    made = made.select(*keys, "gt_id", F.col("text").alias("joined"), "source_ids", "overlap")
    out = truth.select(*keys, "gt_id").join(one.drop("anchor"), [*keys, "gt_id"], "left").join(made, [*keys, "gt_id"], "left")
    many = F.col("source_ids").isNotNull()
    return out.select(*keys, "gt_id", (many | F.col("cand_id").isNotNull()).alias("matched"), F.when(many, "text_multiblock").otherwise(F.col("method")).alias("method"), F.coalesce(F.when(many, F.col("overlap")).otherwise(F.col("score")), F.lit(0.0)).alias("score"), F.when(~many, F.col("cand_id")).alias("cand_id"), F.when(many, F.col("joined")).otherwise(F.col("text")).alias("text"), F.coalesce("source_ids", F.when(F.col("cand_id").isNotNull(), F.array("cand_id"))).alias("source_ids"))


def interval_bounds(anchors: DataFrame, keys: list[str], at: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """low and high of each anchor: the middles between it and its neighbours; null at the ends."""
    w = Window.partitionBy(*keys).orderBy(at, *ties)
    return anchors.withColumn("low", (F.lag(at).over(w) + F.col(at)) / 2).withColumn("high", (F.lead(at).over(w) + F.col(at)) / 2)


def row_spans(starts: DataFrame, keys: list[str], row: str, rows: str) -> DataFrame:
    """until: the next start, or the number of rows."""
    return starts.withColumn("until", F.coalesce(F.lead(row).over(Window.partitionBy(*keys).orderBy(row)), F.col(rows)))


def numbered_groups(formulas: DataFrame, keys: list[str], position: str) -> DataFrame:
    """grp of runs of neighbouring formulas, of two at least, one of them numbered; other formulas go."""
    w = Window.partitionBy(*keys).orderBy(position)
    rows = formulas.withColumn("grp", F.sum(F.when(F.col(position) - F.lag(position).over(w) == 1, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*keys, "grp")
    return rows.withColumn("_n", F.count("*").over(own)).withColumn("_any", F.max(F.col("numbered").cast("int")).over(own)).where("_n >= 2 and _any = 1").drop("_n", "_any")


def gap_groups(rows: DataFrame, keys: list[str], gap: float = 0.035, share: float = 0.5) -> DataFrame:
    """grp of fragments of a row: split where the gap is wide, or two overlap by more than half of the narrower."""
    w = Window.partitionBy(*keys).orderBy("box.x0", "element_id")
    before, now = F.lag("box").over(w), F.col("box")
    overlap = F.least(now["x1"], before["x1"]) - F.greatest(now["x0"], before["x0"])
    cut = (now["x0"] - before["x1"] > gap) | (overlap > share * F.least(now["x1"] - now["x0"], before["x1"] - before["x0"]))
    return rows.withColumn("_cut", F.coalesce(cut.cast("int"), F.lit(1))).withColumn("grp", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def cluster_rows(centres: np.ndarray, heights: np.ndarray, nearest: bool, back: int | None, tolerance, stop: float | None) -> np.ndarray:
    """Row of each fragment (in the order of centres): joins a row whose mean centre is within tolerance of both heights.

    Of the last `back` rows (all for None; none further above than stop) the nearest one, or the first that fits.
    """
    mean, tall, many, out = [], [], [], np.zeros(len(centres), np.int64)
    for i, (c, h) in enumerate(zip(centres.tolist(), heights.tolist())):
        tried = range(len(mean) - 1, -1, -1) if nearest else range(max(0, len(mean) - (back or len(mean))), len(mean))
        best, least = None, np.inf
        for k in tried:
            if stop is not None and c - mean[k] > stop:
                break
            away = abs(c - mean[k])
            if away <= tolerance(max(h, tall[k])) and away < least:
                best, least = k, away
                if not nearest:
                    break
        if best is None:
            best = len(mean)
            mean.append(c), tall.append(h), many.append(1)
        else:
            many[best] += 1
            mean[best] += (c - mean[best]) / many[best]
            tall[best] = max(tall[best], h)
        out[i] = best
    return out


def _rows(fragments: DataFrame, keys: list[str], **rule) -> DataFrame:
    """A page's fragments are one array and many pages a batch: small pages cost no call each."""
    names, c, x = fragments.columns, B.centre(F.col("box")), F.col("box.x0")
    order = F.struct(c.isNull().alias("a"), c.alias("c"), x.isNull().alias("b"), x.alias("x"), "element_id", (F.col("box.y1") - F.col("box.y0")).alias("h"))

    @F.pandas_udf("array<long>")
    def clustered(centres: pd.Series, heights: pd.Series) -> pd.Series:
        return pd.Series([cluster_rows(np.asarray(a, float), np.asarray(b, float), **rule) for a, b in zip(centres, heights)], dtype=object)

    pages = fragments.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("f"))
    pages = pages.select(*keys, F.col("f.element_id").alias("element_id"), clustered("f.c", "f.h").alias("line"))
    lines = pages.select(*keys, F.explode(F.arrays_zip("element_id", "line")).alias("z")).select(*keys, "z.*")
    return meet(fragments, lines, [*keys, "element_id"]).select(*names, "line")


def line_rows(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """line of each fragment of a page: the nearest row within 0.8 of the taller one, no row 0.05 above."""
    return _rows(fragments, keys, nearest=True, back=None, tolerance=lambda h: 0.8 * h, stop=0.05)


def layout_rows(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """line of each block of a page: the first of the last four rows within 0.55 of the taller one, 0.006 at least."""
    return _rows(fragments, keys, nearest=False, back=4, tolerance=lambda h: max(0.006, 0.55 * h), stop=None)
