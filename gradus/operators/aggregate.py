"""Macro hierarchy of object scores: each level averages the means of the level below, so it is no rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def level_means(objects: DataFrame, keys: list[str]) -> DataFrame:
    """score and n_objects by (keys, category), and per keys the mean of the categories present."""
    by = objects.groupBy(*keys, "category").agg(F.avg("score").alias("score"), F.count("*").alias("n_objects"))
    whole = by.groupBy(*keys).agg(F.avg("score").alias("score"), F.sum("n_objects").alias("n_objects")).withColumn("category", F.lit("overall"))
    return by.unionByName(whole)


def balanced(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the subtypes' means by (keys, category); a null subtype is one of its own."""
    sub = objects.groupBy(*keys, "category", F.coalesce("subtype", F.lit(-1)).alias("subtype")).agg(F.avg("score").alias("score"))
    return sub.groupBy(*keys, "category").agg(F.avg("score").alias("score"), F.count("*").alias("n_subtypes"))


def tool_categories(objects: DataFrame) -> DataFrame:
    """Document macro mean, spread and counts by tool and category."""
    docs = objects.groupBy("tool", "category", "document").agg(F.avg("score").alias("score"), F.count("*").alias("n"))
    return docs.groupBy("tool", "category").agg(F.avg("score").alias("score"), F.stddev_samp("score").alias("std_dev"), F.count("*").alias("n_documents"), F.sum("n").alias("n_objects"))


def overall(scores: DataFrame, weights: dict[str, float], strict: bool = False) -> DataFrame:
    """Weighted mean by tool over its categories; strict fails where one is missing."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("category")]
    out = scores.where(w.isNotNull()).groupBy("tool").agg((F.sum(w * F.col("score")) / F.sum(w)).alias("overall"), F.countDistinct("category").alias("n_categories"))
    if strict:
        out = out.withColumn("overall", F.when(F.col("n_categories") == len(weights), F.col("overall")).otherwise(F.raise_error(F.lit("a category is missing")).cast("double")))
    return out


def reporting(objects: DataFrame) -> DataFrame:
    """Detection (all objects) and extraction (matched ones) by tool: subtype means by document, then document means."""
    rows = objects.select("tool", "document", "subtype", F.explode(F.array(F.struct(F.lit("detection").alias("kind"), F.when(F.col("matched"), 100.0).otherwise(0.0).cast("double").alias("v")), F.struct(F.lit("extraction").alias("kind"), F.when(F.col("matched"), F.col("score")).cast("double").alias("v")))).alias("x")).select("tool", "document", "subtype", "x.*").where("v is not null")
    return rows.groupBy("tool", "kind", "subtype", "document").agg(F.avg("v").alias("v")).groupBy("tool", "kind", "subtype").agg(F.avg("v").alias("v")).groupBy("tool", "kind").agg(F.avg("v").alias("score"), F.count("*").alias("n_subtypes"))


def leave_one_out(objects: DataFrame) -> DataFrame:
    """Macro score of each tool without each document, and its change; null if a category is gone."""
    cell = objects.groupBy("tool", "document", "category").agg(F.avg("score").alias("score"))
    n = cell.groupBy("tool").agg(F.countDistinct("category").alias("all_categories"))
    full = cell.groupBy("tool", "category").agg(F.avg("score").alias("s")).groupBy("tool").agg(F.avg("s").alias("full"))
    # sums of all documents less the omitted one's: no pairing of documents
    total = cell.groupBy("tool", "category").agg(F.sum("score").alias("total"), F.count("*").alias("docs"))
    omitted = cell.select("tool", "document").distinct().join(total, "tool").join(cell, ["tool", "document", "category"], "left")
    rest = omitted.withColumn("left", F.col("docs") - F.when(F.col("score").isNull(), 0).otherwise(1)).where("left > 0")
    score = rest.groupBy("tool", F.col("document").alias("omitted")).agg(F.avg((F.col("total") - F.coalesce("score", F.lit(0.0))) / F.col("left")).alias("score"), F.count("*").alias("n"))
    out = score.join(n, "tool").join(full, "tool").withColumn("score", F.when(F.col("n") == F.col("all_categories"), F.col("score")))
    return out.select("tool", "omitted", "score", (F.col("score") - F.col("full")).alias("delta"))


def paired(objects: DataFrame) -> DataFrame:
    """Mean difference of each pair of tools, earlier one first, by category over common documents."""
    cell = objects.groupBy("tool", "document", "category").agg(F.avg("score").alias("score"))
    l, r = cell.alias("l"), cell.alias("r")
    both = l.join(r, (F.col("l.document") == F.col("r.document")) & (F.col("l.category") == F.col("r.category")) & (F.col("l.tool") < F.col("r.tool")))
    return both.groupBy(F.col("l.tool").alias("left_tool"), F.col("r.tool").alias("right_tool"), F.col("l.category").alias("category")).agg(F.count("*").alias("n_documents"), F.avg(F.col("l.score") - F.col("r.score")).alias("delta"))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
