"""Statistics of score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.operators.stages import cut


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = lambda p: F.percentile(value, F.lit(p))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q(0.5).alias("median"), F.stddev_samp(value).alias("sd"), q(0.25).alias("q1"), q(0.75).alias("q3"), F.min(value).alias("low"), F.max(value).alias("high"))


def variance_components(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Sums of squares in all, between and within groups; the share between is null where nothing varies. Sums alone, no window."""
    part = df.groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(value)).alias("w"))
    whole = part.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum("w").alias("ss_within"))
    between = part.join(whole.select(*keys, "mean"), keys).groupBy(*keys).agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("ss_between"))
    out = whole.join(between, keys).withColumn("ss_total", F.col("ss_within") + F.col("ss_between"))
    return out.select(*keys, "n", "ss_total", "ss_between", "ss_within", F.when(F.col("ss_total") > 1e-12, F.col("ss_between") / F.col("ss_total")).alias("between_share"), F.try_divide("ss_total", F.col("n") - 1).alias("sample_variance"))


def average_rank(df: DataFrame, keys: list[str], value: str, name: str, ranges: int = 64) -> DataFrame:
    """Tie-averaged ranks within keys. Values are counted first; the counts of ranges of values are summed up by key, so a task
    sorts the distinct values of a range, not all rows of a key."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_m"))
    bounds = counts.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), F.lit([k / ranges for k in range(1, ranges)]), F.lit(1000)).alias("_bounds"))
    part = F.size(F.filter(F.coalesce("_bounds", F.array().cast("array<double>")), lambda b: b < F.col(value).cast("double")))
    placed = cut(counts.join(bounds, keys).withColumn("_part", part).drop("_bounds"))
    below = placed.groupBy(*keys, "_part").agg(F.sum("_m").alias("_in"))
    below = below.withColumn("_below", F.coalesce(F.sum("_in").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_in")
    own = Window.partitionBy(*keys, "_part").orderBy(value)
    ranks = placed.join(below, [*keys, "_part"]).withColumn(name, F.col("_below") + F.coalesce(F.sum("_m").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + (F.col("_m") + 1) / 2)
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in (*keys, value)]
    return df.join(ranks.select(*[F.col(k).alias(f"_r_{k}") for k in (*keys, value)], name), same).drop(*[f"_r_{k}" for k in (*keys, value)])


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pearson correlation of tie-averaged ranks; null where a side doesn't vary."""
    r = average_rank(average_rank(df, keys, a, "_ra"), keys, b, "_rb")
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("_ra", "_rb"), F.nullif(F.stddev_pop("_ra") * F.stddev_pop("_rb"), F.lit(0.0))).alias("rho"))


def iqr_outliers(df: DataFrame, keys: list[str], metric: str, value: str) -> DataFrame:
    """Rows outside 1.5 interquartile ranges of their metric, of four values at least; a warning, nothing is removed."""
    q = df.groupBy(metric).agg(F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"), F.count(value).alias("n")).where("n >= 4")
    span = 1.5 * (F.col("q3") - F.col("q1"))
    return df.join(F.broadcast(q), metric).where((F.col(value) < F.col("q1") - span) | (F.col(value) > F.col("q3") + span)).select(*keys, metric, value)


def pareto(df: DataFrame, quality: str, cost: str, tol: float = 1e-9, ranges: int = 64) -> DataFrame:
    """Rows that no other row beats in one of quality (more) and cost (less) without losing in the other.

    By a running maximum of quality in the order of cost: costs are cut into ranges (by quantiles of at most a few
    hundred bounds), each range keeps its own running maximum and starts from the best of the ranges below it.
    """
    by_cost = df.where(F.col(cost).isNotNull()).groupBy(cost).agg(F.max(quality).alias("_top"))
    bounds = sorted(set(by_cost.approxQuantile(cost, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    by_cost = by_cost.withColumn("_r", F.aggregate(F.array(*map(F.lit, bounds)), F.lit(0), lambda n, x: n + (F.col(cost) > x).cast("int")) if bounds else F.lit(0))
    tops = by_cost.groupBy("_r").agg(F.max("_top").alias("_best"))  # one row a range
    below = tops.withColumn("_below", F.max("_best").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))).select("_r", "_below")
    inner = Window.partitionBy("_r").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    best = by_cost.withColumn("_in", F.max("_top").over(inner)).join(F.broadcast(below), "_r").withColumn("_before", F.greatest("_in", "_below")).drop("_r", "_in", "_below")
    return df.join(best, cost).where((F.col(quality) >= F.col("_top") - tol) & (F.col("_before").isNull() | (F.col(quality) > F.col("_before") + tol))).drop("_top", "_before")


def hash_bootstrap(df: DataFrame, keys: list[str], order: str, value: str, draws: int = 10_000) -> DataFrame:
    """2.5 and 97.5 % bounds of resampled means. Draw r takes as its ith value the one at md5(r:i) mod n, on any engine alike."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_at", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    picks = rows.select(*keys, F.col("_at").alias("_i"), "_n").withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = picks.withColumn("_at", (F.conv(F.substring(F.md5(F.concat_ws(":", "_r", "_i")), 1, 8), 16, 10).cast("long") % F.col("_n")).cast("int"))
    means = picks.join(rows.select(*keys, "_at", value), [*keys, "_at"]).groupBy(*keys, "_r").agg(F.avg(value).alias("_m"))
    return means.groupBy(*keys).agg(F.percentile("_m", F.lit(0.025)).alias("ci_low"), F.percentile("_m", F.lit(0.975)).alias("ci_high"))


def paired_bootstrap(df: DataFrame, keys: list[str], order: str, left: str, right: str, draws: int = 10_000) -> DataFrame:
    """Mean difference of paired values and its resampled 2.5 and 97.5 % bounds, null for fewer than two pairs; a value without partner fails."""
    gap = F.when(F.col(left).isNotNull() & F.col(right).isNotNull(), F.col(left) - F.col(right)).otherwise(F.raise_error(F.lit("a value without partner")).cast("double"))
    rows = df.withColumn("_d", gap)
    own = rows.groupBy(*keys).agg(F.avg("_d").alias("delta"), F.count("*").alias("n"))
    out = own.join(hash_bootstrap(rows, keys, order, "_d", draws), keys)
    return out.select(*keys, "n", "delta", *[F.when(F.col("n") > 1, F.col(c)).alias(c) for c in ("ci_low", "ci_high")])


def macro_of(objects: DataFrame) -> DataFrame:
    """Macro score by tool in one formulation of its own, to check the hierarchy: each object weighs 1 / (categories x documents of its category x objects of its cell).

    Weights come from counted cells, which are few, and meet the objects by their cell.
    """
    cells = objects.groupBy("tool", "category", "document").agg(F.count("*").alias("_cell"))
    docs = cells.groupBy("tool", "category").agg(F.count("*").alias("_docs"))
    cats = docs.groupBy("tool").agg(F.count("*").alias("_cats"))
    weights = cells.join(docs, ["tool", "category"]).join(cats, "tool").withColumn("_w", 1 / (F.col("_cell") * F.col("_docs") * F.col("_cats")))
    return objects.join(weights, ["tool", "category", "document"]).groupBy("tool").agg(F.sum(F.col("score") * F.col("_w")).alias("overall"))
