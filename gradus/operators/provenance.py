"""Versions of results: what must be computed again, what differs, and what would have been under other forms."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.operators.stages import cut, meet


@dataclass(frozen=True)
class Stage:
    """A step of a computation: `compute` adds `outputs` to rows that hold all earlier stages' outputs; `config` stands for all that it depends on."""

    name: str
    config: str
    outputs: tuple[str, ...]
    compute: Callable[[DataFrame], DataFrame]


def canonical(*columns: str) -> Column:
    """One text of a row's values, with names and nulls; equal only for equal values."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def fingerprinted(inputs: DataFrame, keys: list[str], stages: list[Stage], columns: list[str] | None = None) -> DataFrame:
    """Adds fp_<stage>: a digest of the row's inputs (`columns`, or all) and of the configs of all stages up to this one."""
    before = F.sha2(canonical(*[c for c in columns or inputs.columns if c not in keys]), 256)
    out = inputs
    for s in stages:
        out = out.withColumn(f"fp_{s.name}", F.sha2(F.concat_ws("\n", before, F.lit(s.name), F.lit(s.config)), 256))
        before = F.col(f"fp_{s.name}")
    return out


def recompute(inputs: DataFrame, cached: DataFrame | None, keys: list[str], stages: list[Stage]) -> DataFrame:
    """inputs with the outputs of all stages, fp_<stage>, and redone: the number of stages that were computed, the last ones.

    cached is an earlier result (keys, outputs, fp_<stage>), keys unique. A row's stages are carried over up to the first whose fingerprint
    differs or is missing: another input computes all again, another config its own stage and those behind it. Rows are dealt by
    where they start, so a stage runs on the rows that need it alone; the earlier result is read once and joined by its keys.
    """
    marks, outputs = [f"fp_{s.name}" for s in stages], [c for s in stages for c in s.outputs]
    if cached is None:
        met = inputs.withColumn("_good", F.lit(0)).withColumns({f"_{c}": F.lit(None) for c in outputs})
    else:  # digests are compared as bytes and never stored: those of the inputs are made behind the join, and again for the rows that are asked for
        had = cached.select(*keys, *[F.unhex(m).alias(f"_{m}") for m in marks], *[F.col(c).alias(f"_{c}") for c in outputs])
        now = fingerprinted(meet(inputs, had, keys, "left"), keys, stages, inputs.columns)
        fits = [F.coalesce(F.unhex(m) == F.col(f"_{m}"), F.lit(False)).cast("int") for m in marks]
        good = sum((reduce(lambda a, b: a * b, fits[: k + 1]) for k in range(len(marks))), F.lit(0))
        met = cut(now.withColumn("_good", good).drop(*marks, *[f"_{m}" for m in marks]))
    met = fingerprinted(met, keys, stages, inputs.columns)
    parts = []
    for start in range(len(stages) + 1):
        kept = [c for s in stages[:start] for c in s.outputs]
        rows = met.where(F.col("_good") == start).select(*inputs.columns, *marks, *[F.col(f"_{c}").alias(c) for c in kept])
        for s in stages[start:]:
            rows = s.compute(rows)
        parts.append(rows.select(*inputs.columns, *outputs, *marks, F.lit(len(stages) - start).alias("redone")))
    return reduce(DataFrame.unionByName, parts if cached is not None else parts[:1])


def work(result: DataFrame, stages: list[Stage]) -> DataFrame:
    """stage, reused, computed: rows of a recomputed result by stage."""
    n = len(stages)
    counts = F.array(*[F.struct(F.lit(s.name).alias("stage"), F.count_if(F.col("redone") < n - k).alias("reused"), F.count_if(F.col("redone") >= n - k).alias("computed")) for k, s in enumerate(stages)])
    return result.agg(F.explode(counts).alias("x")).select("x.*")


def table_digest(df: DataFrame, *by: str) -> DataFrame:
    """rows and digest of a table (or of each group), the same in whatever order and partitions its rows come: sums of two hashes of each row."""
    row = canonical(*[c for c in df.columns if c not in by])
    total = lambda h: F.sum(h.cast("decimal(20,0)"))
    digest = F.sha2(F.concat_ws(":", F.count("*"), total(F.xxhash64(row)), total(F.xxhash64(row, F.lit("second")))), 256)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), digest.alias("digest"))


def tree_digest(files: DataFrame, root: str) -> DataFrame:
    """files and digest of a folder's binaryFile rows, whatever tasks read them: names below the root and contents, in one pass."""
    named = files.select(F.substring_index(F.col("path"), root.rstrip("/") + "/", -1).alias("name"), F.sha2("content", 256).alias("content"))
    return table_digest(named).withColumnRenamed("rows", "files")


def folder_hash(files: DataFrame, root: str) -> DataFrame:
    """(folder, files, sha256) of each folder below the root: one hash over names and contents of its files in the order of names, each
    closed by a zero byte. A folder's files meet in one task, as such a hash must read them in a row; tree_digest doesn't ask for that.
    Spark's reader gives no row for an empty file, so an empty file counts in neither.
    """
    name = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    named = files.select(F.regexp_replace(name, "/?[^/]*$", "").alias("folder"), name.alias("name"), "content")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h = hashlib.sha256()
        for r in rows.sort_values("name").itertuples():
            h.update(r.name.encode() + b"\0" + r.content + b"\0")
        return pd.DataFrame({"folder": [rows["folder"].iloc[0]], "files": [len(rows)], "sha256": [h.hexdigest()]})

    return named.groupBy("folder").applyInPandas(run, "folder string, files long, sha256 string")


def control_diff(old: DataFrame, new: DataFrame, keys: list[str], bucket: Column, tolerance: dict[str, float] | None = None, most: int = 1_000_000) -> DataFrame:
    """Rows that were added, are gone or have changed: keys, state, columns (that changed), before and after (as JSON), and a delta of
    each column with a tolerance.

    bucket is a range of keys (an expression of them). A first pass sums up each range on both sides; only ranges whose digests
    differ are read again, shuffled and joined, so the work goes with what changed. Values differ if they aren't equal (nulls are) or, for columns with a
    tolerance, by more than it. Rows that repeat a key are paired in the order of their values. A range that differs is a row of a
    table that is broadcast if it was counted to be small, joined by a shuffle if not.
    """
    tolerance = tolerance or {}
    values = [c for c in old.columns if c not in keys]
    a, b = (df.select(*keys, *values, bucket.alias("_bucket")) for df in (old, new))
    sums = [table_digest(df, "_bucket").withColumnRenamed("digest", f"d{k}").drop("rows") for k, df in enumerate((a, b))]
    unlike = sums[0].join(sums[1], "_bucket", "full_outer").where(~F.col("d0").eqNullSafe(F.col("d1"))).select(F.col("_bucket").alias("_unlike"))
    unlike = F.broadcast(unlike) if unlike.count() <= most else unlike

    def side(df: DataFrame, tag: str) -> DataFrame:
        held = df.join(unlike, F.col("_bucket").eqNullSafe(F.col("_unlike")), "left_semi").drop("_bucket")
        order = Window.partitionBy(*keys).orderBy(canonical(*values))
        return held.select(*[F.col(k).alias(f"_{tag}_{k}") for k in keys], F.struct(*values).alias(tag), F.row_number().over(order).alias(f"_{tag}"))

    x, y = side(a, "a"), side(b, "b")
    both = x.join(y, [*[F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys], F.col("_a") == F.col("_b")], "full_outer")
    was, now = F.col("a"), F.col("b")

    def differs(c: str) -> Column:
        apart = ~was[c].eqNullSafe(now[c])
        return apart & F.coalesce(F.abs(was[c] - now[c]) > tolerance[c], F.lit(True)) if c in tolerance else apart

    changed = F.filter(F.array(*[F.when(differs(c), F.lit(c)) for c in values]), lambda c: c.isNotNull())
    state = F.when(was.isNull(), "added").when(now.isNull(), "gone").when(F.size("columns") > 0, "changed")
    out = both.select(
        *[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys], was.alias("a"), now.alias("b"), F.when(was.isNotNull() & now.isNotNull(), changed).otherwise(F.array().cast("array<string>")).alias("columns")
    ).withColumn("state", state).where("state is not null")
    deltas = [(now[c] - was[c]).alias(f"delta_{c}") for c in tolerance]
    return out.select(*keys, "state", "columns", F.to_json("a").alias("before"), F.to_json("b").alias("after"), *deltas)


def counterfactual(df: DataFrame, keys: list[str], forms: dict[str, Column], score: Callable[[Column], Column], base: str) -> DataFrame:
    """(keys, scenario, score, delta) of every row under every form of what is scored; delta is the score less that of the form `base`.

    All forms of a row are made in one scan. Forms that come out alike are scored once: a row is dealt into its distinct texts, each with the
    scenarios that it stands for. Other columns of df may be used by the score. Deltas meet by keys, which are unique.
    """
    forms_of = F.array(*[F.struct(F.lit(n).alias("scenario"), c.alias("form")) for n, c in forms.items()])
    held = df.withColumn("_forms", forms_of)
    texts = F.array_distinct(F.transform("_forms", lambda f: f["form"]))
    named = F.transform(texts, lambda t: F.struct(t.alias("form"), F.transform(F.filter("_forms", lambda f: f["form"].eqNullSafe(t)), lambda f: f["scenario"]).alias("scenarios")))
    dealt = held.withColumn("_named", F.explode(named)).withColumn("_score", score(F.col("_named.form")))
    rows = dealt.select(*keys, F.explode("_named.scenarios").alias("scenario"), F.col("_score").alias("score"))
    own = F.max(F.when(F.col("scenario") == base, F.col("score"))).over(Window.partitionBy(*keys))
    return rows.withColumn("delta", F.col("score") - own)
