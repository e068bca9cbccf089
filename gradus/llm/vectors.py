"""Blocks of vectors: a stated query set meets every candidate, block by block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", nonzero: bool = False) -> DataFrame:
    """vec_id, x (array<double>), dim: one row an id (of repeated ids the smallest vector), without null ids and without
    vectors that are null, empty, (with nonzero) zero, or hold null or non-finite components."""
    big = F.lit(1.7976931348623157e308)
    ok = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= big)) & (F.size("x") > 0)
    if nonzero:
        ok = ok & F.exists("x", lambda v: v != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(F.coalesce(ok, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("dim", F.size("x"))


def blockwise_top(vectors: DataFrame, every: int, k: int, search: Callable, score: str, block_rows: int = 8192, query_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: of every id divisible by `every`, its k best among all other ids of its length.

    Candidates are dealt by a hash of their id into blocks of about block_rows, queries into groups of about
    query_rows; each task holds one block and one group (equal joins on block and group, no pairs of rows), and gives
    at most k rows a query: search(ids, matrix, query ids, query matrix) yields (query, ids, scores). Best first, ties
    to the smaller id. Nothing is broadcast and nothing but a row count reaches the driver.
    """
    n = vectors.count()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-n // max(every, 1) // query_rows))
    # dims differ rarely; each is searched by itself
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")
    cands = vectors.withColumn("b", block).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = vectors.where(F.col("vec_id") % every == 0).withColumn("g", group).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("vec_id")
            ids, x = left["vec_id"].to_numpy(np.int64), np.stack(left["x"].to_numpy())
            for q, found, scores in search(ids, x, right["vec_id"].to_numpy(np.int64), np.stack(right["x"].to_numpy())):
                out.append(pd.DataFrame({"query_id": np.int64(q), "vec_id": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64 if score == "long" else float)})

    near = cands.groupBy("dim", "b", "g").cogroup(asked.groupBy("dim", "b", "g")).applyInPandas(run, f"query_id long, vec_id long, score {score}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))][:k]
    return np.lexsort((ids, -scores))[:k]
