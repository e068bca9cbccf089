"""Exact top-k search by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.vectors import best_of, blockwise_top, usable


class SortedLists:
    """A block's values in one sorted list a dimension. ids ascend."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.order = np.argsort(values, axis=0, kind="stable")

    def top(self, query: int, q: np.ndarray, k: int, first: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best other than `query`.

        All lists are read from the end that is better for q, some entries a round; each new vector is looked up and
        scored in full. No unread vector scores more than the sum of q times the last value read of each list, so the
        reading stops when that bound is under the kth score (at the same score a smaller id could still come).
        """
        n, dims = len(self.ids), np.flatnonzero(q)
        seen = np.zeros(n, bool)
        own = np.searchsorted(self.ids, query)
        skipped = own < n and self.ids[own] == query
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.values.dtype)
        depth, step = 0, first
        while True:
            end = min(n, depth + step) if len(dims) else n
            if len(dims):
                up, down = dims[q[dims] > 0], dims[q[dims] < 0]
                read = np.concatenate([self.order[n - end : n - depth, up].ravel(), self.order[depth:end, down].ravel()])
                new = np.zeros(n, bool)
                new[read] = True
            else:
                new = np.ones(n, bool)
            if skipped:
                new[own] = False
            new &= ~seen
            seen |= new
            at = np.flatnonzero(new)
            ids, scores = np.concatenate([ids, self.ids[at]]), np.concatenate([scores, self.values[at] @ q])
            keep = best_of(ids, scores, k)
            ids, scores = ids[keep], scores[keep]
            if end == n:
                return ids, scores
            if len(ids) == k:
                last = np.concatenate([self.values[self.order[n - end, up], up], self.values[self.order[end - 1, down], down]])
                if last @ np.concatenate([q[up], q[down]]) < scores[-1]:
                    return ids, scores
            depth, step = end, 2 * step


def threshold_search(df: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: exact k highest integer inner products of floor(scale * x), ties to smaller vec_id.

    Rows without id, and vectors null, empty or with null or non-finite components take no part; of repeated ids the
    smallest vector counts; an empty table gives no rows. The score must fit a long. Sums are exact: values under 2**22
    in doubles, greater ones in 64-bit integers.
    """

    def search(ids, x, query_ids, queries):
        x, queries = np.floor(scale * x), np.floor(scale * queries)
        if max(np.abs(x).max(), np.abs(queries).max()) ** 2 * x.shape[1] >= 2.0**53:
            x, queries = x.astype(np.int64), queries.astype(np.int64)
        lists = SortedLists(ids, x)
        for query, q in zip(query_ids, queries):
            found, scores = lists.top(query, q, k)
            yield query, found, scores.astype(np.int64)

    return blockwise_top(usable(df, id_col, vec_col), every, k, search, "long").select("query_id", F.col("rank"), "vec_id", "score")
