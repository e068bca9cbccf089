"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.vectors import best_of, blockwise_top, usable

BITS = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class Codes:
    """Signs of rotated vectors; the rotation brings them near the corners of the cube (iterative quantization)."""

    def __init__(self, sample: np.ndarray, rounds: int = 40, seed: int = 7):
        self.mean = sample.mean(0)
        z = sample - self.mean
        axes = np.linalg.svd(z, full_matrices=False)[2].T if len(sample) >= z.shape[1] else np.eye(z.shape[1])
        z = z @ axes
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(z.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.sign(z @ turn).T @ z)
            turn = vt.T @ u.T
        self.turn = axes @ turn

    def of(self, x: np.ndarray) -> np.ndarray:
        """A row of bytes a vector."""
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)


def learned_radius(codes: Codes, sample: np.ndarray, k: int, share: float, queries: int = 256) -> int:
    """The Hamming distance that `share` of the sample's own true k nearest lie within; neighbours in all rows are nearer than in a sample."""
    q = sample[:queries]
    near = q @ sample.T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    top = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
    c = codes.of(sample)
    far = [BITS[c[i] ^ c[t]].sum(1) for i, t in enumerate(top)]
    return int(np.quantile(np.concatenate(far), share, method="higher")) if far and len(far[0]) else 8 * c.shape[1]


class MultiIndex:
    """A block's codes under each of their bytes: codes within radius r share a byte up to r // bytes bits with the query."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            self.tables.append((order, np.searchsorted(codes[order, j], np.arange(257))))

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within the Hamming radius, exactly."""
        least = radius // len(q)
        hit = np.zeros(len(self.codes), bool)
        for (order, ends), byte in zip(self.tables, q):
            keys = np.flatnonzero(BITS[np.arange(256) ^ int(byte)] <= least)
            for a, b in zip(ends[keys], ends[keys + 1]):
                if b > a:
                    hit[order[a:b]] = True
        at = np.flatnonzero(hit)
        return at[BITS[self.codes[at] ^ q].sum(1) <= radius]


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in doubles, summed in the order of the components."""
    out = np.zeros(len(x))
    for d in range(len(q)):
        out += x[:, d] * q[d]
    return out


def hamming_search(df: DataFrame, every: int = 20, k: int = 20, sample_rows: int = 4096, share: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: nearest found by inner product, nearest first, ties to smaller vec_id.

    Rows without id, and vectors null, empty, zero or with null or non-finite components take no part; of repeated ids
    the smallest vector counts; an empty table gives no rows. The codes and the radius are learned from sample_rows
    vectors (those with the smallest hashes of their ids); every vector is indexed. A query takes all codes within the
    radius, or within a greater one until k are found in its block, and ranks them by their original vectors.
    """
    vectors = usable(df, id_col, vec_col, nonzero=True)
    sample = [r["x"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("x", "dim").collect()]
    models: dict[int, tuple[Codes, int]] = {}
    for dim in {len(x) for x in sample}:
        own = np.array([x for x in sample if len(x) == dim])
        codes = Codes(own)
        models[dim] = codes, learned_radius(codes, own, k, share)

    def search(ids, x, query_ids, queries):
        if x.shape[1] not in models:  # a length too rare for the sample
            codes = Codes(x)
            radius = learned_radius(codes, x, k, share)
        else:
            codes, radius = models[x.shape[1]]
        index = MultiIndex(codes.of(x))
        most = 8 * index.codes.shape[1]
        for query, q, c in zip(query_ids, queries, codes.of(queries)):
            r = radius
            while True:
                at = index.within(c, r)
                at = at[ids[at] != query]
                if len(at) >= k or r >= most:
                    break
                r = min(most, r + 4)
            scores = inner(x[at], q)
            best = best_of(ids[at], scores, k)
            yield query, ids[at][best], scores[best]

    return blockwise_top(vectors, every, k, search, "double")
