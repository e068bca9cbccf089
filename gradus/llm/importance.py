"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import MIX, Scratch, WordHashes, id_text, mix64
from gradus.llm.tokens import slices

#: Letters and digits, or marks, or underscores in a row.
TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+").findall
TWICE = np.uint64(1)


def buckets(words: WordHashes, text: str, bits: int) -> np.ndarray:
    """Hash buckets of all words and word pairs; pairs of one word twice share a bucket."""
    h = words.of([w.encode() for w in TOKENS(text.lower())])
    pair = np.where(h[1:] == h[:-1], TWICE, h[:-1] * MIX + mix64(h[1:]))
    return (np.concatenate([h, mix64(pair)]) >> np.uint64(64 - bits)).astype(np.int64)


def bucket_counts(docs: DataFrame, bits: int) -> np.ndarray:
    """How often each bucket is in all texts: one sparse vector a task, summed by bucket."""

    def run(batches):
        words, total = WordHashes(), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in slices(batch):
                found = [buckets(words, t, bits) for t in part.column("text").to_pylist()]
                total += np.bincount(np.concatenate(found), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(1 << bits)
    for r in docs.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def kinds(labels: DataFrame) -> DataFrame:
    """doc_id, good, bad of all labelled documents, once each.

    good: of quality and not toxic; bad: without quality; toxic text that is well written is neither.
    """
    quality, toxic = F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0))
    some = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), ((quality > 0) & (toxic == 0)).alias("good"), (quality <= 0).alias("bad"))
    return some.groupBy("doc_id").agg(F.min("good").alias("good"), F.max("bad").alias("bad"))


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, good, bad of at most `rows` labelled documents, those with the smallest hashes of their ids."""
    some = kinds(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.join(F.broadcast(some), "doc_id")  # three columns of at most `rows` rows


def scored(docs: DataFrame, log_ratio: np.ndarray, bits: int, seed: int, temperature: float, carried: list[str]) -> DataFrame:
    """log_weight, the Gumbel key and its sortable 64-bit form of every row, with the carried columns."""
    schema = docs.select(*carried).schema

    def run(batches):
        words = WordHashes()
        for batch in batches:
            for part in slices(batch):
                weight = np.array([log_ratio[buckets(words, t, bits)].sum() for t in part.column("text").to_pylist()])
                ids = np.array([0 if d is None else d for d in part.column("doc_id").to_pylist()], np.int64).view(np.uint64)
                u = ((mix64(ids * MIX + np.uint64(seed)) >> np.uint64(12)).astype(float) + 0.5) / 2.0**52
                key = weight - temperature * np.log(-np.log(u))
                raw = (key + 0.0).view(np.int64)
                order = raw ^ ((raw >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(weight), pa.array(key), pa.array(order)], names=[*carried, "log_weight", "gumbel_key", "sort_key"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return docs.mapInArrow(run, f"{fields}, log_weight double, gumbel_key double, sort_key long")


def kth_largest(df: DataFrame, k: int) -> int:
    """The kth largest sort_key: four counts of at most 65,536 groups each, however many rows there are."""
    rows, prefix = df, None
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("sort_key", shift) if shift == 48 else F.shiftright("sort_key", shift).bitwiseAND(0xFFFF)
        counts = sorted(((r["d"], r["n"]) for r in rows.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for d, n in counts:
            if k <= n:
                break
            k -= n
        prefix = d if prefix is None else (prefix << 16) | d
        rows = rows.where(F.shiftright("sort_key", shift) == prefix)
    return prefix


def best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The middle of the cuts that divide good from other rows best, both kinds counting alike."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    below_bad, below_good = np.cumsum(~g) / (~g).sum(), np.cumsum(g) / g.sum()
    gain = below_bad - below_good
    at = int(np.argmax(gain))
    return (w[at] + w[at + 1]) / 2 if at + 1 < len(w) else w[at]


def resample(df: DataFrame, labels: DataFrame, bits: int = 16, label_rows: int = 20_000, temperature: float = 1.0, prior: float = 8.0, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """The rows that importance resampling selects: doc_id, log_weight, gumbel_key, kept (or, with keep_columns, the
    columns of df).

    log_weight is the log-likelihood ratio of the text under two hashed n-gram models: of good labelled documents (at
    most label_rows labels are read) and of all raw texts; `prior` occurrences at the raw rate are added to each bucket. The k rows with the largest log_weight + Gumbel noise are
    drawn (sampling without replacement by weight); k is the count of all rows above the cut that divides held-out
    labelled rows best. Rows that tie with the last one drawn stay; noise
    depends on doc_id alone, so repeated rows go or stay together. Null and empty texts weigh 0. Without a good label
    every row is kept. No rows in, none out.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "importance")
    docs = id_text(df, id_col, text_col)
    sample = scratch.save(labelled(docs, labels, label_rows), "labelled")
    # half of the labelled rows make the target model, the other half, as new to it as unlabelled rows, set the cut
    fits = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2)) == 0
    raw, target = bucket_counts(docs, bits), bucket_counts(sample.where(F.col("good") & fits).select("doc_id", "text"), bits)
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    ratio = np.log((target + prior) / (expected + prior)) if target.any() else np.zeros(len(raw))
    known = scored(sample.where(~fits & (F.col("good") | F.col("bad"))), ratio, bits, seed, temperature, ["doc_id", "good"]).select("log_weight", "good").toPandas()  # label_rows at most
    cut = best_cut(known["log_weight"].to_numpy(float), known["good"].to_numpy(bool)) if target.any() else -np.inf
    carried = [f"c{i}" for i in range(len(df.columns))] if keep_columns else ["doc_id"]
    if keep_columns:
        docs = df.toDF(*carried).withColumns({"doc_id": F.col(carried[df.columns.index(id_col)]).cast("long"), "text": F.coalesce(carried[df.columns.index(text_col)], F.lit(""))})
    weights = scratch.save(scored(docs, ratio, bits, seed, temperature, carried), "weights")
    k = weights.where(F.col("log_weight") >= float(cut)).count()
    drawn = weights.where(F.col("sort_key") >= kth_largest(weights, k)) if k else weights.limit(0)
    return drawn.select(*carried).toDF(*df.columns) if keep_columns else drawn.select("doc_id", "log_weight", "gumbel_key", F.lit(True).alias("kept"))
