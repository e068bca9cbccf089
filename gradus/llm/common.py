"""Shared plumbing: scratch tables, cheap word hashing, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIX = np.uint64(0x9E3779B97F4A7C15)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session. Only a local master may do without one: then it is a temporary one (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gradus-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables in the shared checkpoint folder: written once, reread, so lineage ends there and lost executors cost nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{checkpoint_root(spark)}/gradus-{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts of at most `rows` rows in this session, unless it has a smaller setting."""
    if int(spark.conf.get(BATCH, "10000")) > rows:
        spark.conf.set(BATCH, str(rows))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that are read, so extra columns (of whatever name) can't clash; a null text is empty."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table of ids as a join's smaller side: broadcast if it was counted to hold few rows, hashed after a shuffle if not."""
    return F.broadcast(df) if df.count() <= most else df.hint("shuffle_hash")


class WordHashes(dict):
    """word (bytes) -> stable 64-bit hash; forgets all when full, which costs time only."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Base of the word hashes (odd, so powers can be undone modulo 2 ** 64), and 64 random bits for each byte, upper-case ASCII as lower.
BASE = 0x9FB21C651E98DF25
_bits = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_bits[0x41:0x5B] = _bits[0x61:0x7B]
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
PIECE = 1 << 20  # bytes that are hashed at once


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, n at least."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            step = np.full(max(n, PIECE + 1), b, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def _piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_bits[data] * up[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of an Arrow text column without nulls, in order, and how many each text has.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text with A-Z lower-cased. A word's hash is a polynomial of its bytes, taken from
    prefix sums over pieces of about a megabyte, so no word is handled alone; a longer word is summed block by block.
    """
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, places, raw = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    word = ~_space[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True  # a text begins
    inner = np.zeros(len(data) + 1, bool)  # inner[i]: places i - 1 and i lie in one word
    inner[1:-1] = word[1:] & word[:-1] & ~cut[1:-1]
    starts, ends = np.flatnonzero(word & ~inner[:-1]), np.flatnonzero(word & ~inner[1:]) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        first, last = starts[at], ends[stop - 1]
        if last - first <= PIECE:
            out[at:stop] = _piece(data[first:last], starts[at:stop] - first, ends[at:stop] - first)
        else:
            total = 0
            for k in range(first, last, PIECE):
                block = data[k : min(last, k + PIECE)]
                total += int(_piece(block, np.zeros(1, np.int64), np.array([len(block)]))[0]) * pow(BASE, int(k - first), 1 << 64)
            out[at] = total % (1 << 64)
        at = stop
    return mix64(out), np.diff(np.searchsorted(starts, offsets))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams in order; with fewer words, of the whole sequence as one; none of none."""
    n = min(n, len(h))
    if n == 0:
        return h
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix64(out * MIX + h[k : len(h) - n + 1 + k])
    return mix64(out + np.uint64(n))


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def components(edges: DataFrame, scratch: Scratch, tag: str, max_rounds: int = 40) -> DataFrame:
    """(node, label) for every node of an edge list (a, b); label is the smallest node reachable.

    Alternating large and small stars (Kiveris et al., 2014): each round is two shuffles of an edge list that only
    shrinks; rounds grow with the logarithm of the diameter. Every round is a table in the shared folder. Neighbour
    minima are partial aggregates; a hub's edges meet its minimum in a sort-merge join, whose large partitions Spark splits.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(low, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    cur = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{tag}-0")
    before = None
    for k in range(1, max_rounds + 1):
        cur = scratch.save(star(star(cur, True), False), f"{tag}-{k}")
        scratch.drop(f"{tag}-{k - 1}")
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(cur.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
