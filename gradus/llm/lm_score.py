"""LM scoring by cross-entropy difference of matched target and background bigram models."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import Scratch, id_text, word_hashes
from gradus.llm.importance import kinds
from gradus.llm.tokens import slices

MIXED = 0.6  # weight of the pair's share
OWN = 0.9  # weight of the target's own words against those of all rows
HELD, SENT = 700_000, 250_000  # words that a task holds before it counts them, and rows of a batch


def grams(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts of an Arrow column in a row: keys of the words, whether a pair ends at each (not at a text's first
    word), and the number of words of each text. Words are ASCII-lower-cased."""
    h, size = word_hashes(texts)
    inner = np.ones(len(h), bool)
    inner[(np.cumsum(size) - size)[size > 0]] = False
    return h, inner, size


class Target:
    """Which rows are of the target, a bit a row: rows are known by their partition and their place in it."""

    BLOCK = 1 << 15  # bits of Spark's bitmaps

    def __init__(self, docs: DataFrame, labels: DataFrame):
        def rows(batches):
            part, row = TaskContext.get().partitionId(), 0
            for batch in batches:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n))], names=["doc_id", "part", "row"])
                row += n

        mine = docs.select("doc_id").mapInArrow(rows, "doc_id long, part int, row long").join(kinds(labels).where("good"), "doc_id")
        block = F.floor(F.col("row") / self.BLOCK).alias("block")
        self.blocks: dict = {}
        for r in mine.groupBy("part", block).agg(F.bitmap_construct_agg(F.col("row") % self.BLOCK).alias("bits")).collect():
            self.blocks.setdefault(r["part"], {})[r["block"]] = bytes(r["bits"]).rstrip(b"\0")

    def parts(self, batches):
        """Slices of a task's texts, with their rows' numbers, which are odd in the target."""
        task, row = TaskContext.get().partitionId(), 0
        held = self.blocks.get(task, {})
        mine = np.zeros((max(held, default=-1) + 1) * self.BLOCK, np.int64)
        for k, bits in held.items():
            mine[k * self.BLOCK :][: 8 * len(bits)] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        for batch in batches:
            for part in slices(batch):
                own = np.zeros(part.num_rows, np.int64)
                some = mine[row : row + part.num_rows]
                own[: len(some)] = some
                yield part, (task << 37) + 2 * np.arange(row, row + part.num_rows) + own
                row += part.num_rows


class Places:
    """Places of keys in a sorted list, by direct addressing on their first bits: keys are uniform hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(8, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits), out=self.starts[1:], dtype=np.int32)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Place of each x, -1 where it isn't listed."""
        slot = (x >> self.shift).astype(np.int64)
        at, end = self.starts[slot], self.starts[slot + 1]
        out = np.full(len(x), -1, np.int32)
        todo = np.flatnonzero(end > at)
        while len(todo):
            hit = self.keys[at[todo]] == x[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


def counted(docs: DataFrame, target: Target) -> DataFrame:
    """(key, n, own): how often all texts hold each word, and how often the target's do.

    Tasks send what they counted; it is summed only after the shuffle, since before it hardly a key repeats.
    """

    def rows(held: list[tuple]):
        key, own = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1)))
        both = (np.diff(new, append=len(key)) << 31) + np.add.reduceat(own[order], new)
        key = key[new].view(np.int64)
        for i in range(0, len(key), SENT):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + SENT]), pa.array(both[i : i + SENT])], names=["key", "both"])

    def run(batches):
        held, size = [], 0
        for part, row in target.parts(batches):
            h, _, n = grams(part.column("text"))
            held.append((h, np.repeat(row & 1, n)))
            size += len(h)
            if size > HELD:
                yield from rows(held)
                held, size = [], 0
        if size:
            yield from rows(held)

    own = F.col("both").bitwiseAND((1 << 31) - 1)
    return docs.mapInArrow(run, "key long, both long").repartition("key").groupBy("key").agg(F.sum(F.shiftright("both", 31)).alias("n"), F.sum(own).alias("own"))


class Listed:
    """What each task holds: the listed words with their counts in all rows and in the target, and the gains of pairs of
    two frequent words, of which there are at most 1024.

    Background: p(w | v) = a c(vw) / c(v) + (1 - a) p(w), with p(w) = (c(w) + 1) / (N + V) over a vocabulary of V words,
    one of which stands for all others. Target: the same with its own counts t, and OWN t(w) / T + (1 - OWN) p(w) for
    p(w): both rest on one count of words, so the target doesn't flatten as the rows grow. A text's first word has p(w)
    alone. A pair that all rows hold once doesn't count there, nor what the target holds once in the target.
    """

    def __init__(self, words, size: int, tokens: int, frequent: int, mix: float = MIXED):
        order = np.argsort(words["key"].to_numpy(np.int64).view(np.uint64))
        self.words = words["key"].to_numpy(np.int64).view(np.uint64)[order]
        self.count, self.mine = (words[c].to_numpy(np.int64)[order].astype(float) for c in ("n", "own"))
        self.mine[self.mine < 2] = 0
        self.size, self.mix = float(size), mix
        self.alone = (self.count + 1) / self.size
        self.alone_own = OWN * self.mine / max(1, tokens) + (1 - OWN) * self.alone
        self.odds = mix / (1 - mix)
        self.rank = np.full(len(self.words), -1, np.int64)
        self.often = np.flatnonzero(self.count >= frequent)
        self.rank[self.often] = np.arange(len(self.often))
        self.gain, self.gain_own = np.zeros((2, len(self.often) ** 2))

    def set_gains(self, cells) -> None:
        """Counts of pairs of frequent words become what they take off the loss of the second word alone."""
        cell, n, own = cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(float), cells["own"].to_numpy(float)
        k = max(1, len(self.often))
        v, w = self.often[cell // k], self.often[cell % k]
        self.gain[cell] = np.where(n > 1, np.log1p(self.odds * n / (self.count[v] * self.alone[w])), 0)
        self.gain_own[cell] = np.where(own > 1, np.log1p(self.odds * own / (np.maximum(1, self.mine[v]) * self.alone_own[w])), 0)

    def cells(self, place: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a pair of two frequent words ends, and its cell."""
        rank = np.where(place >= 0, self.rank[place], -1) if len(self.rank) else place
        at = np.flatnonzero((rank >= 0) & inner)
        at = at[rank[at - 1] >= 0]
        return at, rank[at - 1] * len(self.often) + rank[at]

    def losses(self, place: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Target's and background's loss of each word but for what is known where rows of a key meet: counts of words that
        aren't listed, and gains of pairs not of two frequent words."""
        listed = place >= 0
        at, cell = self.cells(place, inner)
        out = []
        for alone, rest, gain in ((self.alone_own, (1 - OWN) / self.size, self.gain_own), (self.alone, 1 / self.size, self.gain)):
            loss = np.full(len(place), -math.log(rest))
            loss[listed] = -np.log(alone[place[listed]])
            loss -= inner * math.log(1 - self.mix)
            loss[at] -= gain[cell]
            out.append(loss)
        return tuple(out)

    def factors(self) -> pa.Table:
        """By the place of a listed word: what a pair's counts are multiplied by, for its first word and for its second."""
        return pa.table({"place": np.arange(len(self.words)), "v": self.odds / self.count, "v_own": self.odds / np.maximum(1, self.mine), "w": 1 / self.alone, "w_own": 1 / self.alone_own})


def cross_entropy_difference(df: DataFrame, labels: DataFrame, listed_words: int = 1 << 18, frequent_words: int = 1 << 10, own_words: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", stable: bool = False) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row; score is the mean difference a token.

    Both models share one vocabulary, all words that the rows hold twice or more; every other word is the one unknown
    word. Pairs are of listed words: those of at least 1 / listed_words of all tokens, or of 1 / own_words of the target's
    and two of them at least (so there are no more than both numbers). The background counts the vocabulary and all pairs
    that the rows hold twice or more over all rows, the target over all good labelled ones, so both grow with them.
    A null or empty text has no tokens and null losses; repeated rows are scored each.
    Without a good labelled document the target is the background and every score 0. No rows in, none out.

    Listed words are held in each task, and pairs of two words of at least 1 / frequent_words are counted in tables of
    bounded size. Every other word or pair of a text is one row, dealt by its key: there all rows of a key meet, so their
    number is its count, the number of odd ones the target's, and what both take off its document's losses goes back to
    the document. No key holds more than 1 / frequent_words of all rows. Rows are numbered as they lie in their
    partitions, in each of several scans, and a bit a row says which are the target's: so df is
    written once and read from there, unless it is `stable`, a table of files, whose scans split and order rows alike.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "lm")
    docs = id_text(df, id_col, text_col)
    if not stable:
        docs = scratch.save(docs, "rows")
    target = Target(docs, labels)
    counts = scratch.save(counted(docs, target), "words")
    all_tokens, size, lone, tokens = counts.agg(F.sum("n"), F.count_if(F.col("n") > 1), F.count_if(F.col("n") == 1), F.sum("own")).first()
    all_tokens, size, tokens = all_tokens or 0, size + 1, tokens or 0
    floor, frequent, own_floor = (max(2, -(-n // most)) for n, most in ((all_tokens, listed_words), (all_tokens, frequent_words), (tokens, own_words)))
    held = Listed(counts.where((F.col("n") >= floor) | (F.col("own") >= own_floor)).toPandas(), all_tokens + size, tokens, frequent)
    k = len(held.often)

    def frequent_pairs(batches):
        places, total = Places(held.words), np.zeros(2 * k * k, np.int64)
        for part, row in target.parts(batches):
            h, inner, n = grams(part.column("text"))
            at, cell = held.cells(places.of(h), inner)
            total += np.bincount(2 * cell + np.repeat(row & 1, n)[at], minlength=2 * k * k)
        rest, own = total.reshape(-1, 2).T
        cell = np.flatnonzero(rest + own)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array((rest + own)[cell]), pa.array(own[cell])], names=["cell", "n", "own"])

    held.set_gains(docs.mapInArrow(frequent_pairs, "cell int, n long, own long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("own").alias("own")).toPandas())

    def own_losses(batches):
        places = Places(held.words)
        for part, row in target.parts(batches):
            h, inner, size = grams(part.column("text"))
            at = places.of(h)
            some, begin = size > 0, np.cumsum(size) - size
            cols = [part.column("doc_id"), pa.array(row), pa.array(size)]
            for v in (*held.losses(at, inner), (at < 0).astype(float)):
                sums = np.zeros(len(size))
                if len(h):
                    sums[some] = np.add.reduceat(v, begin[some])
                cols.append(pa.array(sums))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n_tokens", "target", "background", "unlisted"])

    def rare(batches):
        """Negative keys are words that aren't listed; others are pairs of listed words' places."""
        places = Places(held.words)
        for part, row in target.parts(batches):
            h, inner, size = grams(part.column("text"))
            place, row = places.of(h).astype(np.int64), np.repeat(row, size)
            inner[held.cells(place, inner)[0]] = False  # counted in the table
            at = np.flatnonzero(inner & (place >= 0))
            at = at[place[at - 1] >= 0]
            alone = np.flatnonzero(place < 0)
            keys = np.concatenate([(h[alone] | np.uint64(1 << 63)).view(np.int64), place[at - 1] * len(held.words) + place[at]])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([row[alone], row[at]]))], names=["key", "row"])

    key, word, n, own = F.col("key"), F.col("key") < 0, F.col("n"), F.col("own")
    same = Window.partitionBy("key")
    met = docs.mapInArrow(rare, "key long, row long").repartition("key").withColumns({"n": F.count("*").over(same), "own": F.sum(F.col("row").bitwiseAND(1)).over(same)}).where("n > 1")
    factors, many = F.broadcast(spark.createDataFrame(held.factors(), "place long, v double, v_own double, w double, w_own double")), max(1, len(held.words))
    for side, place in (("first", F.floor(key / many)), ("second", key % many)):
        met = met.join(factors.alias(side), F.when(~word, place) == F.col(f"{side}.place"), "left")
    gain = F.when(word, F.log(n + 1.0)).otherwise(F.log1p(F.col("first.v") * F.col("second.w") * n))
    word_own = OWN / (1 - OWN) * held.size / max(1, tokens) / (n + 1.0)
    gain_own = F.when(word, F.log(n + 1.0)).otherwise(0.0) + F.when(own > 1, F.log1p(own * F.when(word, word_own).otherwise(F.col("first.v_own") * F.col("second.w_own")))).otherwise(0.0)
    met = met.groupBy("row").agg(F.sum(gain).alias("gains"), F.sum(gain_own).alias("gains_own"), F.count_if(word).alias("met"))

    sums = docs.mapInArrow(own_losses, "doc_id long, row long, n_tokens long, target double, background double, unlisted double")
    out = sums.join(met, "row", "left")
    unknown = (F.col("unlisted") - F.coalesce("met", F.lit(0))) * math.log(lone + 1)
    background_loss = (F.col("background") - unknown - F.coalesce("gains", F.lit(0.0))) / F.col("n_tokens")
    target_loss = (F.col("target") - unknown - F.coalesce("gains_own", F.lit(0.0))) / F.col("n_tokens") if tokens else background_loss
    out = out.select("doc_id", "n_tokens", F.when(F.col("n_tokens") > 0, target_loss).alias("target_loss"), F.when(F.col("n_tokens") > 0, background_loss).alias("background_loss"))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
