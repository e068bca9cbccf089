"""Best-two-fit packing of whole documents into sequences of bounded length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import Scratch, id_text
from gradus.llm.tokens import WordBpe, kept, slices


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) of sequences for counts[length] pieces of each length.

    A sequence starts with the longest piece left and takes the longest that fits until none does. Then its smallest
    piece goes back if two other pieces fit the gap it leaves more tightly. Pieces of one length are alike, so one
    sequence stands for as many as its lengths' counts allow: work and result grow with the number of lengths (the
    capacity at most), not with the pieces.
    """
    left = np.zeros(capacity + 2, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left[length] = n
    plan = []
    lengths = np.arange(capacity + 2)

    def at_most() -> np.ndarray:
        return np.maximum.accumulate(np.where(left > 0, lengths, 0))

    while left.any():
        take, gap, fit = [], capacity, at_most()
        while (x := int(fit[gap])) > 0:
            n = int(min(left[x], gap // x))
            take += [x] * n
            gap -= n * x
            left[x] -= n
            fit = at_most() if left[x] == 0 else fit
        if gap and len(take) > 1:
            small = take[-1]
            room = gap + small
            first = lengths[1 : room + 1]
            first = first[left[first] > 0]
            second = fit[room - first] if len(first) else first
            ok = (second > 0) & ((second != first) | (left[first] > 1))
            total = np.where(ok, first + second, 0)
            if len(total) and (best := int(total.max())) > small:
                a = int(first[int(np.argmax(total))])
                left[small] += 1
                left[[a, best - a]] -= 1 if a != best - a else 0
                if a == best - a:
                    left[a] -= 2
                take[-1:] = [max(a, best - a), min(a, best - a)]
        used, many = np.unique(take, return_counts=True)
        more = int((left[used] // many).min())
        left[used] -= more * many
        plan.append((1 + more, take))
    return plan


def places(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the rank at which each slot begins, its first sequence less that rank, and its offset."""
    rows: dict[int, list] = {}
    done: dict[int, int] = {}
    sequence = 0
    for times, take in plan:
        offset = 0
        for x in take:
            rank = done.get(x, 0)
            rows.setdefault(x, []).append((rank, sequence - rank, offset))
            done[x] = rank + times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in rows.items()}


def pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Pieces of tokenized documents, each but a document's last of full length."""

    def run(batches):
        bpe = kept(WordBpe, tokenizer)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), bpe.encode(part.column("text").to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own), own))
                cols = list(zip(*rows))
                kinds = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()))[: 5 + with_ids]
                yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(kinds, cols)})

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, group_rows: int = 200_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset of every piece of every document.

    A null or empty text is one piece that holds end_id alone. Pieces of equal length are ranked by doc_id, piece and
    content; repeated rows are packed each. No rows in, none out. The driver gets one count for each length only, of
    which there are at most `capacity`. Ranks come from windows of about group_rows pieces (a length that a third of
    all documents share is salted into many), put together by prefix sums of their counts.
    """
    scratch = Scratch(df.sparkSession, "packing")
    cut = scratch.save(pieces(df, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = places(best_two_fit(counts, capacity))
    salts = max(8, -(-max(counts.values(), default=0) // group_rows))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order)).join(bases, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base") - 1)
    kept_cols = cut.columns

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                starts, first, offset = slots[int(x)]
                k = np.searchsorted(starts, rank[own], "right") - 1
                seq[own], off[own] = first[k] + rank[own], offset[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept_cols), pa.array(seq), pa.array(off)], names=[*kept_cols, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*kept_cols, "rank").mapInArrow(run, schema)
