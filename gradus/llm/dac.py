"""Token streams as directly addressable codes: any token is read without decoding a block."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm.common import Scratch, id_text
from gradus.llm.tokens import WordBpe, kept, slices

MAGIC, RANK_BITS = b"GDAC\x01", 512


class Dac:
    """Levels of 8-bit chunks of ids, lowest first. A level's bitmap marks the ids that go on in the next one; a directory
    holds the marks before every RANK_BITS bits, so the place in the next level is one look-up and a count in one block."""

    def __init__(self, levels):
        self.levels = levels

    @classmethod
    def encode(cls, ids: np.ndarray) -> Dac:
        ids, levels = np.asarray(ids, np.uint32), []
        while True:
            rest = ids >> np.uint32(8)
            more = rest != 0
            bits = np.packbits(more, bitorder="little")
            block = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
            levels.append(((ids & np.uint32(255)).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(block)[:-1]]).astype("<u4") if len(block) else block.astype("<u4")))
            ids = rest[more]
            if not len(ids):
                return cls(levels)

    def decode(self) -> np.ndarray:
        out = np.zeros(0, np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            more = np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)
            own = chunk.astype(np.uint32)
            own[more] |= out << np.uint32(8)
            out = own
        return out

    def cut(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1 without the others: each level gives its own stretch, and the marks before it, by the directory
        and the bits of one block, tell where the next level's stretch begins."""
        parts = []
        for chunk, bits, ranks in self.levels:
            if a == b:
                break
            block = a // RANK_BITS
            marks = np.unpackbits(bits[block * RANK_BITS // 8 : (b + 7) // 8], count=b - block * RANK_BITS, bitorder="little").view(bool)
            more = marks[a - block * RANK_BITS :]
            parts.append((chunk[a:b], more))
            a = int(ranks[block]) + int(np.count_nonzero(marks[: a - block * RANK_BITS]))
            b = a + int(np.count_nonzero(more))
        out = np.zeros(0, np.uint32)
        for chunk, more in reversed(parts):
            own = chunk.astype(np.uint32)
            own[more] |= out << np.uint32(8)
            out = own
        return out

    def __getitem__(self, i: int) -> int:
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            i = int(ranks[block]) + int(np.unpackbits(bits[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS].sum())
        return value

    def tobytes(self) -> bytes:
        out = [MAGIC, struct.pack("<I", len(self.levels))]
        for chunk, bits, ranks in self.levels:
            out += [struct.pack("<QQQ", len(chunk), len(bits), len(ranks)), chunk.tobytes(), bits.tobytes(), ranks.tobytes()]
        return b"".join(out)

    @classmethod
    def frombytes(cls, data: bytes) -> Dac:
        if data[:5] != MAGIC:
            raise ValueError("not a DAC segment")
        (n,), at, levels = struct.unpack_from("<I", data, 5), 9, []
        for _ in range(n):
            chunks, bits, ranks = struct.unpack_from("<QQQ", data, at)
            at += 24
            parts = []
            for size, kind in ((chunks, np.uint8), (bits, np.uint8), (ranks, np.dtype("<u4"))):
                parts.append(np.frombuffer(data, kind, size, at))
                at += size * np.dtype(kind).itemsize
            levels.append(tuple(parts))
        return cls(levels)


SEGMENT = "part int, seq int, first long, n_tokens long, doc_ids binary, sizes binary, dac binary"


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = 1 << 20) -> None:
    """Encode every whole text, append end_id and write `path`/segments and `path`/parts.

    Documents lie in ascending doc_id order, null ids first, equal ids by text; a null or empty text is end_id alone.
    A segment holds whole documents, about segment_tokens ids, as one row: place, doc ids (with a null mark), sizes
    and the codes of its ids. parts holds each partition's first place in the stream. The texts are dealt by ranges
    of doc_id, so no task needs more than its range; the files are committed by Spark's writer.
    """

    def run(batches):
        bpe, part = kept(WordBpe, tokenizer), TaskContext.get().partitionId()
        end, seq, first = end_id.to_bytes(4, "little"), 0, 0
        docs, ids, held = [], [], 0

        def segment():
            data = b"".join(ids)
            marks = np.array([(0 if d is None else d, d is None) for d in docs], [("id", "<i8"), ("null", "u1")])
            sizes = np.array([len(x) // 4 for x in ids], "<u8").tobytes()
            row = [part, seq, first, len(data) // 4, marks.tobytes(), sizes, Dac.encode(np.frombuffer(data, "<u4")).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "seq", "first", "n_tokens", "doc_ids", "sizes", "dac"])

        for batch in batches:
            for piece in slices(batch):
                for doc, own in zip(piece.column("doc_id").to_pylist(), bpe.encode(piece.column("text").to_pylist())):
                    docs.append(doc)
                    ids.append(own + end)
                    held += len(own) // 4 + 1
                    if held >= segment_tokens:
                        yield segment()
                        seq, first, docs, ids, held = seq + 1, first + held, [], [], 0
        if docs:
            yield segment()

    docs = id_text(df, id_col, text_col)
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SEGMENT).write.mode("overwrite").parquet(f"{path}/segments")
    spark = df.sparkSession
    parts = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition of the stream
    parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base")).write.mode("overwrite").parquet(f"{path}/parts")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with `start`, their first place in the stream."""
    parts = spark.read.parquet(f"{path}/parts")
    return spark.read.parquet(f"{path}/segments").join(parts, "part").withColumn("start", F.col("base") + F.col("first"))


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, read back from the files."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                marks = np.frombuffer(row["doc_ids"], [("id", "<i8"), ("null", "u1")])
                sizes = np.frombuffer(row["sizes"], "<u8").astype(np.int64)
                codes, ends = Dac.frombytes(row["dac"]), np.cumsum(sizes)
                own = [codes.cut(e - s, e).astype("<u4").tobytes() for s, e in zip(sizes.tolist(), ends.tolist())]
                cols = [pa.array(marks["id"].astype(np.int64), mask=marks["null"].astype(bool)), pa.array(row["start"] + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(own, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    stored = segments(spark, path).select("start", "doc_ids", "sizes", "dac")
    return stored.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def tokens_at(spark: SparkSession, path: str, places: list[int]) -> dict[int, int]:
    """The ids at some places of the stream, each by its segment's levels alone; places outside the stream are left out.

    The places are sorted and each segment finds its own by binary search. A first pass reads the segments' places, so
    the second one asks the files for no other part than those that hold a wanted id.
    """
    wanted = np.unique(np.array(places, np.int64))

    def own(start, n):
        return wanted[np.searchsorted(wanted, start) : np.searchsorted(wanted, start + n)]

    def find(batches):
        for batch in batches:
            rows = [r for r in batch.to_pylist() if len(own(r["start"], r["n_tokens"]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32()) for k in ("part", "seq")], names=["part", "seq"])

    def look(batches):
        for batch in batches:
            for r in batch.to_pylist():
                at, codes = own(r["start"], r["n_tokens"]), Dac.frombytes(r["dac"])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([codes[p - r["start"]] for p in at.tolist()], pa.int64())], names=["place", "id"])

    hit = segments(spark, path).select("part", "seq", "start", "n_tokens").mapInArrow(find, "part int, seq int").collect()
    some = segments(spark, path).where(F.col("part").isin(sorted({r["part"] for r in hit})) & F.col("seq").isin(sorted({r["seq"] for r in hit})))
    return {r["place"]: r["id"] for r in some.select("start", "n_tokens", "dac").mapInArrow(look, "place long, id long").collect()}


def stream(df: DataFrame, tokenizer: str, end_id: int = 2, **kw) -> DataFrame:
    """Write a new stream to the shared folder and read its documents back, without their ids."""
    path = f"{Scratch(df.sparkSession, 'dac').path}/tokens"
    write(df, path, tokenizer, end_id, **kw)
    return read(df.sparkSession, path, with_ids=False)
