"""Byte-level BPE encoding and decoding over Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradus.llm.common import id_text
from gradus.llm.tokens import ByteBpe, kept, slices


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), and with offsets the first and after-last character of each token.

    Whole texts; null and empty texts have no ids; repeated rows stay repeated; no rows in, none out. One pass without
    a shuffle: a lost executor's partitions are read again.
    """

    def run(batches):
        bpe = kept(ByteBpe, ranks_path, pattern)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                ids = bpe.encode(texts)
                out = {"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.binary())}
                if offsets:
                    spans = [bpe.spans(i, t or "") for i, t in zip(ids, texts)]
                    places = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
                    out |= {k: pa.ListArray.from_arrays(places, np.concatenate([s[j] for s in spans]).astype(np.int32)) for j, k in enumerate(("starts", "ends"))}
                yield pa.RecordBatch.from_pydict(out)

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary" + ", starts array<int>, ends array<int>" * offsets)


def decode(df: DataFrame, ranks_path: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id and bytes (or, with digests, counts and sha256 of ids and bytes) of rows of encode(); null ids have no bytes.

    With digests, rows that have offsets give offsets_sha256 too, of the starts and then the ends as little-endian
    unsigned 32-bit integers.
    """
    spans = ("starts", "ends") if digests and "starts" in df.columns else ()

    def run(batches):
        bpe = kept(ByteBpe, ranks_path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in slices(batch, column="ids"):
                ids = [x or b"" for x in part.column("ids").to_pylist()]
                raw = map(bpe.decode, ids)
                if digests:
                    rows = [(len(i) // 4, sha(i), sha(r)) for i, r in zip(ids, raw)]
                    out = {k: pa.array([r[j] for r in rows], pa.string() if j else pa.int64()) for j, k in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}
                    if spans:
                        cols = [part.column(k) for k in spans]
                        held = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False).astype("<u4")) for c in cols]
                        out["offsets_sha256"] = pa.array([sha(b"".join(v[o[i] : o[i + 1]].tobytes() for o, v in held)) for i in range(len(ids))], pa.string())
                else:
                    out = {"bytes": pa.array(list(raw), pa.binary())}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **out})

    return df.select("doc_id", "ids", *spans).mapInArrow(run, "doc_id long, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", offsets_sha256 string" * bool(spans) if digests else "bytes binary"))
