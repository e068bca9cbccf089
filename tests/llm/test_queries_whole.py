"""Registered queries and the pipeline's run(), as they are called, over small odd tables, against brute force."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from tests.llm.test_llm import ODD, P, RANKS, WORDS, check_packing, tik, u4, words  # noqa: F401

from gradus.llm import dac, queries

DOCS = [(i, t) for i, t in enumerate([*ODD, "last words 漢字 " * 20_000])] + [(None, "no id here"), (3, "a"), (3, "a")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, None, "x", "clash") for i, t in DOCS], "doc_id long, text string, lang string, source string, ids string").write.parquet(f"{d}/documents.parquet")
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=16)]) for i in range(300)]
    rows += [(300, None), (400, [None] + [1.0] * 15), (500, [float("nan")] * 16), (600, [0.0] * 16), (None, [1.0] * 16), (301, rows[20][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


def test_op1(spark, folder, tik):  # noqa: F811
    out = queries.op1_byte_bpe(spark, folder)
    assert out.dtypes[:4] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    want = collections.Counter()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in DOCS:
        ids = tik.encode_ordinary(t or "")
        starts, ends, at = tik.decode_with_offsets(ids)[1], [], 0
        raw = (t or "").encode()
        for k in ids:
            at += len(tik.decode_single_token_bytes(k))
            ends.append(len(raw[:at].decode(errors="ignore")) + (len(raw[:at].decode(errors="ignore").encode()) < at))
        want[i, len(ids), sha(u4(ids)), sha(raw), sha(u4(starts) + u4(ends))] += 1
    assert collections.Counter(map(tuple, out.collect())) == want


def test_op2(spark, folder, words):  # noqa: F811
    check_packing(queries.op2_packing(spark, folder).collect(), DOCS, words, 4096, 1)


def test_op8(spark, folder, words):  # noqa: F811
    out = queries.op8_dac(spark, folder)
    assert out.dtypes[:4] == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    want, at = [], 0
    for i, t in sorted(((i, t or "") for i, t in DOCS), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = words(t) + [2]
        want.append((i, at, len(ids), zlib.crc32(u4(ids))))
        at += len(ids)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == want


def test_any_stretch_of_codes():
    rng = np.random.default_rng(2)
    ids = np.where(rng.random(3000) < 0.5, rng.integers(0, 200, 3000), rng.integers(0, 1 << 26, 3000)).astype(np.uint32)
    code = dac.Dac.frombytes(dac.Dac.encode(ids).tobytes())
    ends = [0, 1, 7, 8, 511, 512, 513, 1024, 1999, 2999, 3000]
    assert all((code.cut(a, b) == ids[a:b]).all() for a in ends for b in ends if a <= b)
    assert len(dac.Dac.encode(np.zeros(0, np.uint32)).cut(0, 0)) == 0


def test_places_of_many_segments(spark, folder, words, tmp_path):  # noqa: F811
    path = f"file://{tmp_path}/tokens"
    dac.write(spark.read.parquet(f"{folder}/documents.parquet"), path, WORDS, segment_tokens=300)
    docs = sorted(((i, t or "") for i, t in DOCS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    flat = [x for _, t in docs for x in [*words(t), 2]]
    places = [0, 5, 1234, len(flat) // 2, len(flat) - 1]
    assert dac.tokens_at(spark, path, [*places, len(flat), -1]) == {p: flat[p] for p in places}
    assert dac.tokens_at(spark, path, []) == {}


def vectors(spark, folder, zero):
    rows = [r for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.vec_id is not None and r.embedding is not None]
    rows = sorted((r.vec_id, np.array(r.embedding, float)) for r in rows if None not in r.embedding and np.isfinite(r.embedding).all())
    return [(i, x) for i, x in rows if zero or x.any()]


def test_op4(spark, folder):
    rows = [(i, np.floor(256 * x).astype(int)) for i, x in vectors(spark, folder, True)]
    want = [(q, k + 1, i, -s) for q, x in rows if q % 50 == 0 for k, (s, i) in enumerate(sorted((-int(x @ y), i) for i, y in rows if i != q)[:5])]
    assert sorted(map(tuple, queries.op4_topk(spark, folder).collect())) == want


def test_op10(spark, folder):
    rows = vectors(spark, folder, False)
    got = collections.defaultdict(dict)
    for r in queries.op10_hamming(spark, folder).collect():
        got[r.query_id][r.rank] = r.vec_id, r.score
    asked = [(q, x) for q, x in rows if q % 20 == 0]
    hits = 0
    for q, x in asked:
        own = {i: float(sum(x * y)) for i, y in rows if i != q}
        found = [got[q][k + 1] for k in range(20)]
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and all(abs(own[i] - s) < 1e-12 for i, s in found)
        hits += len({i for i, _ in found} & set(sorted(own, key=lambda i: (-own[i], i))[:20]))
    assert got.keys() == {q for q, _ in asked} and hits >= 0.9 * 20 * len(asked)


def test_run_of_the_pipeline(spark, words, tmp_path):  # noqa: F811
    import corpus_pipeline as C

    rng = np.random.default_rng(9)
    pick = lambda names, n: " ".join(names[i] for i in rng.integers(0, len(names), n))
    good, poor = [f"good{i}" for i in range(60)], [f"poor{i}" for i in range(60)]
    docs = [(i, pick(poor if i % 3 == 0 else good, 80), "en", "s", 0) for i in range(90)]
    key = "AKIA" + "QWERTYUIOPASDFGH"
    docs[1] = (1, docs[1][1] + f" {key} end", "en", "s", 0)
    docs += [(100 + i, docs[i][1], "en", "s", 0) for i in (1, 2, 4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = C.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in rows}
    assert not any(i < 100 and i % 3 == 0 for i in kept) and not kept & {101, 102, 104}
    assert len(kept) >= 0.9 * 60
    check_packing(rows, [(i, t.replace(key, "[SECRET]")) for i, t, *_ in docs if i in kept], words, 4096, 1)
