"""op3, op5, op9 and the pipeline as they are registered: against brute force, and on empty, null, repeated and very long rows."""

import collections
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.test_llm import ODD, WORDS, brute_components, check_packing, words  # noqa: F401

from gradus.llm import importance, lm_score, queries

MASK = (1 << 64) - 1
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def rows():
    rng = np.random.default_rng(12)
    pick = lambda name, n: " ".join(f"{name}{i}" for i in rng.integers(0, 40, n))
    docs = [(i, pick("poor" if i % 3 == 0 else "good", 50), "en", "s", 0) for i in range(120)]
    docs += [(200 + i, t, "en", "s", 0) for i, t in enumerate(ODD)] + [(300, "good1 good2 " * 20_000, "en", "s", 0), (None, docs[1][1], "en", "s", 0), (None, None, None, None, None)]
    docs += [docs[1], docs[1], (400, docs[2][1], "en", "s", 0), (401, docs[2][1] + " tail", "en", "s", 0)]
    labels = [(i, int(i % 3 != 0), 0) for i in range(80)] + [(5, 1, 1), (None, 1, 0), (81, None, 0), (999, 1, 0), (200, 1, None)]
    return docs, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("registered")
    docs, labels = rows()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{d}/labels.parquet")
    return str(d)


def buckets(text):
    h = [xxhash.xxh3_64_intdigest(w.encode()) for w in importance.TOKENS((text or "").lower())]
    pairs = [1 if a == b else (a * 0x9E3779B97F4A7C15 + mix(b)) & MASK for a, b in zip(h, h[1:])]
    return collections.Counter([x >> 48 for x in h] + [mix(p) >> 48 for p in pairs])


def test_op5_equals_brute_force(spark, folder):
    docs, labels = rows()
    mine = {r.doc_id: r.m for r in spark.range(1000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2)) == 0).alias("m")).collect()}
    kind = {}
    for i, q, t in labels:
        if i is not None and q is not None:
            good, bad = kind.get(i, (True, False))
            kind[i] = (good and q > 0 and not t, bad or q <= 0)
    held = [(i, buckets(t)) for i, t, *_ in docs]
    raw, target = collections.Counter(), collections.Counter()
    for i, b in held:
        raw += b
        if i in kind and kind[i][0] and mine[i]:
            target += b
    rate = sum(target.values()) / sum(raw.values())
    ratio = {k: math.log((target[k] + 8) / (n * rate + 8)) for k, n in raw.items()}
    weight = [(i, sum(ratio[k] * n for k, n in b.items())) for i, b in held]
    known = sorted((w, kind[i][0]) for i, w in weight if i in kind and not mine[i] and any(kind[i]))
    n_good = sum(g for _, g in known)
    gains = [sum(not g for _, g in known[: k + 1]) / (len(known) - n_good) - sum(g for _, g in known[: k + 1]) / n_good for k in range(len(known))]
    at = gains.index(max(gains))
    cut = (known[at][0] + known[at + 1][0]) / 2
    k = sum(w >= cut for _, w in weight)
    assert 0 < k < len(weight)
    noise = lambda i: -math.log(-math.log(((mix(((i or 0) * 0x9E3779B97F4A7C15 + 3) & MASK) >> 12) + 0.5) / 2.0**52))
    keys = sorted((w + noise(i) for i, w in weight), reverse=True)
    want = collections.Counter((i, round(w, 6)) for i, w in weight if w + noise(i) >= keys[k - 1] - 1e-9)
    got = queries.op5_importance(spark, folder).collect()
    assert collections.Counter((r.doc_id, round(r.log_weight, 6)) for r in got) == want and all(r.kept for r in got)
    assert max(abs(r.gumbel_key - r.log_weight - noise(r.doc_id)) for r in got) < 1e-9


def test_op3_equals_its_operator_on_rows_that_are_written_first(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    show = lambda df: sorted((repr(r.doc_id), r.n_tokens, *(None if x is None else round(x, 9) for x in (r.target_loss, r.background_loss, r.score))) for r in df.collect())
    got = show(queries.op3_lm_score(spark, folder))
    assert got == show(lm_score.cross_entropy_difference(docs.repartition(5, "text"), labels)) and len(got) == docs.count()


def test_op9_equals_all_pairs(spark, folder):
    docs, _ = rows()
    want = brute_components({i: t for i, t, *_ in docs if i is not None}, 3, 90, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_jaccard(spark, folder).collect() if r.doc_id is not None}
    assert got == want


def test_pipeline_of_odd_rows(spark, folder, words):  # noqa: F811
    import corpus_pipeline as C

    docs, _ = rows()
    kept = C.STAGES[0][1](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    classes = brute_components({r.doc_id: r.text for r in kept if r.doc_id is not None}, 5, 80, 100)
    left = [(r.doc_id, r.text) for r in kept if r.doc_id is None or classes[r.doc_id][1] == r.doc_id]
    out = C.run(spark, folder).collect()
    check_packing(out, left, words, 4096, 1)
    assert {r.doc_id for r in out} == {i for i, _ in left}


@pytest.mark.parametrize("full", ["", "labels"])
def test_pipeline_of_empty_tables(spark, tmp_path, full):
    import corpus_pipeline as C

    _, labels = rows()
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels if full else [], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
    assert queries.op13_audit(spark, str(tmp_path)).count() == queries.op12_fill_middle(spark, str(tmp_path)).count() == 0
