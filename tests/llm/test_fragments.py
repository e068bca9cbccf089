"""Fragments of the Jaccard join: spare ones outnumber empty ones, and components at 0.8 equal brute force for texts of all sizes."""

import random
from collections import Counter

import numpy as np
import pytest

from gradus.llm import jaccard


def test_hardly_a_set_needs_keys_of_empty_fragments():
    rng = np.random.default_rng(2)
    for num in (80, 90):
        classes = jaccard.Classes(num, 100)
        for size, sets in ((8, 2000), (30, 2000), (100, 1000), (400, 400), (1000, 200), (5000, 50)):
            empty = 0
            for _ in range(sets):
                grams = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
                c = int(np.searchsorted(classes.sizes, len(grams)))
                for k in (c, c + 1):
                    cuts, differ = classes.fragments(k)
                    if cuts:
                        used = len(np.unique(((grams >> np.uint64(32)) * np.uint64(cuts)) >> np.uint64(32)))
                        empty += used <= differ
            assert empty <= (0.005 * sets if size < 400 else 0)


def test_components_of_long_texts(spark):
    rng = random.Random(12)
    vocab = ["q%d" % i for i in range(5000)]
    rows = []
    for size in (300, 700, 1500, 5000):
        base = rng.choices(vocab, k=size)
        for share in (0.0, 0.005, 0.015, 0.03, 0.05):
            t = [rng.choice(vocab) if rng.random() < share else w for w in base]
            rows.append((len(rows), " ".join(t)))
        rows.append((len(rows), " ".join(rng.choices(vocab, k=size))))
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, 5, 80, 100).collect()}
    assert got == label and len(set(label.values())) < len(label)


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_documents_equal_all_pairs(spark, n, num):
    """All documents of a test table, twice over with a few words changed, against an inverted list of all shingles."""
    rng = random.Random(n)
    base = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = list(base)
    for share in (0.004, 0.01, 0.02, 0.03):
        rows += [(len(rows) + 10_000 + i, " ".join("changed" + str(rng.randrange(99)) if rng.random() < share else w for w in t.split())) for i, (_, t) in enumerate(base)]
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = set(zip(*(w[k:] for k in range(n)))) if len(w) >= n else ({tuple(w)} if w else set())
    label, held = {i: i for i in sets}, {}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in held.get(g, ()))
        for j, both in shared.items():
            if 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
        for g in sets[i]:
            held.setdefault(g, []).append(i)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, n, num, 100).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in sets}
