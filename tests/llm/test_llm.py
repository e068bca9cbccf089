"""Operators of the training-data pipeline against brute force, round trips and held-out cases."""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradus.llm import byte_bpe, common, dac, hamming, html_blocks, importance, jaccard, lm_score, packing, secret_scan, topk
from gradus.llm.queries import RANKS, WORDS
from gradus.llm.tokens import ByteBpe, WordBpe

ODD = [None, "", " ", "a", "a", "A  b\n\nc", "naïve café — 漢字 🙂 x", "İstanbul ſtart ΣΑΣ", "tab\tand nbsp wide ", "'s it's <|endoftext|> 12345", "w" * 5000, "word " * 3000, "\x1c\x85end", "é combining"]
SCHEMA = "doc_id long, text string, ids string, length string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", None) for i, t in enumerate(ODD)] + [(None, "no id here", "x", None), (3, "a", "x", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def u4(ids):
    return np.array(ids, "<u4").tobytes()


def test_tokenizers_equal_their_libraries_on_odd_characters(tik, words):
    rng = random.Random(1)
    bpe, word = ByteBpe(RANKS, P.PATTERN), WordBpe(WORDS)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x2000, 0x2070), 0x3000, 0x4E00, 0x1F600, 0x301, 0x130, 0x17F, 0x212A]] + [" "] * 200 + ["a", "B", "1", "'"] * 40
    for _ in range(600):
        s = "".join(rng.choices(pool, k=rng.randrange(1, 40)))
        assert bpe.encode([s])[0] == u4(tik.encode_ordinary(s))
        assert word.encode([s])[0] == u4(words(s))


def test_byte_bpe(docs, tik):
    out = byte_bpe.encode(docs, RANKS, P.PATTERN)
    rows = out.collect()
    assert len(rows) == docs.count()
    texts = collections.Counter((r.doc_id, r.text or "") for r in docs.collect())
    bpe = ByteBpe(RANKS, P.PATTERN)
    assert texts == collections.Counter((r.doc_id, bpe.decode(bytes(r.ids)).decode()) for r in rows)
    for r in rows:
        t = bpe.decode(bytes(r.ids)).decode()
        assert bytes(r.ids) == u4(tik.encode_ordinary(t))
        for i, a, b in zip(np.frombuffer(r.ids, "<u4"), r.starts, r.ends):
            assert tik.decode_single_token_bytes(int(i)) in t[a:b].encode()
    d = byte_bpe.decode(out, RANKS, P.PATTERN, digests=True).collect()
    assert all(r.decoded_sha256 == hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest() for r in d if r.doc_id is not None)
    assert byte_bpe.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


def check_packing(rows, texts, words, capacity, end):
    by, want = collections.defaultdict(list), collections.Counter()
    for doc, t in texts:
        ids = words(t) + [end]
        for k in range(0, len(ids), capacity):
            want[doc, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(u4(ids[k : k + capacity]))] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for seq in by.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in rows)


def test_packing(docs, words):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    for size in (4096, 64):
        rows = packing.pack(docs, WORDS, capacity=size, group_rows=3).collect()
        check_packing(rows, texts, words, size, 1)
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_best_two_fit_swaps_and_keeps_counts():
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)  # 6+3 leaves 1; 2+2 fills the gap of 4 that 3 leaves
    assert sorted(plan[0][1]) == [2, 2, 6]
    rng = np.random.default_rng(0)
    counts = {int(x): int(n) for x, n in zip(*np.unique(rng.integers(1, 1000, 20_000), return_counts=True))}
    plan = packing.best_two_fit(counts, 1000)
    used = collections.Counter()
    for times, take in plan:
        assert sum(take) <= 1000
        for x in take:
            used[x] += times
    assert used == counts
    assert sum(t for t, _ in plan) <= 1.005 * -(-sum(x * n for x, n in counts.items()) // 1000)


def test_dac(spark, docs, words, tmp_path):
    ids = np.concatenate([np.random.default_rng(1).integers(0, 1 << b, 700) for b in (4, 9, 17, 32)]).astype(np.uint32)
    code = dac.Dac.frombytes(dac.Dac.encode(ids).tobytes())
    assert (code.decode() == ids).all() and all(code[i] == ids[i] for i in range(0, len(ids), 7))
    path = f"file://{tmp_path}/tokens"
    dac.write(docs, path, WORDS, segment_tokens=500)
    got = dac.read(spark, path).orderBy("start").collect()
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.doc_id for r in got] == [t[0] for t in texts]
    every = [words(t) + [2] for _, t in texts]
    assert [bytes(r.ids) for r in got] == [u4(i) for i in every]
    flat = [x for i in every for x in i]
    assert [r.start for r in got] == list(np.cumsum([0] + [len(i) for i in every])[:-1])
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in got)
    places = [0, 1, len(flat) // 2, len(flat) - 1]
    assert dac.tokens_at(spark, path, places) == {p: flat[p] for p in places}
    assert dac.stream(docs.limit(0), WORDS).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16))
    x[300:400] = x[300]  # a hot vector: many ties
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2050, []), (2100, [1.0, None] * 8), (2150, [float("nan")] * 16), (2200, [float("inf")] + [0.0] * 15), (2250, [0.0] * 16), (None, [1.0] * 16), (7, rows[7][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))


def test_threshold_search(spark, vectors):
    good = {r.vec_id: np.floor(256 * np.array(r.embedding)) for r in vectors.collect() if r.vec_id is not None and (r.vec_id < 900 or r.vec_id == 2250)}
    got = collections.defaultdict(list)
    for r in topk.threshold_search(vectors, every=10, k=5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in (i for i in good if i % 10 == 0):
        best = sorted(((-int(v @ good[q]), i) for i, v in good.items() if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert len(got) == sum(i % 10 == 0 for i in good)
    assert topk.threshold_search(vectors.limit(0)).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(2)
    values = np.floor(256 * rng.normal(size=(4000, 3)))
    lists = topk.SortedLists(np.arange(4000), values)
    reads = []
    take = lists.order
    class Seen:
        def __getitem__(self, key):
            out = take[key]
            reads.append(out.size)
            return out
    lists.order = Seen()
    ids, scores = lists.top(-1, np.array([3.0, -2.0, 0.5]), 5)
    assert sorted(-(values @ [3.0, -2.0, 0.5]))[:5] == sorted(-scores)
    assert sum(reads) < 3 * 4000 / 2


def test_hamming_search(vectors):
    good = {r.vec_id: np.array(r.embedding) for r in vectors.collect() if r.vec_id is not None and r.vec_id < 900}
    got = collections.defaultdict(dict)
    for r in hamming.hamming_search(vectors, every=20, k=20).collect():
        got[r.query_id][r.vec_id] = r.score
    recall = []
    for q in (i for i in good if i % 20 == 0):
        best = sorted((-float(v @ good[q]), i) for i, v in good.items() if i != q)[:20]
        worst = -best[-1][0]
        recall.append(np.mean([s >= worst - 1e-9 for s in got[q].values()]))
        assert len(got[q]) == 20 and all(abs(s - good[q] @ good[i]) < 1e-12 for i, s in got[q].items())
    assert np.mean(recall) >= 0.9
    assert hamming.hamming_search(vectors.limit(0)).count() == 0


def test_every_code_within_radius():
    codes = np.random.default_rng(3).integers(0, 256, (2000, 4)).astype(np.uint8)
    index = hamming.MultiIndex(codes)
    for q in codes[:20]:
        for r in (0, 3, 9, 14):
            want = np.flatnonzero(np.unpackbits(codes ^ q, axis=1).sum(1) <= r)
            assert (np.sort(index.within(q, r)) == want).all()


def brute_sets(text, n):
    w = [bytes(x) for x in (text or "").encode().lower().split()]
    return set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(texts, n, num, den):
    sets = {i: brute_sets(t, n) for i, t in texts.items()}
    label = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        before = dict(label)
        for i in ids:
            for j in ids:
                if i < j and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard(spark, n, num, den):
    rng = random.Random(n)
    vocab = ["w%d" % i for i in range(60)]
    texts = [None, "", "  ", "one", "One", "one two", "a b c"]
    for _ in range(12):
        base = rng.choices(vocab, k=rng.choice([4, 9, 12, 30, 80, 300]))
        for _ in range(rng.choice([1, 2, 8])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    texts = dict(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, label int").repartition(4)
    want = brute_components(texts, n, num, den)
    for rows in (2048, 3):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, n, num, den, block_rows=rows).collect()}
        assert got == want
    assert jaccard.jaccard_components(df.limit(0), n, num, den).count() == 0


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(4)
    for _ in range(300):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 400))).astype(np.uint64)
        x = np.unique(base)
        y = np.unique(np.concatenate([base[rng.random(len(base)) < rng.random()], rng.integers(0, 1 << 63, int(rng.integers(0, 300))).astype(np.uint64)]))
        if len(y):
            a, b = jaccard.bitmap(x), jaccard.bitmap(y)
            assert len(a) * 8 >= max(64, len(x))
            assert jaccard.differing(int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a), 8 * len(b)) <= len(np.setxor1d(x, y))


def test_jaccard_of_large_groups_and_shared_passages(spark):
    """Chains of near copies, a passage that unlike documents share, rows that repeat a doc_id, buckets cut into chunks."""
    rng = random.Random(8)
    vocab = ["v%d" % i for i in range(3000)]
    passage, base = rng.choices(vocab, k=60), rng.choices(vocab, k=150)
    rows = []
    for i in range(120):
        base = list(base)  # each copy of the copy before it: the ends of the chain are far apart
        base[rng.randrange(150)] = rng.choice(vocab)
        rows.append((i, " ".join(base)))
    for i in range(120, 240):
        rows.append((i, " ".join(rng.choices(vocab, k=rng.choice([3, 8, 15, 90])) + passage + rng.choices(vocab, k=rng.choice([0, 4, 9])))))
    texts = dict(rows)
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string").repartition(5)
    want = brute_components(texts, 5, 80, 100)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, 5, 80, 100).collect()]
    assert sorted(got) == sorted([(i, *want[i]) for i in texts] + [(i, *want[i]) for i in (0, 1)])
    classes = jaccard.Classes(80, 100)
    sized = jaccard.sets_of(df, 5)
    whole, cut = ({(r.a, r.b) for r in jaccard.candidate_edges(df, sized, 5, classes, common.Scratch(spark, "t"), block).collect()} for block in (1024, 4))

    def classes_of(edges):
        found = common.components(spark.createDataFrame(sorted(edges), "a long, b long"), common.Scratch(spark, "t"), "x")
        return {r.node: r.label for r in found.collect()}

    assert classes_of(whole) == classes_of(cut)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150)]
    got = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t"), "x").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}


def brute_base(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_base_spans():
    rng, scanner = random.Random(3), secret_scan.Scanner()
    parts = ["password", "PassWd", "token", "secret", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEF012345", "deadbeef", "0123456789abcdef", "x", "é", "\n", "ſecret"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=12))
        assert [(s, k, e) for s, k, e, _ in scanner.spans(t) if k < 3] == brute_base(t)


def test_markov_models_on_held_out_samples():
    model = secret_scan.default_model()
    rand, plain = secret_scan.samples(700, seed=99)
    assert np.mean([model.ratio(s) > 16 for s in rand]) > 0.98
    assert np.mean([model.ratio(s) > 16 for s in plain]) < 0.002


def test_scrub(docs, spark):
    out = secret_scan.scrub(docs)
    assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
    df = spark.createDataFrame([(1, "key ghp_16C7e42F292c6912E7710c838347Ae178B4a, password=hunter2x end", 60)], "doc_id long, text string, n_chars long")
    r = secret_scan.scrub(df).first()
    assert r.text == "key [SECRET], password=[SECRET] end" and r.n_chars == len(r.text)


@pytest.fixture(scope="module")
def quality(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 6))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        w = rng.choices(vocab, k=rng.randrange(20, 120))
        bad = i % 5 == 0
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w)))
        labels += [(i, int(not bad), 0)] if i % 2 == 0 else []
    rows += [(9000, None), (9001, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("good", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i for i in range(400) if i % 5 == 0}


def test_importance(quality):
    df, labels, bad = quality
    kept = {r.doc_id for r in importance.resample(df, labels).collect()}
    assert not kept & bad and len(kept - {9000, 9001}) >= 0.98 * 320
    again = importance.resample(df, labels, keep_columns=True)
    assert again.columns == df.columns and {r.doc_id for r in again.collect()} == kept
    assert importance.resample(df.limit(0), labels).count() == 0
    assert importance.resample(df, labels.limit(0)).count() == df.count()


def test_kth_largest(spark):
    values = [random.Random(4).randrange(-(2**63), 2**63) for _ in range(500)] + [0, 0, -1]
    df = spark.createDataFrame([(v,) for v in values], "sort_key long")
    for k in (1, 7, 250, 503):
        assert importance.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


def test_lm_score(quality):
    df, labels, bad = quality
    rows = {r.doc_id: r for r in lm_score.cross_entropy_difference(df, labels).collect()}
    assert rows[9000].n_tokens == 0 and rows[9000].score is None and len(rows) == 402
    good = [rows[i].score for i in range(400) if i not in bad]
    assert max(good) < min(rows[i].score for i in bad)
    # all documents by hand
    own, every = collections.Counter(), collections.Counter()
    for counts, table in ((own, df.join(labels.where("quality = 1"), "doc_id")), (every, df)):
        for r in table.collect():
            w = (r.text or "").lower().split()
            counts.update(w)
            counts.update(zip(w, w[1:]))
            counts["all"] += len(w)
    vocab = {k for k, n in every.items() if n > 1 and isinstance(k, str) and k != "all"}
    lone = sum(n for k, n in every.items() if isinstance(k, str) and k not in vocab and k != "all")
    twice = {k for k, n in own.items() if n > 1 and k != "all"}

    def losses(text, listed):
        least = max(2, -(-every["all"] // listed))
        held_words = {k for k in vocab if every[k] >= least or k in twice}
        w = text.lower().split()
        mine = lambda k: own[k] if k in twice else 0
        base = [((every[x] if x in vocab else lone) + 1) / (every["all"] + len(vocab) + 1) for x in w]
        held = [0.9 * mine(x) / own["all"] + 0.1 * p for x, p in zip(w, base)]
        pair = lambda c, a, b: 0.6 * c((a, b)) / c(a) if c(a) and c((a, b)) else 0
        theirs = lambda k: every[k] if every[k] > 1 and (k in held_words if isinstance(k, str) else held_words.issuperset(k)) else 0
        target = [held[0]] + [0.4 * p + pair(mine, a, b) for a, b, p in zip(w, w[1:], held[1:])]
        background = [base[0]] + [0.4 * p + pair(theirs, a, b) for a, b, p in zip(w, w[1:], base[1:])]
        return -np.mean(np.log(target)), -np.mean(np.log(background))

    for listed, often in ((1 << 18, 1 << 10), (20, 1 << 10), (20, 4), (1 << 18, 8)):  # all words listed, and most of them met by the join
        rows = {r.doc_id: r for r in lm_score.cross_entropy_difference(df, labels, listed_words=listed, frequent_words=often).collect()}
        assert len(rows) == 402
        for r in df.collect():
            if r.text and r.text.split():
                found = rows[r.doc_id]
                assert (found.target_loss, found.background_loss) == pytest.approx(losses(r.text, listed), abs=1e-6)
                assert abs(found.score - found.target_loss + found.background_loss) < 1e-12
    none = lm_score.cross_entropy_difference(df, labels.limit(0)).where("n_tokens > 0").collect()
    assert none and all(r.score == 0 for r in none)
    assert lm_score.cross_entropy_difference(df.limit(0), labels).count() == 0


def test_gradients_of_the_block_labeller():
    rng = np.random.default_rng(0)
    m = html_blocks.Labeller(5, hidden=3)
    x, mask, y = html_blocks.padded([rng.normal(size=(4, 5)), rng.normal(size=(2, 5))], [np.array([1, 0, 1, 1]), np.array([0, 1])])

    def loss():
        s = m.scores(x, mask)
        return ((np.log1p(np.exp(s)) - y * s) * mask).sum() / mask.sum()

    for k, g in m.gradients(x, mask, y).items():
        at = tuple(rng.integers(0, d) for d in g.shape)
        m.w[k][at] += 1e-6
        up = loss()
        m.w[k][at] -= 2e-6
        down = loss()
        m.w[k][at] += 1e-6
        assert abs((up - down) / 2e-6 - g[at]) < 1e-6


def test_html(spark):
    model, rng = html_blocks.default_model(), np.random.default_rng(123)
    right = total = 0
    for _ in range(60):
        html, main = html_blocks.sample_page(rng)
        blocks, own = html_blocks.leaves(html), {" ".join(t.split()) for t in main}
        if blocks:
            s = model.scores(*html_blocks.padded([html_blocks.vectors(blocks)])[:2])[0]
            right += sum((v > 0) == (b[2] in own) for b, v in zip(blocks, s))
            total += len(blocks)
    assert right / total > 0.98
    page = '<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><article><h1>Head &amp; more</h1><p>One\n two<br>three.</p><p>Caf&eacute;.</p></article><footer>&copy; x</footer></body></html>'
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p"), (1, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = html_blocks.extract(df).collect()
    assert sorted(r.page_id for r in rows) == [1, 1, 2, 3, 4]
    for r in rows:
        assert r.text == ("Head & more\nOne two three.\nCafé." if r.page_id == 1 else "") and r.n_chars == len(r.text)


def test_pipeline_stages(spark, quality):
    import corpus_pipeline as C

    df, labels, bad = quality
    src = df.where("text is not null and text <> ''").withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "n_chars")
    folder = common.Scratch(spark, "test").path
    labels.write.parquet(f"{folder}/labels.parquet")
    extra = src.where("doc_id in (1, 3)").select((F.col("doc_id") + 5000).alias("doc_id"), "text", "n_chars")
    current, seen = src.unionAll(extra), {}
    for name, stage in C.STAGES:
        current = common.Scratch(spark, name).save(stage(spark, current, folder), "out")
        seen[name] = {r.doc_id for r in current.select("doc_id").collect()}
        if name != "packing":
            assert current.columns == src.columns
    assert not seen["quality"] & bad
    assert seen["near_duplicates"] == {i for i in seen["quality"] if i < 5000}
    assert seen["secrets"] == seen["near_duplicates"] == seen["packing"]
