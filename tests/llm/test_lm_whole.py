"""LM scoring: the background counts every pair that the corpus repeats, whatever the target holds."""

import collections
import math
import random

from gradus.llm import lm_score


def test_background_holds_pairs_of_the_whole_corpus(spark):
    rng = random.Random(3)
    word = lambda: "w%d" % min(rng.randrange(40), rng.randrange(40))
    texts = {i: " ".join(word() for _ in range(rng.randrange(3, 30))) for i in range(120)}
    for i in range(40, 120):  # a passage that no labelled document holds
        texts[i] += " all rights of this licence are reserved"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")

    words, pairs, total = collections.Counter(), collections.Counter(), 0
    for t in texts.values():
        w = t.split()
        words.update(w)
        pairs.update(zip(w, w[1:]))
        total += len(w)
    size = sum(n > 1 for n in words.values()) + 1
    lone = sum(n == 1 for n in words.values())
    c = lambda x: words[x] if words[x] > 1 else lone

    own = collections.Counter(w for i in range(40) for w in texts[i].split())

    def loss(text, listed):
        least = max(2, -(-total // listed))
        held = {k for k, n in words.items() if n >= least or own[k] > 1}
        w = text.split()
        out = [(c(w[0]) + 1) / (total + size)]
        out += [0.4 * (c(b) + 1) / (total + size) + (0.6 * pairs[a, b] / c(a) if pairs[a, b] > 1 and a in held and b in held else 0) for a, b in zip(w, w[1:])]
        return -sum(map(math.log, out)) / len(w)

    for listed, often in ((1 << 18, 1 << 10), (20, 8), (1, 1)):  # all pairs listed, some, and all but the target's met by the join
        rows = lm_score.cross_entropy_difference(df, labels, listed_words=listed, frequent_words=often).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert abs(r.background_loss - loss(texts[r.doc_id], listed)) < 1e-6


def test_ranks_stay_as_the_corpus_grows(spark):
    """The target's model rests on the words of all rows: ten times the rows, many with new words, hardly move the scores."""
    rng = random.Random(4)
    word = lambda k: f"{k}%d" % min(rng.randrange(300), rng.randrange(300))
    text = lambda k, n=40: " ".join(word(k) for _ in range(n))
    rows = [(i, text("good") if i % 2 else text("spam") if i % 4 else text("good", 20) + " " + text("spam", 20)) for i in range(240)]
    more = rows + [(1000 + i, (text("good") if i % 2 else text("spam")) + f" new{i} new{i} other{i % 700} rare{i}") for i in range(2400)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 160, 2)], "doc_id long, quality int, toxic int")
    small, large = ({r.doc_id: r.score for r in lm_score.cross_entropy_difference(spark.createDataFrame(t, "doc_id long, text string"), labels).collect()} for t in (rows, more))
    ids = [i for i, _ in rows if i % 2 == 0 or i >= 160]  # not the target's own
    rank = lambda scores: {i: k for k, i in enumerate(sorted(ids, key=scores.get))}
    a, b = rank(small), rank(large)
    n = len(ids)
    assert 1 - 6 * sum((a[i] - b[i]) ** 2 for i in ids) / (n * (n * n - 1)) > 0.9


def test_nulls_long_texts_and_clashing_columns(spark):
    rows = [(1, "a b a b"), (1, "a b a b"), (None, "a b c"), (2, None), (3, ""), (4, " \t"), (5, "a b " * 60_000)]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, score int, key string")
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = lm_score.cross_entropy_difference(df, labels).collect()
    assert sorted((repr(r.doc_id), r.n_tokens) for r in out) == sorted((repr(i), len((t or "").split())) for i, t in rows)
    for r in out:
        assert (r.score is None) == (r.n_tokens == 0) and (r.score is None or math.isfinite(r.score))
    assert len({(r.target_loss, r.background_loss) for r in out if r.doc_id == 1}) == 1


def test_target_counts_every_good_row(spark):
    """More good rows than the 4000 that the target was once fitted on; words under the target's floor have no pairs, but count alone."""
    rng = random.Random(5)
    texts = {i: " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(6)) + f" new{i // 3} rare{i % 400} rare{i % 400}" for i in range(6000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    mine = [i for i in texts if i % 4]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in texts], "doc_id long, quality int, toxic int")
    words, pairs, own, own_pairs = (collections.Counter() for _ in range(4))
    for i, t in texts.items():
        w = t.split()
        words.update(w)
        pairs.update(zip(w, w[1:]))
        if i % 4:
            own.update(w)
            own_pairs.update(zip(w, w[1:]))
    assert len(mine) > 4000
    total, tokens, size = sum(words.values()), sum(own.values()), sum(n > 1 for n in words.values()) + 1
    for most in (1 << 18, 1000):
        least = max(2, -(-tokens // most))
        floor = max(2, -(-total // 100))
        listed = {k for k, n in words.items() if n >= floor or own[k] >= least}
        rows = lm_score.cross_entropy_difference(df, labels, listed_words=100, frequent_words=20, own_words=most).collect()
        assert len(rows) == len(texts)
        for r in rows:
            w = texts[r.doc_id].split()
            p = [0.9 * (own[x] if own[x] > 1 else 0) / tokens + 0.1 * (words[x] + 1) / (total + size) for x in w]
            p[1:] = [0.4 * q + (0.6 * own_pairs[a, b] / own[a] if own_pairs[a, b] > 1 and {a, b} <= listed else 0) for a, b, q in zip(w, w[1:], p[1:])]
            assert abs(r.target_loss + sum(map(math.log, p)) / len(w)) < 1e-6
