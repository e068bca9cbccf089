"""Personal data: base spans against the plain patterns, the tagger's parts against enumeration, held-out spans, odd tables."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from tests.llm.test_llm import ODD

from gradus.llm import pii, queries
from gradus.llm.tagger import Tagger


def plainly(text):
    """(start, kind, end) by the contract's patterns as they are written."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


PRIVATE = ["a.b@c.d", "x@y", "a@b.c@d.e", "@a.b", "a@@b.c", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+12345678", "+1 ((", "++1 23456789 0-", "é@b.com", "a@b.com.", "1..2.3.4"]


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    pool = list("ab1234567890..@@+-- ()_%é\n")
    texts = PRIVATE + ["".join(rng.choices(pool, k=rng.randrange(0, 60))) for _ in range(4000)] + [" ".join(rng.choices(PRIVATE, k=6)) for _ in range(300)]
    texts += ["".join(rng.choices("0123456789 -", k=30)) for _ in range(2000)]
    for t in texts:
        assert pii.base_spans(t) == plainly(t), t


def test_base_spans_of_long_runs():
    for unit in ("a", "1", "1.", "1 ", "@", "a@", "+1", "+1(", ".", "1@1."):
        assert isinstance(pii.base_spans(unit * (300_000 // len(unit))), list)


def small(seed):
    m = Tagger(2, 3, seed)
    rng = np.random.default_rng(seed)
    m.w = {k: rng.normal(0, 0.7, w.shape).astype(np.float32) for k, w in m.w.items()}
    return m, rng


def paths(m, e):
    """Every path of one window with its score."""
    for tags in itertools.product(range(m.k), repeat=len(e)):
        yield tags, sum(e[i, t] for i, t in enumerate(tags)) + sum(m.steps[a, b] for a, b in zip(tags, tags[1:]))


def test_decoding_and_its_bound_equal_enumeration():
    sure = 0
    for seed in range(12):
        m, rng = small(seed)
        e = m.emissions(rng.integers(0, 90, (5, 6)).astype(np.uint8))
        e[:, :3, 0] += 1.5
        tags, out = m.viterbi(e), m.best_is_out(e)
        for j in range(6):
            best = max(paths(m, e[:, j]), key=lambda p: p[1])
            got = sum(e[i, j, t] for i, t in enumerate(tags[:, j])) + sum(m.steps[a, b] for a, b in zip(tags[:, j], tags[1:, j]))
            assert abs(got - best[1]) < 1e-3
            if out[j]:
                sure += 1
                assert set(best[0]) == {0}
    assert sure > 3


def test_gradients_equal_differences():
    m, rng = small(5)
    m.w = {k: w.astype(np.float64) for k, w in m.w.items()}
    codes, tags = rng.integers(0, 8, (5, 3)).astype(np.uint8), np.array([[0, 1, 0], [1, 2, 1], [2, 2, 3], [2, 0, 3], [0, 1, 0]])
    _, grad = m.gradients(codes, tags)
    for name, w in m.w.items():
        for _ in range(6):
            at = tuple(int(rng.integers(0, s)) for s in w.shape)
            if name == "a" and m.forbidden[at] < 0:
                continue
            old, ends = w[at], []
            for d in (1e-2, -1e-2):
                w[at] = old + d
                ends.append(m.gradients(codes, tags)[0])
            w[at] = old
            assert abs((ends[0] - ends[1]) / 2e-2 - grad[name][at]) < 2e-3, (name, at)


def test_reconciled_equals_the_best_set():
    rng = np.random.default_rng(8)
    for _ in range(200):
        spans = [(int(a), int(a + rng.integers(1, 8)), k, float(g)) for k, (a, g) in enumerate(zip(rng.integers(0, 25, 8), rng.integers(1, 20, 8)))]
        got = pii.reconciled(spans)
        apart = lambda some: all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(some, 2))
        best = max(sum(s[3] for s in some) for r in range(9) for some in itertools.combinations(spans, r) if apart(some))
        assert apart(got) and sum(s[3] for s in got) == best
    assert pii.reconciled([(0, 10, 4, 3.0), (6, 20, 4, 2.0), (6, 20, 4, 2.0)]) == [(0, 20, 4, 3.0)]


def test_held_out_spans():
    made, scanner = pii.samples(400, 77), pii.Scanner()
    found = missed = invented = 0
    for (text, spans), got in zip(made, scanner.tagged([t for t, _ in made])):
        want = {s for s in spans if s[0] >= 0 and s[1] <= len(text)}
        cut = [s for s in spans if s not in want]
        have = {s[:3] for s in got}
        found, missed = found + len(want & have), missed + len(want - have)
        invented += sum(not any(a < y and x < b for x, y, _ in cut) for a, b, _ in have - want)
    assert found > 0.93 * (found + missed) and invented < 0.1 * found, (found, missed, invented)


@pytest.mark.parametrize("thing, kind", [("(415) 555-0132", "phone"), ("DE89 3704 0044 0532 0130 00", "iban"), ("GB82WEST12345698765432", "iban"), ("219-09-9999", "ssn")])
def test_spans_anywhere_in_a_long_text(thing, kind):
    scanner, filler = pii.Scanner(), "sel thing anor the "
    hits = 0
    for pad in range(0, 2 * pii.STEP, 7):
        text = (filler * 30)[: 200 + pad] + " " + thing + " " + filler * 20
        got = scanner.spans([text])[0]
        hits += (201 + pad, pii.KINDS.index(kind), 201 + pad + len(thing), False) in got
        assert all(text[a:b] == thing for a, _, b, _ in got)
    assert hits >= 25, hits  # of 28 places in the windows


def test_look_alikes_are_left_alone():
    texts = ["on 2024-01-15 10:30:22", "ISBN 978-3-16-148410-0", "1.234.567.890 items", "from 1990-2000", 'token = "11acdfb36bb72224148e6160f674b4be45601bff"', "v1.2.3-45", "$12,345,678.90", "call 12", "DE89 3704 0044 0532 0130 01", "000-12-3456", "3.14159265358979", "12 34 56 78 90"]
    assert pii.Scanner().spans(texts) == [[] for _ in texts]


def test_registered_query(spark, tmp_path):
    texts = [*ODD, " ".join(PRIVATE), "x " * 40_000 + "a.b@c.de (415) 555-0132", "call (415) 555-0132 now", "call (415) 555-0132 now", "1" * 3000]
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)] + [(None, "a@b.cd", "x", 5), (3, "a", "y", 5), (3, "a", "y", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_pii(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint")] + [(f"n_{k}", "bigint") for k in pii.KINDS[:4]] + [("base_sha256", "string"), ("spans", "string")]
    got, want = collections.Counter(), collections.Counter()
    for r in out.collect():
        got[tuple(r)[:6]] += 1
    for i, t, *_ in rows:
        base = plainly(t or "")
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want[i, *(sum(s[1] == k for s in base) for k in range(4)), hashlib.sha256(line.encode()).hexdigest()] += 1
    assert got == want
    spans = {r.doc_id: r.spans for r in out.collect()}
    assert spans[len(ODD) + 2] == "phone:5:19" and spans[len(ODD) + 1].startswith("email:80000:80008") and spans[0] == ""
    for i, t, *_ in rows:
        if i is not None and i != 3:
            assert {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plainly(t or "")} <= set(spans[i].split(",")) | {""}
    assert pii.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
