"""Secret scan: the ratio alone decides on runs of any make; the columns equal brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from gradus.llm import secret_scan
from gradus.llm.queries import op7_secrets


def brute_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_runs_of_one_kind_of_character_and_short_ones_are_found():
    rng, scanner = np.random.default_rng(7), secret_scan.Scanner()
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
        for size, least in ((14, 0.85), (20, 0.95), (40, 0.99)):
            strings = ["".join(rng.choice(list(letters), size)) for _ in range(300)]
            assert np.mean([any(k == 3 for _, k, _, _ in scanner.spans(f"see {s} here")) for s in strings]) >= least
    for s in ("qwzxkvjhgtyplmnbcdfrtqwx", "xkcdqzvjwpyghbtfmnrlsdwq"):
        assert scanner.spans(s) == [(0, 3, len(s), 0)]
    for s in ("responsibilities", "Geschwindigkeitsbegrenzung", "internationalisation", "caracteristicamente", "anticonstitutionnellement", "order_items_total_2024", "4884838406913489", "20240131123000", "------------", "================"):
        assert scanner.spans(s) == []


def test_a_secret_at_the_end_of_a_very_long_text():
    text = "ordinary words in a row " * 40_000
    key = "qwzxkvjhgtyplmnbcdfrtqwx"
    assert [(s, k, e) for s, k, e, _ in secret_scan.Scanner().spans(text + key)] == [(len(text), 3, len(text) + len(key))]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(5)
    parts = ["password", "token", "=", ":", " ", '"', "AKIA", "ABCDEF012345", "deadbeef", "0123456789abcdef", "word", "é", "𝄞", "\n"]
    rows = [(i, "".join(rng.choices(parts, k=14))) for i in range(200)]
    rows += [(None, "token=abcdef1"), (3, rows[3][1]), (3, rows[3][1]), (900, None), (901, ""), (902, "x" * 300_000 + " passwd: hunter22")]
    d = str(tmp_path_factory.mktemp("secrets"))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, spans string, n_hex int")
    df.write.parquet(f"{d}/documents.parquet")
    return d, rows, df


def test_scan_equals_brute_force(spark, table):
    d, rows, df = table
    out = op7_secrets(spark, d)
    assert out.dtypes == [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")]
    kinds = ("assign", "access", "hex")
    want = []
    for i, t in rows:
        base = brute_base(t or "")
        digest = hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        want.append((i, *(sum(k == j for _, k, _ in base) for j in range(3)), digest))
    got = out.collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)) for r in got)
    for r in got:  # base spans stay, in order, among all spans
        base = [x for x in r.spans.split(",") if x and not x.startswith("markov")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
    assert secret_scan.scan(df.limit(0)).count() == 0
    assert secret_scan.scrub(df.limit(0)).count() == 0


def test_ordinary_long_words_are_left_alone():
    scanner = secret_scan.Scanner()
    for s in ("Ciezasrrjaos", "raezezosjaezque", "Llanfairpwllgwyngyll", "Donaudampfschifffahrtsgesellschaft", "w3schools-tutorial-page", "diechzuachpf", "osjaasrriemi"):
        assert scanner.spans(s) == [], s
