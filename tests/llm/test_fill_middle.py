"""Fill-in-the-middle against a plain version by regular expressions; the automaton's scan on texts of every shape."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from tests.llm.test_llm import ODD

from gradus.llm import fill_middle, queries

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, rate=50):
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = random.Random(4)
    odd = [*ODD, "<P>", "a<S>b", "<<M>", "<P", "P>", "< P>", "<Pé>", "<" * 70 + "S>", "x" * 63 + "<M>", "x" * 62 + "<M>", "é" * 40 + " <S> ", "\x0b\x0c\r\n", "\x1c \x1f", " lead", "trail ", "last words 漢字 " * 9000, "é" * 100_000]
    pool = ["a", "b ", " ", "\n", "\t", "é", "漢", "\U0001f642", "<", "P", "S", ">", "<Q>", "\x85", " ", " "]
    return odd + ["".join(rng.choices(pool, k=rng.randrange(0, 300))) for _ in range(600)]


def test_equals_a_plain_version():
    some = texts()
    made = fill_middle.transformed(list(range(len(some))), [(t or "").encode() for t in some], rate=90)
    forms = collections.Counter()
    for i, (t, got) in enumerate(zip(some, made)):
        want = plainly(i, t, 90)
        assert got == (*want[:4], want[4].encode()), (i, t[:50] if t else t)
        assert fill_middle.restore(got[4], got[1]).decode() == (t or "")
        forms[got[1]] += 1
    assert set(forms) == {"plain", "spm", "psm"}


def test_counts_and_all_ends():
    some = [t or "" for t in texts() if len(t or "") < 2000]
    scan = fill_middle.Scan([t.encode() for t in some])
    for i, t in enumerate(some):
        units = UNITS.findall(t)
        assert (scan.n[i], scan.n_chars[i], scan.sentinels[i]) == (len(units), len(t), len(re.findall("<[PSM]>", t)))
        size, chars = scan.ends(np.full(len(units) + 1, i), np.arange(len(units) + 1))
        lengths = np.cumsum([0, *map(len, units)])
        assert chars.tolist() == lengths.tolist() and size.tolist() == [len(t[:k].encode()) for k in lengths]


def test_no_texts():
    assert fill_middle.transformed([], []) == [] and fill_middle.Scan([b"", b""]).n.tolist() == [0, 0]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("fim")
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "no id here", "x", 2), (3, "a", "y", 3), (3, "a", "y", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, form string, n int").write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_registered_query(spark, folder):
    out = queries.op12_fill_middle(spark, folder)
    assert out.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = collections.Counter((r.doc_id, *(w := plainly(r.doc_id, r.text))[:4], sha(w[4]), sha(r.text or "")) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    assert collections.Counter(map(tuple, out.collect())) == want


def test_outputs_and_no_rows(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (7, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in fill_middle.transform(docs, rate=100).collect()}
    assert got[5].output == plainly(5, "a b c d", 100)[4] and got[7].form == "plain" and got[7].output == ""
    assert fill_middle.transform(docs.limit(0)).count() == 0
