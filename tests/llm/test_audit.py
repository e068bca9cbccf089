"""Filter interaction audit against a simulation of every order over the rows, and on odd and empty tables."""

import collections
import itertools
import re

import pytest
from tests.llm.test_llm import ODD

from gradus.llm import audit, queries

CAPS = "Many Words With CAPITALS here " * 30
PROSE = " ".join(f"word{i}" for i in range(60))
ROWS = [(i, t, "a") for i, t in enumerate(ODD)] + [
    (100, PROSE, "a"), (90, PROSE, "b"), (101, PROSE, "b"), (101, PROSE, "b"), (90, PROSE, None), (102, CAPS, ""), (103, CAPS + "#", None), (104, "a | b", "c"),
    (105, "same " * 80, "c"), (106, "same " * 80, "a"), (None, "same " * 80, "a"), (None, None, "d"), (107, "x" * 70_000 + " A", "c"), (108, PROSE + " {}", "c"), (109, PROSE + " $", "c"),
]
LABELS = [(90, 1, 0), (100, 1, 1), (101, 0, 1), (101, 1, 0), (102, None, None), (103, 1, None), (None, 1, 1), (999, 1, 1), (0, 1, 0)]


def simulated(rows, labels):
    good, toxic = collections.defaultdict(int), collections.defaultdict(int)
    for i, q, t in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= t == 1
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = collections.defaultdict(list)
    for i, t, source in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        docs[source or ""].append(({f for f, v in fails.items() if v}, i is not None and good[i], i is not None and toxic[i]))
    out = {}
    for part, own in docs.items():
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                total[f] += len(gone)
                all_fail = sum(f in d[0] for d in own)
                out[part, "".join(order), k + 1] = [len(left), len(gone), all_fail - len(gone), sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = total[row[-1]]
    return {k: tuple(map(int, v)) for k, v in out.items()}


def test_registered_query_equals_a_simulation(spark, tmp_path):
    spark.createDataFrame([(*r, "clash", 7) for r in ROWS], "doc_id long, text string, source string, part string, quality int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.op13_audit(spark, str(tmp_path))
    assert out.dtypes == [("part", "string"), ("filter_order", "string"), ("step", "int")] + [(n, "bigint") for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in out.collect()}
    want = simulated(ROWS, LABELS)
    assert len(got) == 600 * len({r[2] or "" for r in ROWS}) and got == want


@pytest.mark.parametrize("docs, labels", [([], []), ([], LABELS), (ROWS[:5], [])])
def test_empty_tables(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in audit.report(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == simulated(docs, labels)


def test_shares_add_up(spark):
    d, l = spark.createDataFrame(ROWS, "doc_id long, text string, source string"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = audit.report(d, l).collect()
    for part in {r.part for r in rows}:
        own = [r for r in rows if r.part == part]
        n = sum((r[2] or "") == part for r in ROWS)
        assert sum({r.filter_order[r.step - 1]: r.shapley for r in own}.values()) == 120 * (n - next(r.kept for r in own if r.step == 5))
