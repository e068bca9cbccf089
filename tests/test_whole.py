"""Registered queries do the whole job: small tables against brute force, and SQL written from the definitions."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions import metrics as M
from gradus.operators import matching, stats
from gradus.plans import registry
from gradus.plans import views

SF = "/root/testdata/sf0.001"


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Neighbouring texts that are alike in their first 120 characters and differ after; some are not ASCII."""
    start = "the same words at the start of each text of this table " * 3
    text = [start + "one two two three", start + "one two four", "", "Größe übt " * 30 + "日本 𝄞 énd", "Größe übt " * 29 + "日本 𝄢 end", start.upper() + "a b"]
    d = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'web' as source").write.parquet(f"{d}/documents.parquet")
    return str(d), text


def test_distances_side_by_side(spark):
    """Many pairs at once, of several blocks, equal the distances of single pairs; where lengths alone are too far apart none is worked out."""
    rng = random.Random(8)
    text = lambda n, k: "".join(rng.choice("abcdé∑ж漢"[:k]) for _ in range(n))
    pairs = [(text(rng.choice((0, 1, 63, 64, 65, 128, 300, 700)), rng.randrange(1, 9)), text(rng.randrange(300), rng.randrange(1, 9))) for _ in range(150)]
    pairs += [(a, "".join(c for c in a if rng.random() < 0.97)) for a, _ in pairs] + [(None, "a"), ("a" * 9000, "ab")]
    lanes, M.LANES = M.LANES, 40  # so pairs take the places of those that ended
    try:
        codes = [tuple(map(M._points, p)) for p in pairs]
        want = [None if a is None else M.edit_distance(a, b) for a, b in pairs]
        assert M.edit_distances(codes) == want
    finally:
        M.LANES = lanes
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    rows = df.select("i", M.distance("a", "b").alias("d"), M.farther(F.col("a"), F.col("b"), 0.05 * F.length("a")).alias("far")).collect()
    assert {r.i: r.d for r in rows} == dict(enumerate(want))
    assert all(r.far == (None if want[r.i] is None else want[r.i] > 0.05 * len(pairs[r.i][0])) for r in rows)


def test_pairs_of_texts_are_dealt(spark, tmp_path):
    spark.createDataFrame([(i, "x", f"t{i}") for i in range(40)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert views.text_pairs(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(600):
        k = rng.choice([1, 2, 5, 400])
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(90))] for _ in range(2))
        assert M.edit_distance(a, b) == brute(a, b)
    a = [rng.randrange(900) for _ in range(1500)]
    b = [x if rng.random() < 0.8 else -1 for x in a if rng.random() < 0.9]
    assert M.edit_distance(a, b) == brute(a, b)


def test_text_pairs_are_whole(spark, texts):
    d, text = texts
    got = {name: {r.doc_id: r for r in registry.QUERIES[name](spark, d).collect()} for name in ("levenshtein", "multiset_prf", "set_prf", "text_metrics", "error_tags", "gt_canon")}
    for i, (a, b) in enumerate(zip(text, text[1:])):
        n = brute(a, b)
        cer = n / len(a) if a else float(bool(b))
        assert got["levenshtein"][i].distance == n
        assert got["levenshtein"][i].cer == pytest.approx(cer, abs=1e-6)
        assert got["levenshtein"][i].edit_similarity == pytest.approx(1 - n / max(len(a), len(b)), abs=1e-6)
        x, y = a.split(), b.split()
        assert got["multiset_prf"][i].tp == (Counter(x) & Counter(y)).total()
        if x and y:
            both = len(set(x) & set(y))
            assert got["set_prf"][i].precision == pytest.approx(both / len(set(y)), abs=1e-6)
            assert got["set_prf"][i].recall == pytest.approx(both / len(set(x)), abs=1e-6)
        tags = [t for t, on in (("short", len(b) < 0.72 * len(a)), ("long", len(b) > 1.35 * len(a)), ("characters", n > 0.05 * len(a))) if on]
        assert got["error_tags"][i].tags == ",".join(tags)
    x, y = text[0].split(), text[1].split()
    assert got["text_metrics"][0].wer == pytest.approx(1 - brute(x, y) / len(x), abs=1e-6)
    assert all(len(got[k]) == len(text) - 1 for k in got if k != "gt_canon")
    assert {i: r.reference for i, r in got["gt_canon"].items()} == {i: t or "web" for i, t in enumerate(text)}


def joined_with(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_whole_tables_are_joined(spark, tmp_path):
    orders = [(k, k % 5) for k in range(1, 21)]
    lines = [(k, n, float(k + n)) for k in range(4) for n in range(1, 8)]
    d = joined_with(spark, tmp_path, orders=(orders, "o_orderkey long, o_custkey long"), customer=([(c,) for c in range(1, 8)], "c_custkey long"), lineitem=(lines, "l_orderkey long, l_linenumber int, l_quantity double"))
    got = {tuple(r) for r in registry.QUERIES["gt_manifest_check"](spark, d).collect()}
    want = {(o, c, c if c else -1, "both" if c else "missing") for o, c in orders} | {(None, None, c, "extra") for c in (5, 6, 7)}
    assert got == want
    cells = {r.o_orderkey: r for r in registry.QUERIES["join_cells"](spark, d).collect()}
    assert len(cells) == 4
    for r in cells.values():  # lines of even number are alike
        assert (r.n_reference, r.n_predicted, r.n_both) == (7, 7, 7) and abs(r.content - 3 / 7) < 1e-6


NEARBY = """WITH b AS (SELECT (p_partkey // 20) % 50 AS page, p_partkey AS id, (p_partkey % 7) / 10.0::DOUBLE AS x0, (p_partkey % 5) / 10.0::DOUBLE AS y0,
    (p_partkey % 7) / 10.0::DOUBLE + (0.1::DOUBLE + (p_size % 10) / 40.0::DOUBLE) AS x1, (p_partkey % 5) / 10.0::DOUBLE + (0.1::DOUBLE + (p_size % 7) / 40.0::DOUBLE) AS y1 FROM part),
p AS (SELECT g.page, g.id AS gt_id, c.id AS cand_id, greatest(0, least(g.x1, c.x1) - greatest(g.x0, c.x0)) * greatest(0, least(g.y1, c.y1) - greatest(g.y0, c.y0)) / greatest(1e-12, (g.x1 - g.x0) * (g.y1 - g.y0)) AS o,
    (c.x0 + c.x1) / 2 BETWEEN g.x0 AND g.x1 AND (c.y0 + c.y1) / 2 BETWEEN g.y0 AND g.y1 AS inside FROM b g JOIN b c ON g.page = c.page AND g.id % 2 = 1 AND c.id % 2 = 0)
SELECT page, gt_id, cand_id, round(o, 6), rank FROM (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY round(o, 9) DESC, cand_id) AS rank FROM p WHERE o >= 0.002 OR inside) WHERE rank <= 8"""


def test_nearby_outputs_by_share_of_the_reference(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    got = {(r.page, r.gt_id, r.cand_id, r.rank): r.score for r in registry.QUERIES["nearby_outputs"](spark, SF).collect()}
    want = {(a, b, c, n): o for a, b, c, o, n in con.execute(NEARBY).fetchall()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_nearest_keeps_covering_and_centred_boxes(spark):
    box = "page long, {} long, box struct<x0: double, y0: double, x1: double, y1: double>"
    truth = spark.createDataFrame([(1, 1, (0.5, 0.5, 0.51, 0.51)), (1, 2, (10.0, 10.0, 20.0, 20.0))], box.format("gt_id"))
    found = spark.createDataFrame([(1, 3, (0.0, 0.0, 9.0, 9.0)), (1, 4, (15.0, 15.0, 15.1, 15.1)), (1, 5, (19.99, 19.99, 30.0, 30.0))], box.format("cand_id"))
    got = {(r.gt_id, r.cand_id): (r.score, r.rank) for r in matching.nearest(truth, found, ["page"]).collect()}
    assert got.keys() == {(1, 3), (2, 4)} and got[1, 3] == (1.0, 1) and got[2, 4][0] == pytest.approx(1e-4)


def test_bootstrap_makes_ten_thousand_draws(spark):
    values = {"a": [3.0, 1.0, 4.0, 1.5, 9.0], "b": [2.0, 6.0, 5.0], "c": [7.0]}
    df = spark.createDataFrame([(k, i, v) for k, own in values.items() for i, v in enumerate(own)], "category string, key long, score double")
    for r in stats.hash_bootstrap(df, ["category"], "key", "score").collect():
        own = values[r.category]
        n = len(own)
        means = [sum(own[int(hashlib.md5(f"{d}:{i}".encode()).hexdigest()[:8], 16) % n] for i in range(n)) / n for d in range(10_000)]
        assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_bootstrap_query_makes_ten_thousand_draws(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    cells = con.execute(f"WITH {views.OBJECTS} SELECT category, tool * 10 + document AS key, avg(score) FROM o GROUP BY ALL ORDER BY ALL").fetchall()
    rows = {r.category: r for r in registry.QUERIES["bootstrap_mean_ci"](spark, SF).collect()}
    assert rows.keys() == {c for c, _, _ in cells}
    category = min(rows)
    own = np.array([v for c, _, v in cells if c == category])
    at = np.array([[int(hashlib.md5(f"{d}:{i}".encode()).hexdigest()[:8], 16) % len(own) for i in range(len(own))] for d in range(10_000)])
    assert (rows[category].ci_low, rows[category].ci_high) == pytest.approx(tuple(np.quantile(own[at].mean(axis=1), [0.025, 0.975])), abs=2e-6)


def test_pairs_of_forms_are_those_of_texts(spark, tmp_path):
    """Each text's form is made once; doubled, missing and lone ids and missing texts pair as in the join."""
    from pyspark.sql import functions as F

    from gradus.functions import metrics as M
    from gradus.functions import text as T
    from gradus.plans import views as V

    rows = [(1, "a  b"), (2, None), (2, "c\x85d e"), (3, ""), (5, "x"), (None, "y"), (6, "x y z")]
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    got = V.form_pairs(spark, str(tmp_path), T.norm_text)
    want = V.text_pairs(spark, str(tmp_path)).select("doc_id", T.norm_text(F.col("reference")).alias("r"), T.norm_text(F.col("predicted")).alias("p"))
    assert order(got) == order(want) and len(order(got)) == 5
    words = T.word_tokens(F.col("r")), T.word_tokens(F.col("p"))
    assert order(got.select(M.text_distances("r", "p").alias("x")).select("x.*")) == order(got.select(M.distance("r", "p"), M.token_distance(*words), *map(F.size, words)))
