"""Recomputation, differences, other forms and digests against plain versions."""

import hashlib

from pyspark.sql import functions as F

from gradus.operators import provenance as P


def stages(log, scale=2, floor=5):
    def scaled(df):
        return df.withColumn("scaled", F.col("v") * scale)

    def scored(df):
        return df.withColumn("score", F.when(F.col("scaled") >= floor, F.col("scaled")).otherwise(0))

    return [P.Stage("normalize", str(scale), ("scaled",), scaled), P.Stage("evaluate", str(floor), ("score",), scored)]


def test_only_what_changed_is_computed_again(spark):
    before = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 9)], "k long, v int")
    now = spark.createDataFrame([(1, 1), (2, 7), (3, None), (5, 3)], "k long, v int")
    first = P.recompute(before, None, ["k"], stages([])).cache()
    assert {r.redone for r in first.collect()} == {2}
    for scale, floor, redone in ((2, 5, {1: 0, 2: 2, 3: 0, 5: 2}), (2, 1, {1: 1, 2: 2, 3: 1, 5: 2}), (3, 5, {1: 2, 2: 2, 3: 2, 5: 2})):
        s = stages([], scale, floor)
        again, whole = P.recompute(now, first, ["k"], s), P.recompute(now, None, ["k"], s)
        rows = lambda df: sorted(tuple(r.asDict()[c] for c in ("k", "v", "scaled", "score", "fp_normalize", "fp_evaluate")) for r in df.collect())
        assert rows(again) == rows(whole) and {r.k: r.redone for r in again.collect()} == redone
        work = {r.stage: (r.reused, r.computed) for r in P.work(again, s).collect()}
        n = list(redone.values())
        assert work == {"normalize": (sum(x < 2 for x in n), sum(x == 2 for x in n)), "evaluate": (sum(x < 1 for x in n), sum(x >= 1 for x in n))}


def test_differences_of_odd_tables(spark):
    old = [(1, "a", 1.0), (1, "b", 2.0), (None, "n", None), (2, None, 3.0), (3, "same", float(0)), (4, "x", None), (5, "gone", 1.0), (7, "r", 1.0), (7, "r", 1.0)]
    new = [(1, "a", 1.0), (1, "c", 2.0), (None, "n", None), (2, "t", 3.0 + 1e-9), (3, "same", 1e-9), (4, "x", 2.0), (6, "added", 1.0), (7, "r", 1.0)]
    a, b = (spark.createDataFrame(rows, "k long, t string, v double") for rows in (old, new))
    for bucket in (F.col("k"), F.floor(F.col("k") / 3), F.lit(0)):
        got = sorted((r.k, r.state, tuple(r.columns), r.delta_v) for r in P.control_diff(a, b, ["k"], bucket, {"v": 1e-6}).collect())
        assert [(k, s, c) for k, s, c, _ in got] == [(1, "changed", ("t",)), (2, "changed", ("t",)), (4, "changed", ("v",)), (5, "gone", ()), (6, "added", ()), (7, "gone", ())]
        assert [d is None for *_, d in got] == [False, False, True, True, True, True]
    assert P.control_diff(a, a, ["k"], F.col("k")).count() == 0
    assert {r.state for r in P.control_diff(a, b.limit(0), ["k"], F.col("k")).collect()} == {"gone"}


def test_equal_ranges_are_not_shuffled(spark):
    a = spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")).cache()
    b = a.withColumn("v", F.when(F.col("k") == 4321, 100).otherwise(F.col("v")))
    out = P.control_diff(a, b, ["k"], F.floor(F.col("k") / 100))
    rows = out.collect()
    assert [(r.k, r.state) for r in rows] == [(4321, "changed")]
    plan = out._jdf.queryExecution().executedPlan()
    seen, nodes = [], [plan]
    while nodes:  # rows that each exchange of the plan as run has written
        p = nodes.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            nodes.append(p.plan())
        if name == "Exchange":
            seen.append(p.metrics().apply("shuffleRecordsWritten").value())
        children = p.children()
        nodes += [children.apply(i) for i in range(children.size())]
    assert len(seen) >= 2 and max(seen) <= 1000, seen  # ranges and the rows of one of them, not 10,000 rows


def test_other_forms_are_scored_once(spark):
    df = spark.createDataFrame([(1, "Ab c"), (2, "abc"), (3, None), (4, "")], "k long, t string")
    forms = {"base": F.col("t"), "lower": F.lower("t"), "bare": F.replace(F.lower("t"), F.lit(" "), F.lit(""))}
    out = P.counterfactual(df, ["k"], forms, lambda c: F.length(c), "base")
    rows = {(r.k, r.scenario): (r.score, r.delta) for r in out.collect()}
    assert rows[1, "bare"] == (3, -1) and rows[2, "lower"] == (3, 0) and rows[3, "bare"] == (None, None) and len(rows) == 12
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_digests_of_tables_and_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "")], "k long, t string")
    digest = lambda d: P.table_digest(d).first().digest
    assert digest(df) == digest(df.repartition(5, "t")) and len({digest(df), digest(df.distinct()), digest(df.fillna("")), digest(df.limit(0))}) == 4
    files = {"a.py": b"x", "b/c.py": b"0", "b/d.py": "é\0".encode(), "b/cc.py": b"1"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    got = {r.folder: (r.files, r.sha256) for r in P.folder_hash(rows, f"{tmp_path}").collect()}
    for folder in ("", "b"):
        own = sorted(n for n in files if n.rpartition("/")[0] == folder)
        assert got[folder] == (len(own), hashlib.sha256(b"".join(n.encode() + b"\0" + files[n] + b"\0" for n in own)).hexdigest())
    before = P.tree_digest(rows, f"{tmp_path}").first()
    assert before == P.tree_digest(rows.repartition(3), f"{tmp_path}/").first() and before.files == 4
    (tmp_path / "a.py").write_bytes(b"y")
    assert P.tree_digest(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)), f"{tmp_path}").first().digest != before.digest
