"""Kernels by hand-computed values, and sources, sinks and streams."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions import metrics as M
from gradus.functions import text as T
from gradus.operators import matching
from gradus.plans import views
from gradus.sources import files, tables
from gradus.streaming import jobs


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_metrics(spark):
    words = lambda s: F.split(F.lit(s), " ")
    r = one(
        spark,
        lev=F.levenshtein(F.lit("kitten"), F.lit("sitting")),
        tok=M.token_distance(words("a b c d"), words("a c d e")),
        rate=M.error_rate(F.levenshtein(F.lit("a"), F.lit("aaaa")), F.lit(1), F.lit(4)),
        prf=M.prf(F.lit(2), F.lit(3), F.lit(4)),
        none=M.prf(F.lit(0), F.lit(0), F.lit(0)),
        multi=M.multiset_overlap(words("a a b"), words("a a a c")),
        mean=M.weighted_mean([(0.5, F.lit(1.0)), (0.5, F.lit(None).cast("double")), (0.25, F.lit(0.0))]),
    )
    assert (r.lev, r.tok, r.rate, r.multi) == (3, 2, 3.0, 2)
    assert tuple(r.prf) == pytest.approx((2 / 3, 1 / 2, 4 / 7)) and tuple(r.none) == (1.0, 1.0, 1.0)
    assert r.mean == pytest.approx(2 / 3)


def test_text(spark):
    assert T.composition_of("FeSO4·(NH4)2SO4·6H2O") == {"Fe": 1, "S": 2, "O": 14, "N": 2, "H": 20}
    assert T.composition_of("Fe(") is None
    for s in (r"$\dfrac12 x_i$", r"\left( \alpha y \right) + \text{a b}", "αx^2"):
        assert T.latex_form(T.latex_form(s)) == T.latex_form(s)
    assert T.latex_form(r"\dfrac12") == T.latex_form(r"\frac{1}{2}")
    r = one(spark, chem=T.norm_chem(F.lit("Fe₃O₄ ⋅ SO₄²⁻")), text=T.norm_text(F.lit("a “b”  c\r\nd\n\n e​")), n=T.parse_numeric(F.lit("0,34")), bad=T.parse_numeric(F.lit("1.2,3")), empty=T.word_tokens(F.lit("  ")))
    assert r.chem == "Fe3O4·SO4^2-" and r.text == 'a "b" c d\n\ne' and float(r.n) == 0.34 and r.bad is None and r.empty == []


def test_assignment_is_best():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, m = map(int, rng.integers(1, 5, 2))
        w = np.where(rng.random((n, m)) < 0.3, -1, rng.random((n, m)).round(1))
        got = matching.assignment(w)
        used = [j for j in got if j >= 0]
        assert len(used) == len(set(used)) and all(w[i, j] >= 0 for i, j in enumerate(got) if j >= 0)
        best = max(sum(w[i, j] for i, j in enumerate(p) if j < m and w[i, j] >= 0) for p in itertools.permutations(range(m + n), n))
        assert sum(w[i, j] for i, j in enumerate(got) if j >= 0) == pytest.approx(best)


def test_tables():
    cells = tables.html_cells('<table><tr><th rowspan="2">a</th><td colspan=x>b</td></tr><tr><td>c</td></tr></table><table><tr><td>no</td></tr></table>')
    assert [(r, c, rs, cs, h, t) for r, c, rs, cs, h, t in cells] == [(0, 0, 2, 1, True, "a"), (0, 1, 1, 1, False, "b"), (1, 1, 1, 1, False, "c")]
    assert [c[5] for c in tables.markdown_cells("x\n|a|b|\n|:---|---:|\n|1\\|2|3|4|\n\nend")] == ["a", "b", "1|2", "3", "4"]
    assert tables.html_cells("<p>") is None and tables.markdown_cells("a|b") is None


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2], {"api_key": "x", "path": "/a/b.pdf"})], "object_id string, bbox array<int>, m map<string,string>")
    files.write_report({"t": df}, str(tmp_path))
    assert files.read_table(spark, f"{tmp_path}/t.csv").first().bbox == "[1,2]"
    assert df.select(files.public("m").alias("m")).first().m == {"path": "b.pdf"}
    (tmp_path / "gt.jsonl").write_text('{"object_id": "a", "page": 1}\n{"object_id": "a", "page": 2}\n')
    with pytest.raises(Exception, match="object_id twice"):
        files.read_ground_truth(spark, str(tmp_path / "gt.jsonl")).collect()


def test_stream_equals_batch(spark, tmp_path):
    e = views.table(spark, "/root/testdata/sf0.001", "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, f, mode in (("states", jobs.latest_state, "complete"), ("means", lambda d: jobs.windowed_means(d, late="60 days"), "complete")):
        q = f(stream if name == "means" else stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = spark.table(name)
        want = f(e)
        key = lambda d: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()), key=repr)
        assert key(got) == key(want)


def test_cells_of_nested_tables_and_marked_up_cells():
    cell = lambda html: [(r, c, t) for r, c, *_, t in tables.html_cells(html)]
    assert cell("<table><tr><td>a<br>b</td><td>a<b>b</b>c<!-- x -->d</td></tr></table>") == [(0, 0, "a b"), (0, 1, "a b c d")]
    assert cell("<table><tr><td>a<table><tr><td>in</td></tr></table></td><td>b</td></tr><tr><td>c</td></tr></table>") == [(0, 0, "a in"), (0, 1, "b"), (1, 0, "in"), (2, 0, "c")]
    assert cell("<p><table><tbody><tr><td rowspan=' 2 ' colspan=-3>a</td><td>b<script>x</script></tr><tr><td>&lt;c</table><table><tr><td>no") == [(0, 0, "a"), (0, 1, "b"), (1, 1, "<c")]
    assert cell("<table><td>no row</td><tr><p><td>not direct</td></p></tr></table>") == []


def test_line_ends_in_texts(spark):
    rows = [("elec­\ntric so­ft", "electric soft"), ("well- \t\nknown x-\n1", "well-known x- 1"), ("a \n b\n\n\n c", "a b\n\nc"), ("  a \n b ", "a b"), ("физико-\nхимический é-\nü", "физико-химический é- ü"), ("", ""), (None, None)]
    df = spark.createDataFrame([(a, b) for a, b in rows], "t string, want string")
    for r in df.select("t", "want", T.norm_text(F.col("t")).alias("n"), T.norm_text(F.col("t"), paragraphs=False).alias("one")).collect():
        assert r.n == r.want, r
        assert r.t is None or r.one == " ".join(r.want.split()) == T.text_form(r.t)
