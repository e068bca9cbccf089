"""Joins by page go by a shuffle of both sides, whatever the files' sizes say: a small file may unpack to many rows."""

from gradus.operators import documents as D
from gradus.plans import detectors


def test_joins_of_pages_send_nothing_whole_through_the_driver(spark, tmp_path):
    spark.range(60).selectExpr("id as p_partkey", "'a b' as p_name", "cast(id % 50 as int) as p_size", "1.0 as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    c = detectors.catalogue(spark, str(tmp_path))
    both = D.overlapping(c["images"], c["blocks"], ["page"])
    plan = both._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert both.count() > 0


def test_kernels_of_parts_run_in_as_many_tasks_as_a_shuffle_has(spark):
    """A file of one split is more work than one task's."""
    from pyspark.sql import functions as F

    from gradus.plans import registry

    for name in ("formula_kernels", "diagram_metrics"):
        df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_recomputation_joins_the_earlier_result_once(spark):
    from gradus.plans import provenance

    plan = provenance.recomputed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_structures_of_pages_broadcast_nothing(spark, tmp_path, monkeypatch):
    """Each stage's plan and the last one's, tables' structures among them."""
    from gradus.operators import structures as S

    spark.range(60).selectExpr("id as p_partkey", "'a b' as p_name", "cast(id % 50 as int) as p_size", "1.0 as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    plans, plan, cut = [], lambda df: df._jdf.queryExecution().sparkPlan().toString(), S.cut
    monkeypatch.setattr(S, "cut", lambda df: plans.append(plan(df)) or cut(df))
    plans.append(plan(detectors.det_chem_enrich(spark, str(tmp_path))))
    assert len(plans) > 5 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def _parts(spark, path):
    spark.range(60).selectExpr("id as p_partkey", "'a b' as p_name", "cast(id % 50 as int) as p_size", "1.0 as p_retailprice").write.parquet(f"{path}/part.parquet")
    return detectors.catalogue(spark, str(path))


def test_cells_are_grouped_without_what_their_table_says(spark, tmp_path, monkeypatch):
    from gradus.operators import structures as S

    plans, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    assert S.in_tables(**_parts(spark, tmp_path), keys=["page"]).count() > 0
    grouped = [line for line in plans[0].splitlines() if "Aggregate [" in line and "row#" in line.split("],")[0]]
    assert grouped and not any("html" in line or "table_box" in line for line in grouped)


def test_blocks_of_pages_without_tables_are_worked_out_once(spark, tmp_path, monkeypatch):
    from gradus.operators import structures as S

    c, given, on_pages = _parts(spark, tmp_path), [], S.on_pages
    monkeypatch.setattr(S, "on_pages", lambda images, blocks, keys: given.append(blocks) or on_pages(images, blocks, keys))
    assert S.enrich(**c, known=c["blocks"].where("page % 7 = 0"), keys=["page"]).count() > 0
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" not in plan and "Join" not in plan


def test_marks_of_structures(spark):
    from pyspark.sql import functions as F

    from gradus.operators import structures as S

    texts = ["Structure: R", "  STRUCTURE:", "structure : R", "the structure: R", "structure\n:", "", None, "x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(S.marked(F.col("t")).alias("m"), F.startswith(S.folded(F.col("t")), F.lit(S.MARK)).alias("w")).collect()
    assert [r.m for r in got] == [r.w for r in got] == [True, True, False, False, False, False, None, False]
