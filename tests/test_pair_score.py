"""Pairs of boxes: little work for each of the many pairs, in all tasks, and no list that grows with a place."""

from pyspark.sql import functions as F

from gradus.operators import matching
from gradus.plans import registry
from gradus.plans import views as V

SF = "/root/testdata/sf0.01"
BOX = "page long, {} long, box struct<x0:double,y0:double,x1:double,y1:double>"


def test_scores_are_rounded_before_pairs_are_made(spark):
    plan = registry.QUERIES["pair_score"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" in plan and plan.index("round(") > plan.rindex("Generate explode(cands")  # plans read from the last step to the first


def test_pairs_are_made_in_all_tasks(spark):
    pairs = registry.QUERIES["pair_score"](spark, SF)
    assert pairs.select(F.spark_partition_id().alias("task")).distinct().count() == 8


def test_lists_of_references_are_expanded_row_by_row(spark):
    """A join and both lists in one compiled step would hold a whole list's pairs in memory."""
    plan = registry.QUERIES["pair_score"](spark, SF)._jdf.queryExecution()
    steps = [line for line in plan.executedPlan().toString().splitlines() if "Generate" in line][:2]
    assert "explode(cands" in steps[0] and "explode(transform(gts" in steps[1]


def test_many_boxes_of_one_place(spark, monkeypatch):
    monkeypatch.setattr(matching, "LISTED", 3)
    places = [(0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, 0.5), (0.0, 0.0, 0.1, 0.1), (2.0, 2.0, 2.0, 2.0), None]
    truth = [(i % 2, i, places[0] if i < 20 else places[i % 5]) for i in range(30)] + [(0, 4, places[0]), (None, 40, places[0])]
    found = [(i % 2, i, places[1] if i < 120 else places[i % 5]) for i in range(100, 140)] + [(2, 150, places[0])]

    def iou(a, b):
        area = lambda x: max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1])
        both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        union = area(a) + area(b) - both
        return both / union if union > 0 else 0.0

    t, f = spark.createDataFrame(truth, BOX.format("gt_id")), spark.createDataFrame(found, BOX.format("cand_id"))
    assert matching._lists(t, ["page"], "gt_id", 2).agg(F.max(F.size("ids"))).first()[0] == 3
    wanted = sorted((p, g, c, round(iou(a, b), 6)) for p, g, a in truth for q, c, b in found if p is not None and p == q and a and b and iou(a, b) >= 0.1)
    for parts in (1, 3):
        assert sorted(map(tuple, matching.pair_scores(t, f, ["page"], digits=6, parts=parts).collect())) == wanted
    assert len(wanted) > 200


def test_assignment_shares_the_pairs(spark):
    truth, found = V.boxes(spark, SF, small_pages=True)
    got = matching.assign(truth, found, ["page"])
    assert got.count() == truth.count() and got.where("matched").select("cand_id").distinct().count() == got.where("matched").count() > 0
