"""Registered query of the integrity of runs: lines of orders as objects that seven tools scored, with faults among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.operators import runs
from gradus.operators.stages import cut
from gradus.plans import views as V
from gradus.plans.registry import query, rounded

_CATEGORIES = ("text", "table", "math", "chemistry", "image", "diagram")
_SQL = """
r AS (SELECT l_linenumber::BIGINT AS tool, l_orderkey % 5 AS document, l_orderkey AS object_id, l_discount * 1000 + CASE WHEN l_tax > 0.07 THEN 60 ELSE 0 END AS score, l_quantity * 2.5 AS m, l_quantity >= 10 AS hit FROM lineitem),
w AS (SELECT document, count(*) AS wanted FROM (SELECT o_orderkey % 5 AS document FROM orders) GROUP BY document),
p AS (SELECT tool, document, count(*) AS n, count(*) FILTER (hit) AS matched, count(*) FILTER (NOT hit) + CASE WHEN tool = 2 THEN 1 ELSE 0 END AS missing, max(wanted) AS wanted FROM r JOIN w USING (document) WHERE tool < 7 AND NOT (tool = 5 AND document = 4) GROUP BY tool, document),
k AS (SELECT * FROM p WHERE NOT (tool = 3 AND document = 1)),
e AS (SELECT * FROM k WHERE NOT (tool = 6 AND document = 0)),
s AS (SELECT r.* FROM r SEMI JOIN e ON e.tool = r.tool AND e.document = r.document),
a AS (SELECT tool, document, avg(score) AS score FROM r WHERE tool < 7 GROUP BY tool, document),
i AS (
 SELECT 'error' AS severity, 'missing_run_manifest' AS code, 8 AS tool, NULL::BIGINT AS document, NULL AS metric, NULL::DOUBLE AS value
 UNION ALL SELECT 'error', 'invalid_run_manifest', 7, NULL, NULL, NULL
 UNION ALL SELECT 'error', 'wrong_tool_in_run', 4, NULL, NULL, NULL
 UNION ALL SELECT 'error', 'incomplete_document_selection', 2, NULL, NULL, NULL
 UNION ALL SELECT 'error', 'missing_pair_result', 5, 4, NULL, NULL
 UNION ALL SELECT 'error', 'failed_run', 3, 1, NULL, NULL
 UNION ALL SELECT 'error', 'object_count_mismatch', tool, document, NULL, n FROM k WHERE n <> wanted
 UNION ALL SELECT 'error', 'match_accounting_mismatch', tool, document, NULL, matched + missing FROM k WHERE matched + missing <> wanted
 UNION ALL SELECT 'error', 'missing_pair_artifact', 6, 3, 'matches', NULL
 UNION ALL SELECT 'error', 'standardized_identity_mismatch', 2, 4, NULL, NULL
 UNION ALL SELECT 'error', 'empty_standardized_document', 1, 0, NULL, NULL
 UNION ALL SELECT 'error', 'invalid_standardized_json', 4, 2, NULL, NULL
 UNION ALL SELECT 'error', 'object_id_set_mismatch', tool, document, NULL, NULL FROM e WHERE n <> wanted
 UNION ALL SELECT 'error', 'impossible_object_score', tool, document, NULL, score FROM s WHERE NOT score BETWEEN 0 AND 100
 UNION ALL SELECT 'error', 'impossible_metric_value', tool, document, 'm', m FROM s WHERE NOT m BETWEEN 0 AND 100
 UNION ALL SELECT 'error', 'invalid_object_evaluation', 6, 0, NULL, NULL
 UNION ALL SELECT 'warning', 'missing_version_snapshot', tool, document, NULL, NULL FROM k WHERE tool = 4
 UNION ALL SELECT 'error', 'raw_output_missing', 5, 2, NULL, NULL
 UNION ALL SELECT 'error', 'missing_category_score', t, NULL, 'diagram_score', NULL FROM range(1, 6) x(t)
 UNION ALL SELECT 'error', 'impossible_category_score', tool, NULL, ['text', 'table', 'math', 'chemistry', 'image'][document + 1] || '_score', score * 3 FROM a WHERE tool = 3 AND score * 3 > 100
 UNION ALL SELECT 'error', 'missing_overall_score', 1, NULL, NULL, NULL
 UNION ALL SELECT 'error', 'impossible_overall_score', 5, NULL, NULL, -1
 UNION ALL SELECT 'error', 'invalid_evaluation_report', 6, NULL, NULL, NULL
 UNION ALL SELECT 'error', 'tool_total_object_count_mismatch', tool, NULL, NULL, count(*) FROM s GROUP BY tool HAVING count(*) <> (SELECT count(*) FROM orders))"""


def _runs(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    t, d = F.col("tool"), F.col("document")
    r = li.select(F.col("l_linenumber").cast("long").alias("tool"), (F.col("l_orderkey") % 5).alias("document"), F.col("l_orderkey").alias("object_id"), (F.col("l_discount") * 1000 + F.when(F.col("l_tax") > 0.07, 60).otherwise(0)).cast("double").alias("score"), F.create_map(F.lit("m"), (F.col("l_quantity") * 2.5).cast("double")).alias("metrics"), (F.col("l_quantity") >= 10).alias("hit"))
    at = lambda tool, document: (t == tool) & (d == document)
    counts = cut(r.groupBy("tool", "document").agg(F.count("*").alias("object_count"), F.count_if("hit").alias("matched"), F.count_if(~F.col("hit")).alias("missing"), F.avg("score").alias("mean")))
    pairs = counts.where(~at(5, 4)).select(
        "tool", "document", F.when(at(3, 1), "failed").otherwise("success").alias("status"), "object_count", "matched", (F.col("missing") + F.when(t == 2, 1).otherwise(0)).alias("missing"),
        F.filter(F.lit(list(runs.ARTIFACTS)), lambda a: ~(at(6, 3) & (a == "matches"))).alias("artifacts"), F.when(t != 4, "1.0").alias("version"), F.when(at(5, 2), 0).otherwise(3).alias("raw_files"),
        (~at(4, 2)).alias("std_readable"), F.when(at(2, 4), 0).otherwise(d).alias("std_document"), t.alias("std_tool"), F.when(at(1, 0), 0).otherwise(2).alias("std_pages"), (~at(6, 0)).alias("evaluation_readable"),
    )
    tools = counts.select("tool").distinct()
    manifests = tools.select("tool", (t != 7).alias("readable"), F.lit(True).alias("pairs_readable"), F.when(t == 4, F.array(t, t + 1)).otherwise(F.array(t)).alias("selected_tools"), F.when(t == 2, F.lit([3, 2, 1, 0])).otherwise(F.lit([4, 3, 2, 1, 0])).cast("array<long>").alias("selected_documents"))
    name = F.concat(F.element_at(F.lit(list(_CATEGORIES)), d.cast("int") + 1), F.lit("_score"))
    reports = counts.where("tool < 6").select("tool", name.alias("score_name"), (F.col("mean") * F.when(t == 3, 3).otherwise(1)).alias("score"))
    overall = counts.where("tool between 2 and 5").groupBy("tool").agg(F.when(t == 5, -1.0).otherwise(50.0).alias("score")).select("tool", F.lit("overall_quality_score").alias("score_name"), "score")
    documents = counts.select("document").distinct()
    expected = V.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).alias("document"), F.col("o_orderkey").alias("object_id"))
    every = tools.unionByName(tools.agg((F.max("tool") + 1).alias("tool")))
    return every, documents, manifests, pairs, r.drop("hit"), reports.unionByName(overall), expected


@query("SELECT severity, code, tool, document, metric, round(value, 6) AS value FROM i", _SQL.strip())
def validate_runs(spark, sf_dir):
    """Every broken rule of the runs."""
    return rounded(runs.validate_runs(*_runs(spark, sf_dir), _CATEGORIES))


@query("SELECT t.tool, CASE WHEN coalesce(errors, 0) = 0 THEN 'clean' ELSE 'corrupt' END AS status, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM (SELECT range AS tool FROM range(1, 9)) t LEFT JOIN (SELECT tool, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM i GROUP BY tool) n ON n.tool = t.tool", _SQL.strip())
def run_status(spark, sf_dir):
    """How the runs of each tool stand."""
    parts = _runs(spark, sf_dir)
    return rounded(runs.run_status(parts[0], runs.validate_runs(*parts, _CATEGORIES)))
