"""Registered queries of regions, layout, runs and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions import boxes as B
from gradus.functions import detect
from gradus.functions import text as T
from gradus.operators import regions as R
from gradus.operators import runs, stats
from gradus.plans import views as V
from gradus.plans.registry import query, rounded


def _blocks(spark, sf_dir):
    """Regions (odd parts) and blocks (even parts) of pages of twenty parts; every fifth block has no box."""
    truth, found = V.boxes(spark, sf_dir)
    p = V.table(spark, sf_dir, "part")
    kind = F.when(F.col("page") % 3 == 0, "image").otherwise("text").alias("object_type")
    truth = truth.join(p.select(F.col("p_partkey").alias("gt_id"), F.col("p_name").alias("text")), "gt_id").select(F.floor(F.col("gt_id") / 20).alias("page"), "gt_id", "box", "text").select("page", kind, "gt_id", "box", "text")
    found = found.join(p.select(F.col("p_partkey").alias("cand_id"), F.col("p_name").alias("text"), "p_size"), "cand_id").select(F.floor(F.col("cand_id") / 20).alias("page"), "cand_id", F.when(F.col("cand_id") % 10 > 0, F.col("box")).alias("box"), "text", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("position"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("order_index"))
    return truth, found.select("page", kind, "cand_id", "box", "text", "position", "order_index")


@query()
def match_document(spark, sf_dir):
    """Every region with its block or blocks, or none."""
    return rounded(R.match_document(*_blocks(spark, sf_dir), ["page", "object_type"])).orderBy("page", "object_type", "gt_id")


@query("""SELECT page, object_type, gt_id, cand_id, round(iou, 6) AS score FROM (SELECT g.id // 20 AS page, CASE WHEN (g.id // 20) % 3 = 0 THEN 'image' ELSE 'text' END AS object_type, g.id AS gt_id, c.id AS cand_id,
    greatest(0, least(g.x1, c.x1) - greatest(g.x0, c.x0)) * greatest(0, least(g.y1, c.y1) - greatest(g.y0, c.y0)) AS i, i / ((g.x1 - g.x0) * (g.y1 - g.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) - i) AS iou
    FROM b g JOIN b c ON g.id // 20 = c.id // 20 AND g.id % 2 = 1 AND c.id % 2 = 0 AND c.id % 10 > 0) WHERE iou >= 0.1""", V.BOXES)
def join_gt_candidates(spark, sf_dir):
    """Pairs of one page and type whose boxes overlap enough."""
    truth, found = _blocks(spark, sf_dir)
    return rounded(R.scored_pairs(truth, found.where("box is not null"), ["page", "object_type"]).select("page", "object_type", "gt_id", "cand_id", "score"))


@query("SELECT user_id, event_id, round((lag(value) OVER w + value) / 2, 9) AS low, round((lead(value) OVER w + value) / 2, 9) AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)")
def win_interval_bounds(spark, sf_dir):
    """The middles between each event's value and its neighbours' of one user."""
    e = V.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return rounded(R.interval_bounds(e, ["user_id"], "value", ("event_id",)).select("user_id", "event_id", "low", "high"), 9)


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 8)::BIGINT AS until FROM lineitem")
def win_row_spans(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(8).alias("rows"))
    return rounded(R.row_spans(li, ["l_orderkey"], "l_linenumber", "rows").select("l_orderkey", "l_linenumber", "until"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM (SELECT *, count(*) OVER g AS n, bool_or(l_returnflag = 'R') OVER g AS any_r FROM (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS grp FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_quantity > 15 ORDER BY l_orderkey, l_linenumber, l_returnflag)) WINDOW g AS (PARTITION BY l_orderkey, grp)) WHERE n >= 2 AND any_r")
def win_numbered_groups(spark, sf_dir):
    """Lines of large quantity that follow each other in an order, one of them returned."""
    li = V.table(spark, sf_dir, "lineitem").where("l_quantity > 15").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_returnflag") == "R").alias("numbered"))
    return rounded(R.numbered_groups(li, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber"))


def _fragments(spark, sf_dir):
    truth, found = V.boxes(spark, sf_dir)
    both = truth.withColumnRenamed("gt_id", "element_id").unionByName(found.withColumnRenamed("cand_id", "element_id"))
    return both.withColumn("page", F.floor(F.col("element_id") / 40))


@query()
def win_line_rows(spark, sf_dir):
    return R.line_rows(_fragments(spark, sf_dir), ["page"]).select("page", "element_id", "line")


@query()
def win_layout_rows(spark, sf_dir):
    return R.layout_rows(_fragments(spark, sf_dir), ["page"]).select("page", "element_id", "line")


@query("SELECT page, min(x0) AS x0, min(y0) AS y0, round(max(x1), 6) AS x1, round(max(y1), 6) AS y1, count(*) AS n FROM (SELECT id // 40 AS page, x0, y0, x1, y1 FROM b) GROUP BY page", V.BOXES)
def bbox_union(spark, sf_dir):
    return rounded(_fragments(spark, sf_dir).groupBy("page").agg(B.union("box").alias("u"), F.count("*").alias("n")).select("page", "u.*", "n"))


def _pairs(spark, sf_dir):
    """Operational measures of pairs, some missing or not finite."""
    li = V.table(spark, sf_dir, "lineitem")
    some = lambda c, k: F.when(F.col("l_orderkey") % k > 0, F.col(c)).cast("double")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tool"), (F.col("l_orderkey") % 5).alias("document"), F.col("l_quantity").alias("pages"), F.when(F.col("l_linenumber") % 2 == 0, "cloud").otherwise("local").alias("kind"),
        some("l_tax", 2).alias("processing_seconds"), some("l_discount", 3).alias("latency_seconds"), some("l_quantity", 5).alias("wall_seconds"), F.col("l_extendedprice").cast("double").alias("invocation_seconds"),
        some("l_quantity", 4).alias("tree_rss_mb"), some("l_tax", 7).alias("rss_mb"), some("l_discount", 4).alias("gpu_process_mb"), some("l_quantity", 3).alias("gpu_device_mb"), some("l_tax", 3).alias("framework_allocated_mb"), F.lit(None).cast("double").alias("framework_reserved_mb"),
        some("l_tax", 6).alias("actual_cost"), some("l_discount", 2).alias("estimated_cost"),
    )


_LI = """p AS (SELECT l_orderkey * 10 + l_linenumber AS tool, l_orderkey % 5 AS document, l_quantity AS pages, CASE WHEN l_linenumber % 2 = 0 THEN 'cloud' ELSE 'local' END AS kind, CASE WHEN l_orderkey % 2 > 0 THEN l_tax END AS processing, CASE WHEN l_orderkey % 3 > 0 THEN l_discount END AS latency,
    CASE WHEN l_orderkey % 5 > 0 THEN l_quantity END AS wall, l_extendedprice AS invocation, CASE WHEN l_orderkey % 4 > 0 THEN l_quantity END AS tree, CASE WHEN l_orderkey % 7 > 0 THEN l_tax END AS rss, CASE WHEN l_orderkey % 4 > 0 THEN l_discount END AS gp, CASE WHEN l_orderkey % 3 > 0 THEN l_quantity END AS gd,
    CASE WHEN l_orderkey % 3 > 0 THEN l_tax END AS fa, CASE WHEN l_orderkey % 6 > 0 THEN l_tax END AS actual, CASE WHEN l_orderkey % 2 > 0 THEN l_discount END AS estimated FROM lineitem)"""


@query("""SELECT tool, document, pages, round(seconds, 6) AS seconds, ram, vram, cost, cost_basis, round(CASE WHEN pages > 0 THEN seconds / pages END, 6) AS sec_per_page FROM (SELECT *, CASE WHEN kind = 'cloud' THEN CASE WHEN processing > 0 THEN processing WHEN latency > 0 THEN latency ELSE wall END WHEN wall > 0 THEN wall ELSE invocation END AS seconds,
    coalesce(tree, rss) AS ram, CASE WHEN gp > 0 THEN gp WHEN fa > 0 AND gd > 0 THEN gd ELSE 0.0 END AS vram, CASE WHEN kind = 'local' THEN 0.0 ELSE coalesce(actual, estimated) END AS cost,
    CASE WHEN kind = 'local' THEN 'not_applicable_local' WHEN actual IS NOT NULL THEN 'actual' WHEN estimated IS NOT NULL THEN 'estimated' ELSE 'unavailable' END AS cost_basis FROM p)""", _LI)
def resource_pair_row(spark, sf_dir):
    return rounded(runs.resource_row(_pairs(spark, sf_dir)))


@query("SELECT tool, round(avg(score), 6) AS overall FROM (SELECT tool, category, avg(score) AS score FROM (SELECT tool, category, document, avg(score) AS score FROM o GROUP BY ALL) GROUP BY ALL) GROUP BY tool", V.OBJECTS)
def ref_macro(spark, sf_dir):
    """The macro score once more, from weights of single objects."""
    return rounded(stats.macro_of(V.objects(spark, sf_dir)))


@query()
def paired_bootstrap(spark, sf_dir):
    """Differences of each tool's documents from tool 0's, by category."""
    cell = V.objects(spark, sf_dir).groupBy("tool", "category", "document").agg(F.avg("score").alias("score"))
    other = cell.where("tool = 0").select("category", "document", F.col("score").alias("base"))
    return rounded(stats.paired_bootstrap(cell.where("tool > 0").join(other, ["category", "document"]), ["tool", "category"], "document", "score", "base"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def content_counts(spark, sf_dir):
    return runs.content_counts(V.table(spark, sf_dir, "documents"), ["lang"], "source")


@query()
def run_integrity(spark, sf_dir):
    """Rules over the objects of events: expected ones are all events of a document that tool 0 has."""
    o = V.objects(spark, sf_dir)
    results = o.select("tool", "document", "object_id", "category", (F.col("score") - F.when(F.col("object_id") % 50 == 0, 200).otherwise(0)).alias("score"))
    made = o.groupBy("tool", "document").agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("missing"), F.avg("page").alias("pages"), F.sum("score").alias("seconds"))
    made = made.withColumn("status", F.when(F.col("tool") == 3, "failed").otherwise("success")).withColumn("missing", F.when(F.col("tool") == 4, F.col("missing") + 1).otherwise(F.col("missing")))
    return rounded(runs.run_integrity(made, results, o.where("tool = 0").select("document", "object_id", "category")))


@query("""SELECT doc_id, CASE WHEN src AND cfg AND raw THEN 'y' ELSE 'n' END AS raw_ok, CASE WHEN src AND cfg AND raw AND std THEN 'y' ELSE 'n' END AS std_ok, CASE WHEN src AND cfg AND raw AND std AND nrm AND ev THEN 'reuse_all' WHEN src AND cfg AND raw AND std AND nrm THEN 'evaluate_only' WHEN src AND cfg AND raw AND std THEN 'normalize_only' WHEN src AND cfg AND raw THEN 'standardize_only' WHEN lang = 'fr' THEN 'refuse' ELSE 'run_adapter' END AS action
    FROM (SELECT doc_id, lang, doc_id % 7 > 0 AS src, doc_id % 11 > 0 AS cfg, doc_id % 5 > 0 AS raw, doc_id % 4 > 0 AS std, doc_id % 3 > 0 AS nrm, doc_id % 2 > 0 AS ev FROM documents)""")
def cache_compat(spark, sf_dir):
    """What of each document's cache holds, and the least work that is left."""
    d = V.table(spark, sf_dir, "documents")
    same = lambda k: F.when(F.col("doc_id") % k > 0, "new").otherwise("old")
    names = ("source_sha256", "config_sha256", *runs.STAGES)
    cached = d.select(F.col("doc_id").alias("tool"), F.col("lang").alias("document"), *[same(k).alias(n) for n, k in zip(names, (7, 11, 5, 4, 3, 2))])
    out = runs.plan_from_cache(runs.cache_compat(cached, dict.fromkeys(names, "new")), F.col("document") == "fr")
    yes = lambda c: F.when(F.col(c), "y").otherwise("n")
    return out.select(F.col("tool").alias("doc_id"), yes("raw_acquisition_ok").alias("raw_ok"), yes("standardization_ok").alias("std_ok"), "action")


@query()
def det_chem_linear(spark, sf_dir):
    """Formulas in a sentence about each part."""
    p = V.table(spark, sf_dir, "part")
    text = F.concat(F.lit("Take Fe"), F.col("p_size") % 4, F.lit("(SO4)"), F.col("p_size") % 3 + 1, F.lit(" of U"), F.col("p_size"), F.lit("BC, H2O and "), F.col("p_brand"))
    return p.select("p_partkey", F.explode(detect.formula_spans(text)).alias("f")).select("p_partkey", "f.*")


@query()
def det_math_delimited(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    text = F.concat(F.lit("So $x_"), F.col("p_size"), F.lit("$ is small.\n$y = "), F.col("p_partkey"), F.lit("$ (1)\nthen \\[ z \\] and $$\\frac12 \\tag{2}$$"))
    return p.select("p_partkey", F.explode(detect.math_spans(text)).alias("f")).select("p_partkey", "f.*")


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]{2,}')) AS n, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]{2,}'))) AS n_distinct FROM documents")
def match_tokens(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    every = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w{2,})"), F.lit(1))
    return d.select("doc_id", F.size(every).cast("long").alias("n"), F.size(T.match_tokens(F.col("text"))).cast("long").alias("n_distinct"))


@query("SELECT doc_id, md5(lower(regexp_replace(text, '\\s+', '', 'g'))) AS digest FROM documents")
def label_key(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.label_key(F.col("text"))).alias("digest"))


@query()
def segment_text(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.segment_text(F.col("text"), 500))).select("doc_id", "pos", F.md5("col").alias("digest"), F.length("col").alias("n_chars"))
