"""Registered queries of standardized documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions import boxes as B
from gradus.functions import text as T
from gradus.operators import documents as D
from gradus.plans import views as V
from gradus.plans.registry import query, rounded


@query("""SELECT user_id AS document, md5(string_agg(text, chr(10) || chr(10) ORDER BY page) || chr(10)) AS digest FROM (
    SELECT user_id, page, '--- Page ' || page || ' ---' || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY place NULLS LAST, oi NULLS LAST, id) AS text FROM e GROUP BY user_id, page) GROUP BY user_id""",
    """e AS (SELECT user_id, event_id % 3 AS page, event_id::VARCHAR AS id, CASE WHEN event_id % 4 > 0 THEN event_id % 10 END AS oi, event_type || ' ' || event_id AS t,
    CASE WHEN value > 100 THEN row_number() OVER (PARTITION BY user_id, event_id % 3, value > 100 ORDER BY value, event_id) END AS place FROM events)""")
def sink_text(spark, sf_dir):
    """A user's events as a document of three pages: those of high value in reading order, then the others."""
    e = V.table(spark, sf_dir, "events").withColumn("page", F.col("event_id") % 3)
    elements = e.select(F.col("user_id").alias("document"), "page", F.lit("text").alias("kind"), F.col("event_id").cast("string").alias("element_id"), F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 10).alias("order_index"), F.create_map(F.lit("raw_text"), F.concat_ws(" ", "event_type", "event_id")).alias("payload"))
    listed = F.array_sort(F.collect_list(F.when(F.col("value") > 100, F.struct("value", "event_id"))))
    pages = e.groupBy(F.col("user_id").alias("document"), "page").agg(F.transform(listed, lambda s: s["event_id"].cast("string")).alias("reading_order"))
    return D.render(elements, pages).select("document", F.md5("text").alias("digest"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'math_formula' WHEN 2 THEN 'chemical_formula' ELSE 'chemical_structure' END AS object_type,
    CASE p_partkey % 4 WHEN 3 THEN NULL WHEN 1 THEN p_brand ELSE CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END END AS own FROM part WHERE p_partkey % 4 < 3 OR p_size % 5 > 0""")
def page_candidates(spark, sf_dir):
    """Parts as texts, formulas, chemical formulas, structures and chemical objects of another subtype, which go."""
    p, k = V.table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    payload = F.create_map(
        F.lit("subtype"), F.when(k == 2, "linear_formula").when(F.col("p_size") % 5 > 0, "structure").otherwise("other"),
        *[c for n in ("text", "formula") for c in (F.lit(f"normalized_{n}"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.lit(f"raw_{n}"), F.col("p_brand"))],
    )
    e = p.select("p_partkey", F.when(k == 0, "text").when(k == 1, "formula").otherwise("chemical").alias("kind"), payload.alias("payload"))
    return D.candidates(e).select("p_partkey", "object_type", F.coalesce(*[F.col("payload")[n] for n in ("text", "latex", "formula")]).alias("own"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN regexp_replace(p_name || ' ' || p_brand, '\\s+', ' ', 'g') ELSE '' END AS text FROM part")
def gt_text(spark, sf_dir):
    """Texts of parts as texts, as cells of a table, and as images without text."""
    p, k = V.table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    cells = F.to_json(F.array(F.struct(F.col("p_name").alias("text")), F.struct(F.col("p_brand").alias("text"))))
    payload = F.create_map(F.lit("text"), F.concat_ws("  ", "p_name", "p_brand"), F.lit("cells"), cells)
    return p.select("p_partkey", D.comparable(F.when(k == 0, "text").when(k == 1, "table").otherwise("image"), payload).alias("text"))


@query("SELECT page, gt_id, cand_id, round(inter, 6) AS area FROM (SELECT *, row_number() OVER (PARTITION BY page, gt_id ORDER BY inter DESC, cand_id) AS r FROM i WHERE inter > 0) WHERE r = 1", V.BOXES)
def join_best_image(spark, sf_dir):
    """For each reference box, the candidate that shares most with it."""
    best = D.best_image(*V.boxes(spark, sf_dir), ["page"], "gt_id", "cand_id")
    return rounded(best.select("page", "gt_id", F.col("other_cand_id").alias("cand_id"), "area"))


@query("SELECT page, gt_id, string_agg(brand, '|' ORDER BY first) AS labels FROM (SELECT page, gt_id, p_brand AS brand, min(cand_id) AS first FROM i JOIN part ON p_partkey = cand_id WHERE inter > 0 AND p_size % 3 = 0 GROUP BY ALL) GROUP BY ALL", V.BOXES)
def join_label_in_box(spark, sf_dir):
    """For each reference box, the brands of the candidates of some sizes that it meets."""
    truth, found = V.boxes(spark, sf_dir)
    found = found.join(V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand_id"), "p_brand", "p_size"), "cand_id")
    out = D.labels_in_box(truth, found, ["page"], "gt_id", "cand_id", "p_brand", F.col("p_size") % 3 == 0)
    return out.select("page", "gt_id", F.array_join("labels", "|").alias("labels"))


@query("SELECT tool, document, object_id, round(score, 6) AS score, matched FROM o", V.OBJECTS)
def join_match_eval(spark, sf_dir):
    """Scores, matches and official results of all objects."""
    o, keys = V.objects(spark, sf_dir), ["tool", "document", "object_id"]
    return rounded(D.match_evaluation(o.select(*keys, "score"), o.select(*keys, "matched"), o.select(*keys, "score", "matched"), keys).select(*keys, "score", "matched"))


@query("""SELECT gt_id, round(CASE WHEN touched OR exact THEN x0 WHEN flat THEN greatest(0, x0 + w * s / 40) END, 6) AS x0, round(CASE WHEN touched OR exact THEN x0 + w WHEN flat THEN least(1, x0 + w * (s + 6) / 40) END, 6) AS x1
    FROM (SELECT p_partkey AS gt_id, p_partkey % 30 AS s, (p_partkey % 7) / 10.0::DOUBLE AS x0, 0.1::DOUBLE + (p_size % 10) / 40.0::DOUBLE AS w, p_partkey % 3 = 0 AND p_partkey % 30 < 10 AS touched, p_partkey % 4 = 1 AS exact, p_size % 2 = 0 AS flat FROM part WHERE p_partkey % 2 = 1)""")
def det_span_bbox(spark, sf_dir):
    """Boxes of six characters of a source: some have members, some are exact, some are low lines."""
    truth, _ = V.boxes(spark, sf_dir)
    t = truth.join(V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gt_id"), "p_size"), "gt_id").withColumn("s", F.col("gt_id") % 30)
    b = F.col("box")
    own = B.box(b["x0"], b["y0"], b["x1"], b["y0"] + F.when(F.col("p_size") % 2 == 0, 0.03).otherwise(0.2))
    member = F.struct(F.lit(0).alias("start"), F.lit(10).alias("end"), own.alias("box"))
    members = F.filter(F.array(member), lambda m: F.col("gt_id") % 3 == 0)
    span = D.span_box(F.col("s"), F.col("s") + 6, members, own, F.col("gt_id") % 4 == 1, F.lit(40))
    return rounded(t.select("gt_id", span.alias("b")).select("gt_id", "b.x0", "b.x1"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS text FROM events")
def flatten_text(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", T.flatten_text(F.col("props")).alias("text"))


@query("""SELECT s_suppkey, ready AND (NOT cloud OR (allowed AND known)) AS available,
    CASE WHEN cloud AND NOT allowed THEN 'Cloud conversion is disabled by server configuration' WHEN cloud AND NOT known THEN 'Server-side provider credentials are not configured' WHEN NOT ready THEN 'Runtime environment ' || s_name || ' is not installed' END AS reason
    FROM (SELECT s_suppkey, s_name, s_suppkey % 2 = 0 AS ready, s_suppkey % 3 = 0 AS cloud, s_suppkey % 5 > 0 AS allowed, s_suppkey % 7 > 0 AS known FROM supplier)""")
def availability(spark, sf_dir):
    k = F.col("s_suppkey")
    can, why = D.available(F.col("s_name"), k % 2 == 0, k % 3 == 0, k % 5 > 0, k % 7 > 0)
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", can.alias("available"), why.alias("reason"))


@query("""SELECT event_id, printf('Object Score=%.2f/100; потеря относительно идеального объекта=%.2f п.п.; ', v, 100 - v) || CASE event_id % 2 WHEN 0 THEN printf('cer=%.2f', v) ELSE printf('iou=%.2f, caption=%.2f', v, v + 1) END AS text
    FROM (SELECT event_id, (event_id % 100)::DOUBLE AS v FROM events)""")
def metric_impact(spark, sf_dir):
    v = (F.col("event_id") % 100).cast("double")
    metrics = F.create_map(F.lit("cer"), v, F.lit("iou"), v, F.lit("caption"), v + 1)
    return V.table(spark, sf_dir, "events").select("event_id", D.impact(F.when(F.col("event_id") % 2 == 0, "text").otherwise("image"), v, metrics).alias("text"))


@query()
def det_chem_dedup(spark, sf_dir):
    """Formulas at the boxes of parts, of two sources a page, without doubles."""
    truth, found = V.boxes(spark, sf_dir)
    both = truth.withColumnRenamed("gt_id", "id").unionByName(found.withColumnRenamed("cand_id", "id"))
    formula = F.concat(F.lit("C"), F.col("id") % 3 + 2, F.when(F.col("id") % 2 == 0, "H6O").otherwise(""))
    return rounded(D.distinct_formulas(both.select("page", (F.col("id") % 4).cast("string").alias("source"), formula.alias("formula"), "box"), ["page"]).select("page", "source", "formula", "box.x0", "box.y0"))
