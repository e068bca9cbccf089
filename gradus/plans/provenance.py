"""Registered queries of versions: recomputation, differences, other forms, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.operators import provenance as P
from gradus.operators.stages import cut
from gradus.plans import views as V
from gradus.plans.registry import query, rounded


def pipeline(scale: str = "1", floor: str = "20") -> list[P.Stage]:
    """Two stages over events: a scaled value, then whether it is matched and its score."""
    scaled = P.Stage("normalize", f"scale={scale}", ("scaled",), lambda df: df.withColumn("scaled", F.col("value") * float(scale)))
    scored = P.Stage("evaluate", f"floor={floor}", ("matched", "score"), lambda df: df.withColumn("matched", F.col("scaled") >= float(floor)).withColumn("score", F.when(F.col("matched"), F.least("scaled", F.lit(100.0))).otherwise(0.0)))
    return [scaled, scored]


def recomputed(spark, sf_dir):
    """An earlier result of all events but every tenth, some of them with another value then; now with another floor for all."""
    e = V.table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    before = e.where("event_id % 10 > 0").withColumn("value", F.when(F.col("event_id") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")))
    cached = P.recompute(before, None, ["event_id"], pipeline()).drop("redone", "value", "event_type")
    return P.recompute(e, cut(cached), ["event_id"], pipeline(floor="30"))


@query("SELECT event_id, value AS scaled, value >= 30 AS matched, CASE WHEN value >= 30 THEN least(value, 100.0) ELSE 0.0 END AS score, CASE WHEN event_id % 10 = 0 OR event_id % 7 = 0 THEN 2 ELSE 1 END AS redone FROM events")
def recompute_cached(spark, sf_dir):
    """Scores after a change of the scoring's config: carried over, scored again, or computed from the start."""
    return recomputed(spark, sf_dir).select("event_id", "scaled", "matched", "score", "redone")


@query("SELECT unnest(['normalize', 'evaluate']) AS stage, unnest([count(*) FILTER (event_id % 10 > 0 AND event_id % 7 > 0), 0]) AS reused, unnest([count(*) FILTER (event_id % 10 = 0 OR event_id % 7 = 0), count(*)]) AS computed FROM events")
def recompute_work(spark, sf_dir):
    """How many rows each stage reused and computed."""
    return P.work(recomputed(spark, sf_dir), pipeline())


def versions(spark, sf_dir):
    """Events, and events of which the last tenth by number has other, missing and new rows; noise below the tolerance everywhere in it."""
    e = V.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    late = F.col("event_id") % 1000 >= 900
    changed = e.where(~late | (F.col("event_id") % 5 > 0)).withColumn("value", F.when(late & (F.col("event_id") % 3 == 0), F.col("value") + 2.5).when(late, F.col("value") + 1e-9).otherwise(F.col("value"))).withColumn("event_type", F.when(late & (F.col("event_id") % 11 == 0), "other").otherwise(F.col("event_type")))
    added = e.where(late & (F.col("event_id") % 4 == 0)).withColumn("event_id", -F.col("event_id") - 1)
    return e, changed.unionByName(added)


@query("""SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN a.event_id IS NULL THEN 'added' WHEN b.event_id IS NULL THEN 'gone' ELSE 'changed' END AS state,
    CASE WHEN a.event_id IS NULL OR b.event_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.event_type <> b.event_type THEN 'event_type' END, CASE WHEN abs(a.value - b.value) > 1e-6 THEN 'value' END) END AS columns, round(b.value - a.value, 6) AS delta_value
    FROM events a FULL OUTER JOIN n b ON a.event_id = b.event_id WHERE a.event_id IS NULL OR b.event_id IS NULL OR a.event_type <> b.event_type OR abs(a.value - b.value) > 1e-6""",
    """n AS (SELECT event_id, CASE WHEN event_id % 1000 >= 900 AND event_id % 11 = 0 THEN 'other' ELSE event_type END AS event_type,
    CASE WHEN event_id % 1000 >= 900 AND event_id % 3 = 0 THEN value + 2.5 WHEN event_id % 1000 >= 900 THEN value + 1e-9 ELSE value END AS value FROM events WHERE event_id % 1000 < 900 OR event_id % 5 > 0
    UNION ALL SELECT -event_id - 1, event_type, value FROM events WHERE event_id % 1000 >= 900 AND event_id % 4 = 0)""")
def control_diff(spark, sf_dir):
    """What differs between two versions of the events; nine tenths of their ranges are alike and not joined."""
    out = P.control_diff(*versions(spark, sf_dir), ["event_id"], F.floor(F.col("event_id") / 100), {"value": 1e-6})
    return rounded(out.select("event_id", "state", F.array_join("columns", ",").alias("columns"), "delta_value"))


_WORDS = "list_distinct(list_filter(string_split_regex({}, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))"


@query("""SELECT doc_id, scenario, round(score, 6) AS score, round(score - max(CASE WHEN scenario = 'as it is' THEN score END) OVER (PARTITION BY doc_id), 6) AS delta FROM
    (SELECT doc_id, scenario, CASE WHEN len(r) + len(p) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(r, p)) / (len(r) + len(p)) END AS score
     FROM (SELECT doc_id, scenario, """ + _WORDS.format("reference") + " AS r, " + _WORDS.format("form") + """ AS p FROM
        (SELECT doc_id, reference, unnest(['as it is', 'lower', 'plain', 'no digits']) AS scenario, unnest([predicted, lower(predicted), regexp_replace(predicted, '[^A-Za-z ]', ' ', 'g'), regexp_replace(predicted, '[0-9]', '', 'g')]) AS form FROM t)))""", V.TEXT_PAIRS)
def counterfactual(spark, sf_dir):
    """Shares of common words of each pair of texts, if the prediction were in other forms."""
    p = F.col("predicted")
    forms = {"as it is": p, "lower": F.lower(p), "plain": F.regexp_replace(p, "[^A-Za-z ]", " "), "no digits": F.regexp_replace(p, "[0-9]", "")}
    words = lambda c: F.array_distinct(F.array_remove(F.split(c, r"[ \t\n\r\f\x0B]+"), ""))

    def score(form):
        r, q = F.col("_r"), words(form)
        return F.when(F.size(r) + F.size(q) == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(r, q)) / (F.size(r) + F.size(q)))

    pairs = V.text_pairs(spark, sf_dir).select("doc_id", "predicted", words(F.col("reference")).alias("_r"))
    return rounded(P.counterfactual(pairs, ["doc_id"], forms, score, "as it is"))


@query("SELECT source AS part, count(*) AS rows FROM documents GROUP BY ALL")
def table_digests(spark, sf_dir):
    """Rows of each source's documents; their digests are alike whatever order they are read in, or the query fails."""
    d = V.table(spark, sf_dir, "documents").select(F.col("source").alias("part"), "doc_id", "text")
    both = P.table_digest(d, "part").join(P.table_digest(d.repartition("doc_id"), "part").select("part", F.col("digest").alias("other")), "part")
    return both.select("part", F.when(F.col("digest") == F.col("other"), F.col("rows")).otherwise(F.raise_error(F.lit("digests differ")).cast("long")).alias("rows"))
