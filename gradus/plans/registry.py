"""Registered queries of the library and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.functions import metrics as M
from gradus.functions import text as T
from gradus.operators import aggregate as A
from gradus.operators import matching, stats
from gradus.plans import views as V
from gradus.sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, counts as longs, so that both engines hash alike."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def _words(column: str) -> str:
    """White-space tokens in SQL, none of an empty text."""
    return f"CASE WHEN regexp_matches({column}, '\\S') THEN regexp_split_to_array(trim(regexp_replace({column}, '\\s+', ' ', 'g')), ' ') ELSE [] END"


def _level(keys: str) -> str:
    return f"""c AS (SELECT {keys}, category, avg(score) AS score, count(*) AS n_objects FROM o GROUP BY {keys}, category),
        w AS (SELECT {keys}, 'overall' AS category, avg(score) AS score, sum(n_objects)::BIGINT AS n_objects FROM c GROUP BY {keys})"""


_LEVELS = "SELECT {k}, category, round(score, 6) AS score, n_objects FROM (SELECT * FROM c UNION ALL SELECT * FROM w)"
_MACRO = "d AS (SELECT tool, category, document, avg(score) AS score, count(*) AS n FROM o GROUP BY ALL), m AS (SELECT tool, category, avg(score) AS score, stddev_samp(score) AS std_dev, count(*) AS n_documents, sum(n)::BIGINT AS n_objects FROM d GROUP BY ALL)"


@query(_LEVELS.format(k="tool, document, page"), V.OBJECTS, _level("tool, document, page"))
def agg_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.level_means(V.objects(spark, sf_dir), ["tool", "document", "page"]))


@query(_LEVELS.format(k="tool, document"), V.OBJECTS, _level("tool, document"))
def agg_document(spark, sf_dir):
    return rounded(A.level_means(V.objects(spark, sf_dir), ["tool", "document"]))


@query("SELECT tool, document, category, round(avg(score), 6) AS score, count(*) AS n_subtypes FROM s GROUP BY ALL", V.OBJECTS, "s AS (SELECT tool, document, category, coalesce(subtype, -1) AS subtype, avg(score) AS score FROM o GROUP BY ALL)")
def agg_chem_balanced(spark, sf_dir):
    return rounded(A.balanced(V.objects(spark, sf_dir), ["tool", "document"]))


@query("SELECT tool, category, round(score, 6) AS score, round(std_dev, 6) AS std_dev, n_documents, n_objects FROM m", V.OBJECTS, _MACRO)
def agg_tool_category(spark, sf_dir):
    return rounded(A.tool_categories(V.objects(spark, sf_dir)))


def _categories(sf: DataFrame) -> dict[str, float]:
    return {r[0]: 1.0 + i for i, r in enumerate(sf.select("category").distinct().orderBy("category").collect())}  # five kinds of event


@query("SELECT tool, round(sum(r * score) / sum(r), 6) AS overall, count(*) AS n_categories FROM (SELECT m.*, dense_rank() OVER (ORDER BY category) AS r FROM m) GROUP BY tool", V.OBJECTS, _MACRO)
def agg_overall(spark, sf_dir):
    o = V.objects(spark, sf_dir)
    return rounded(A.overall(A.tool_categories(o), _categories(o), strict=True))


@query("""SELECT tool, kind, round(avg(v), 6) AS score, count(*) AS n_subtypes FROM (SELECT tool, kind, subtype, avg(v) AS v FROM (SELECT tool, kind, subtype, document, avg(v) AS v FROM x WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""",
       V.OBJECTS, "x AS (SELECT tool, document, subtype, 'detection' AS kind, CASE WHEN matched THEN 100.0 ELSE 0.0 END AS v FROM o UNION ALL SELECT tool, document, subtype, 'extraction', CASE WHEN matched THEN score END FROM o)")
def agg_chem_reporting(spark, sf_dir):
    return rounded(A.reporting(V.objects(spark, sf_dir)))


@query("""SELECT 'document' AS scope, tool, document, category, round(score, 6) AS score FROM (SELECT * FROM c UNION ALL SELECT * FROM w)
    UNION ALL SELECT 'tool', tool, NULL, category, round(avg(score), 6) FROM c GROUP BY tool, category""", V.OBJECTS, _level("tool, document"))
def agg_benchmark(spark, sf_dir):
    o = V.objects(spark, sf_dir)
    doc = A.level_means(o, ["tool", "document"]).select(F.lit("document").alias("scope"), "tool", "document", "category", "score")
    tool = A.tool_categories(o).select(F.lit("tool").alias("scope"), "tool", "category", "score")
    return rounded(doc.unionByName(tool, allowMissingColumns=True))


@query("SELECT tool, round(avg(score), 6) AS overall FROM m GROUP BY tool HAVING count(DISTINCT category) = (SELECT count(DISTINCT category) FROM o)", V.OBJECTS, _MACRO)
def agg_run_report(spark, sf_dir):
    o = V.objects(spark, sf_dir)
    need = o.agg(F.countDistinct("category").alias("need"))
    by = A.tool_categories(o).groupBy("tool").agg(F.avg("score").alias("overall"), F.count("*").alias("n"))
    return rounded(by.crossJoin(F.broadcast(need)).where("n = need").select("tool", "overall"))  # one row


@query("""SELECT tool, sum(pages) AS pages, round(sum(seconds), 6) AS seconds, round(sum(seconds) / nullif(sum(pages), 0), 6) AS sec_per_page, max(ram) AS peak_ram,
    round(CASE WHEN count(cost) = count(*) THEN sum(cost) END, 6) AS cost, CASE WHEN count(cost) = count(*) THEN 'known' WHEN count(cost) > 0 THEN 'mixed' ELSE 'unavailable' END AS cost_basis FROM p GROUP BY tool""", V.OPERATIONS)
def agg_operational(spark, sf_dir):
    known = F.count("cost") == F.count("*")
    basis = F.when(known, "known").when(F.count("cost") > 0, "mixed").otherwise("unavailable")
    return rounded(V.operations(spark, sf_dir).groupBy("tool").agg(F.sum("pages").alias("pages"), F.sum("seconds").alias("seconds"), F.try_divide(F.sum("seconds"), F.sum("pages")).alias("sec_per_page"), F.max("ram").alias("peak_ram"), F.when(known, F.sum("cost")).alias("cost"), basis.alias("cost_basis")))


@query("SELECT tool, omitted, round(score, 6) AS score, round(score - f.s, 6) AS delta FROM r JOIN f USING (tool)", V.OBJECTS, "d AS (SELECT tool, document, category, avg(score) AS score FROM o GROUP BY ALL)",
       "f AS (SELECT tool, avg(s) AS s, count(*) AS n FROM (SELECT tool, category, avg(score) AS s FROM d GROUP BY ALL) GROUP BY tool)",
       "q AS (SELECT x.tool, x.document AS omitted, d.category, avg(d.score) AS s FROM (SELECT DISTINCT tool, document FROM d) x JOIN d ON d.tool = x.tool AND d.document <> x.document GROUP BY ALL)",
       "r AS (SELECT q.tool, q.omitted, CASE WHEN count(*) = max(f.n) THEN avg(q.s) END AS score FROM q JOIN f ON f.tool = q.tool GROUP BY q.tool, q.omitted)")
def lodo(spark, sf_dir):
    return rounded(A.leave_one_out(V.objects(spark, sf_dir)))


@query("SELECT l.tool AS left_tool, r.tool AS right_tool, l.category, count(*) AS n_documents, round(avg(l.score - r.score), 6) AS delta FROM d l JOIN d r ON l.document = r.document AND l.category = r.category AND l.tool < r.tool GROUP BY ALL", V.OBJECTS, _MACRO)
def join_pairs_self(spark, sf_dir):
    return rounded(A.paired(V.objects(spark, sf_dir)))


@query("SELECT tool, category, count(score) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, round(stddev_samp(score), 6) AS sd, round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.75), 6) AS q3, min(score) AS low, max(score) AS high FROM o GROUP BY ALL", V.OBJECTS)
def describe(spark, sf_dir):
    return rounded(stats.describe(V.objects(spark, sf_dir), ["tool", "category"], "score"))


@query("""SELECT tool, category, count(*) AS n, round(sum((score - m) ** 2), 6) AS ss_total, round(sum((dm - m) ** 2), 6) AS ss_between, round(sum((score - dm) ** 2), 6) AS ss_within,
    round(CASE WHEN sum((score - m) ** 2) > 1e-12 THEN sum((dm - m) ** 2) / sum((score - m) ** 2) END, 6) AS between_share, round(var_samp(score), 6) AS sample_variance
    FROM (SELECT *, avg(score) OVER (PARTITION BY tool, category) AS m, avg(score) OVER (PARTITION BY tool, category, document) AS dm FROM o) GROUP BY ALL""", V.OBJECTS)
def object_variance(spark, sf_dir):
    return rounded(stats.variance_components(V.objects(spark, sf_dir), ["tool", "category"], "document", "score"), 6)


@query("""SELECT category, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM (SELECT *, rank() OVER (PARTITION BY category ORDER BY score) + (count(*) OVER (PARTITION BY category, score) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY category ORDER BY page) + (count(*) OVER (PARTITION BY category, page) - 1) / 2.0 AS rb FROM o) GROUP BY category""", V.OBJECTS)
def spearman(spark, sf_dir):
    return rounded(stats.spearman(V.objects(spark, sf_dir), ["category"], "score", "page"))


@query("SELECT tool, document, category, round(score, 6) AS score FROM d JOIN (SELECT category, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3, count(*) AS k FROM d GROUP BY ALL) USING (category) WHERE k >= 4 AND (score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1))", V.OBJECTS, _MACRO)
def iqr_outliers(spark, sf_dir):
    cell = V.objects(spark, sf_dir).groupBy("tool", "document", "category").agg(F.avg("score").alias("score"))
    return rounded(stats.iqr_outliers(cell, ["tool", "document"], "category", "score"))


@query("SELECT p_partkey, p_size::BIGINT AS p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))")
def anti_pareto(spark, sf_dir):
    return rounded(stats.pareto(V.table(spark, sf_dir, "part"), "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice"))


@query("""SELECT category, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM (SELECT p.category, r, avg(q.score) AS m FROM k p, range(10000) t(r), k q
    WHERE q.category = p.category AND q.i = ('0x' || substr(md5(r || ':' || p.i), 1, 8))::BIGINT % p.n GROUP BY ALL) GROUP BY category""", V.OBJECTS,
       "k AS (SELECT category, score, row_number() OVER (PARTITION BY category ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM (SELECT category, tool * 10 + document AS key, avg(score) AS score FROM o GROUP BY ALL))")
def bootstrap_mean_ci(spark, sf_dir):
    cell = V.objects(spark, sf_dir).groupBy("category", (F.col("tool") * 10 + F.col("document")).alias("key")).agg(F.avg("score").alias("score"))
    return rounded(stats.hash_bootstrap(cell, ["category"], "key", "score"))


@query("SELECT document, category, count(*) AS n FROM o GROUP BY ALL", V.OBJECTS)
def coverage(spark, sf_dir):
    return V.objects(spark, sf_dir).groupBy("document", "category").agg(F.count("*").alias("n"))


@query("SELECT tool, " + ", ".join(f"round(avg(score) FILTER (document = {d}), 6) AS d{d}" for d in range(5)) + " FROM o GROUP BY tool", V.OBJECTS)
def score_map(spark, sf_dir):
    wide = V.objects(spark, sf_dir).groupBy("tool").pivot("document", list(range(5))).agg(F.avg("score"))
    return rounded(wide.select("tool", *[F.col(str(d)).alias(f"d{d}") for d in range(5)]))


@query("SELECT tool, category, object_id, score FROM (SELECT *, row_number() OVER (PARTITION BY tool, category ORDER BY score, object_id) AS n FROM o) WHERE n = 1", V.OBJECTS)
def worst_case(spark, sf_dir):
    return A.first_by(V.objects(spark, sf_dir), ["tool", "category"], ["score", "object_id"]).select("tool", "category", "object_id", "score")


@query("SELECT category, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, count(*) FILTER (score > 0) AS nonzero_tools, round(max(score), 6) AS best, string_agg(tool::VARCHAR, ',' ORDER BY tool) FILTER (top) AS best_tools FROM (SELECT *, score >= max(score) OVER (PARTITION BY category) - 0.5 AS top FROM m) GROUP BY category", V.OBJECTS, _MACRO)
def category_difficulty(spark, sf_dir):
    m = A.tool_categories(V.objects(spark, sf_dir))
    m = m.withColumn("top", F.col("score") >= F.max("score").over(Window.partitionBy("category")) - 0.5)
    best = F.concat_ws(",", F.sort_array(F.collect_list(F.when(F.col("top"), F.col("tool")))).cast("array<string>"))
    return rounded(m.groupBy("category").agg(F.avg("score").alias("mean"), F.percentile("score", F.lit(0.5)).alias("median"), F.count_if(F.col("score") > 0).alias("nonzero_tools"), F.max("score").alias("best"), best.alias("best_tools")))


@query("SELECT grp, count(*) AS n_tools, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median FROM (SELECT tool, avg(score) AS s FROM m GROUP BY tool) JOIN (SELECT * FROM (VALUES ('local', 0, 4), ('cloud', 5, 9), ('classic', 0, 2), ('ml', 3, 4)) g(grp, lo, hi)) ON tool BETWEEN lo AND hi GROUP BY grp", V.OBJECTS, _MACRO)
def group_scores(spark, sf_dir):
    member = spark.createDataFrame([(g, t) for g, lo, hi in (("local", 0, 4), ("cloud", 5, 9), ("classic", 0, 2), ("ml", 3, 4)) for t in range(lo, hi + 1)], "grp string, tool long")
    s = A.tool_categories(V.objects(spark, sf_dir)).groupBy("tool").agg(F.avg("score").alias("s"))
    return rounded(s.join(F.broadcast(member), "tool").groupBy("grp").agg(F.count("*").alias("n_tools"), F.avg("s").alias("mean"), F.percentile("s", F.lit(0.5)).alias("median")))


@query("SELECT tool, round(quantile_cont(spp, 0.5), 6) AS median, round(min(spp), 6) AS fastest, arg_max(document, spp) AS slowest_document, round(max(spp) / quantile_cont(spp, 0.5), 6) AS ratio, round((sum(seconds) - arg_max(seconds, spp)) / (sum(pages) - arg_max(pages, spp)), 6) AS without_slowest FROM (SELECT tool, document, sum(seconds) AS seconds, sum(pages) AS pages, sum(seconds) / sum(pages) AS spp FROM p GROUP BY ALL) GROUP BY tool", V.OPERATIONS)
def speed_sensitivity(spark, sf_dir):
    pair = V.operations(spark, sf_dir).groupBy("tool", "document").agg(F.sum("seconds").alias("seconds"), F.sum("pages").alias("pages")).withColumn("spp", F.col("seconds") / F.col("pages"))
    mid, top = F.percentile("spp", F.lit(0.5)), lambda c: F.max_by(c, "spp")
    return rounded(pair.groupBy("tool").agg(mid.alias("median"), F.min("spp").alias("fastest"), top("document").alias("slowest_document"), F.try_divide(F.max("spp"), mid).alias("ratio"), F.try_divide(F.sum("seconds") - top("seconds"), F.sum("pages") - top("pages")).alias("without_slowest")))


@query("SELECT document, round(avg(score), 6) AS difficulty, round(avg(score) FILTER (category IN ('click', 'view', 'purchase')), 6) AS common FROM (SELECT document, category, avg(score) AS score FROM d GROUP BY ALL) GROUP BY document", V.OBJECTS, _MACRO)
def document_diagnostics(spark, sf_dir):
    cell = V.objects(spark, sf_dir).groupBy("tool", "document", "category").agg(F.avg("score").alias("score")).groupBy("document", "category").agg(F.avg("score").alias("score"))
    return rounded(cell.groupBy("document").agg(F.avg("score").alias("difficulty"), F.avg(F.when(F.col("category").isin("click", "view", "purchase"), F.col("score"))).alias("common")))


@query("SELECT tool, category, metric, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT tool, category, unnest(['detection', 'score']) AS metric, unnest([CASE WHEN matched THEN 100.0 ELSE 0.0 END, score]) AS v FROM o) GROUP BY ALL", V.OBJECTS)
def metric_records(spark, sf_dir):
    o = V.objects(spark, sf_dir).withColumn("detection", F.when(F.col("matched"), 100.0).otherwise(0.0))
    return rounded(o.unpivot(["tool", "category"], ["detection", "score"], "metric", "v").groupBy("tool", "category", "metric").agg(F.avg("v").alias("mean"), F.count("*").alias("n")))


@query("SELECT tool, document, count_if(matched) AS matched_objects, count_if(NOT matched) AS missing_objects FROM o GROUP BY ALL", V.OBJECTS)
def matched_counts(spark, sf_dir):
    return V.objects(spark, sf_dir).groupBy("tool", "document").agg(F.count_if("matched").alias("matched_objects"), F.count_if(~F.col("matched")).alias("missing_objects"))


@query("SELECT tool, document, category, round(avg(score), 6) AS score FROM o WHERE tool NOT IN (SELECT tool FROM o WHERE score < 0.05) GROUP BY ALL", V.OBJECTS)
def clean_dataset(spark, sf_dir):
    o = V.objects(spark, sf_dir)
    wrong = o.where("score < 0.05").select("tool").distinct()
    return rounded(o.join(wrong, "tool", "left_anti").groupBy("tool", "document", "category").agg(F.avg("score").alias("score")))


@query("SELECT page, gt_id, cand_id, round(iou, 6) AS score FROM s WHERE iou >= 0.1 - 1e-12", V.BOXES)
def pair_score(spark, sf_dir):
    return matching.pair_scores(*V.boxes(spark, sf_dir), ["page"], digits=6)


@query("SELECT page, gt_id, cand_id, round(ios, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY ios DESC, iou DESC, gt_id) AS n FROM (SELECT page, gt_id, cand_id, round(ios, 9) AS ios, round(iou, 9) AS iou FROM s) WHERE ios >= 0.5) WHERE n = 1", V.BOXES)
def text_owner(spark, sf_dir):
    return rounded(matching.owners(*V.boxes(spark, sf_dir), ["page"]))


@query("SELECT page, gt_id, cand_id, round(covered, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY round(covered, 9) DESC, cand_id) AS rank FROM s WHERE covered >= 0.002 OR centred) WHERE rank <= 8", V.BOXES)
def nearby_outputs(spark, sf_dir):
    return rounded(matching.nearest(*V.boxes(spark, sf_dir), ["page"]))


@query()
def assign_hungarian(spark, sf_dir):
    return matching.assign(*V.boxes(spark, sf_dir, small_pages=True), ["page"])


#: Accented letters of the documents as single bytes, for engines whose edit distance counts bytes.
ACCENTS = "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍ"
_PLAIN = "translate({c}, '" + ACCENTS + "', " + " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 27)]) + ")"
_EDITS = "e AS (SELECT doc_id, length(reference) AS n, length(predicted) AS m, levenshtein(" + _PLAIN.format(c="reference") + ", " + _PLAIN.format(c="predicted") + ")::BIGINT AS distance FROM t)"
_CER = "CASE WHEN n = 0 THEN CASE WHEN m = 0 THEN 0.0 ELSE 1.0 END ELSE distance / n END"


@query("SELECT doc_id, distance, round(" + _CER + ", 6) AS cer, round(CASE WHEN greatest(n, m) = 0 THEN 1.0 ELSE 1 - distance / greatest(n, m) END, 6) AS edit_similarity FROM e", V.TEXT_PAIRS, _EDITS)
def levenshtein(spark, sf_dir):
    t = V.text_pairs(spark, sf_dir)
    d = M.distance("reference", "predicted")
    return rounded(t.select("doc_id", d.alias("distance"), M.error_rate(d, F.length("reference"), F.length("predicted")).alias("cer"), M.edit_similarity(F.col("reference"), F.col("predicted")).alias("edit_similarity")))


@query("""SELECT doc_id, tp, round(CASE WHEN np > 0 AND nr = 0 THEN 0.0 WHEN np = 0 THEN 1.0 ELSE tp / np END, 6) AS precision, round(CASE WHEN nr > 0 AND np = 0 THEN 0.0 WHEN nr = 0 THEN 1.0 ELSE tp / nr END, 6) AS recall FROM (SELECT n.doc_id, np, nr, coalesce(sum(CASE WHEN b.c IS NOT NULL THEN least(a.c, b.c) END), 0)::BIGINT AS tp
    FROM n LEFT JOIN a USING (doc_id) LEFT JOIN b ON a.doc_id = b.doc_id AND a.w = b.w GROUP BY ALL)""", V.TEXT_PAIRS,
       f"x AS (SELECT doc_id, {_words('reference')} AS r, {_words('predicted')} AS p FROM t)",
       "n AS (SELECT doc_id, len(r) AS nr, len(p) AS np FROM x), a AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(r) AS w FROM x) GROUP BY ALL), b AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(p) AS w FROM x) GROUP BY ALL)")
def multiset_prf(spark, sf_dir):
    t = V.text_pairs(spark, sf_dir).select("doc_id", T.word_tokens(F.col("reference")).alias("r"), T.word_tokens(F.col("predicted")).alias("p"))
    out = t.select("doc_id", M.multiset_overlap(F.col("r"), F.col("p")).alias("tp"), M.multiset_prf(F.col("r"), F.col("p")).alias("x"))
    return rounded(out.select("doc_id", "tp", "x.precision", "x.recall"))


@query("SELECT doc_id, round(CASE WHEN len(p) > 0 AND len(r) = 0 THEN 0.0 WHEN len(p) = 0 THEN 1.0 ELSE len(list_intersect(r, p)) / len(p) END, 6) AS precision, round(CASE WHEN len(r) > 0 AND len(p) = 0 THEN 0.0 WHEN len(r) = 0 THEN 1.0 ELSE len(list_intersect(r, p)) / len(r) END, 6) AS recall FROM x", V.TEXT_PAIRS,
       f"x AS (SELECT doc_id, list_distinct({_words('reference')}) AS r, list_distinct({_words('predicted')}) AS p FROM t)")
def set_prf(spark, sf_dir):
    t = V.text_pairs(spark, sf_dir).select("doc_id", M.set_prf(T.word_tokens(F.col("reference")), T.word_tokens(F.col("predicted"))).alias("x"))
    return rounded(t.select("doc_id", "x.precision", "x.recall"))


@query()
def text_metrics(spark, sf_dir):
    """0.40 CER, 0.30 WER, 0.10 edit similarity and 0.20 reading order where there is one, each as a score."""
    t = M.kept(V.form_pairs(spark, sf_dir, T.norm_text), x=M.text_distances("r", "p"))
    t = t.select("doc_id", "r", "p", F.col("x.characters").alias("d"), M.clamp01(1 - M.error_rate(F.col("x.characters"), F.length("r"), F.length("p"))).alias("cer"), M.clamp01(1 - M.error_rate(F.col("x.words"), F.col("x.n"), F.col("x.m"))).alias("wer"))
    longest = F.greatest(F.length("r"), F.length("p"))
    edit = F.when(longest > 0, 1 - F.col("d") / longest).otherwise(1.0)
    score = M.weighted_mean([(0.40, F.col("cer")), (0.30, F.col("wer")), (0.10, edit), (0.20, F.lit(None).cast("double"))])
    return rounded(t.select("doc_id", "cer", "wer", (100 * score).alias("score")))


@query("""SELECT a.conv_id, count(*) AS n, round(coalesce(sum(CASE WHEN b.pos > a.pos THEN 1.0 ELSE 0.0 END) / nullif(count(b.turn), 0), 1.0), 6) AS pair_order FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY a.conv_id""",
       "c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS pos FROM conversations)")
def reading_order(spark, sf_dir):
    """Share of turn pairs that ordering by length keeps."""
    w = Window.partitionBy("conv_id").orderBy(F.length("text"), "turn")
    c = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("pos"))
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") < F.col("b.turn")), "left")
    kept = F.sum(F.when(F.col("b.pos") > F.col("a.pos"), 1.0).otherwise(0.0))
    return rounded(j.groupBy(F.col("a.conv_id").alias("conv_id")).agg(F.count("*").alias("n"), F.coalesce(F.try_divide(kept, F.count("b.turn")), F.lit(1.0)).alias("pair_order")))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def collapse_ws(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse_ws(F.col("text"))).alias("digest"))


@query("""SELECT doc_id, md5(replace(replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(nfc_normalize(text), chr(173) || chr(10), ''), chr(173), ''), '-[ \\t]*\\n([A-Za-zА-Яа-яЁё])', '-\\1', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), ' ' || chr(10)),
    '\\n\\n+', chr(1), 'g'), chr(10), ' '), chr(1), chr(10) || chr(10))) AS digest FROM documents""")
def norm_text(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.norm_text(F.col("text"))).alias("digest"))


@query("SELECT doc_id, len(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS n_words FROM documents WHERE trim(text) <> ''")
def word_tokens(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").where(F.trim("text") != "").select("doc_id", F.size(T.word_tokens(F.col("text"))).cast("long").alias("n_words"))


@query("SELECT o_orderkey, o_custkey, coalesce(c_custkey, -1) AS c_custkey, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'extra' ELSE 'both' END AS state FROM orders FULL JOIN customer ON o_custkey = c_custkey")
def gt_manifest_check(spark, sf_dir):
    o, c = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "full_outer")
    state = F.when(F.col("c_custkey").isNull(), "missing").when(F.col("o_orderkey").isNull(), "extra").otherwise("both")
    return j.select("o_orderkey", "o_custkey", F.coalesce("c_custkey", F.lit(-1).cast("long")).alias("c_custkey"), state.alias("state"))


@query("""SELECT 'empty_text' AS code, doc_id AS id FROM documents WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT 'short_text', doc_id FROM documents WHERE n_chars < 100
    UNION ALL SELECT 'length_mismatch', doc_id FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'no_label', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def gt_content_check(spark, sf_dir):
    """One row an issue: rules as filters over one scan, and an anti-join."""
    d, labels = V.table(spark, sf_dir, "documents"), V.table(spark, sf_dir, "labels")
    rules = F.filter(F.array(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_text"), F.when(F.col("n_chars") < 100, "short_text"), F.when(F.col("n_chars") != F.length("text"), "length_mismatch")), lambda x: x.isNotNull())
    own = d.select(F.explode(rules).alias("code"), F.col("doc_id").alias("id"))
    return own.unionByName(d.join(labels, "doc_id", "left_anti").select(F.lit("no_label").alias("code"), F.col("doc_id").alias("id")))


@query("SELECT doc_id, sha256(concat_ws('|', doc_id, lang, source)) AS raw, sha256(concat_ws('|', n_chars, md5(text))) AS normalized FROM documents")
def fingerprints(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.concat_ws("|", "doc_id", "lang", "source"), 256).alias("raw"), F.sha2(F.concat_ws("|", "n_chars", F.md5("text")), 256).alias("normalized"))


@query("SELECT event_id, CASE WHEN value > 200 THEN 'reuse_standardized' WHEN value > 100 THEN 'standardize_only' WHEN event_type = 'click' THEN 'refuse' ELSE 'run_adapter' END AS action FROM events")
def plan_action(spark, sf_dir):
    """Reuse of stages by what is compatible; a refused call where running would be billed again."""
    e = V.table(spark, sf_dir, "events")
    act = F.when(F.col("value") > 200, "reuse_standardized").when(F.col("value") > 100, "standardize_only").when(F.col("event_type") == "click", "refuse").otherwise("run_adapter")
    return e.select("event_id", act.alias("action"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events FROM events GROUP BY user_id")
def job_fsm(spark, sf_dir):
    """Latest state of each job."""
    return V.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n_events"))


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)")
def ttl_expiry(spark, sf_dir):
    """Expired rows whose owner has no active job."""
    e = V.table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"))
    active = e.where("event_type = 'purchase' and value > 150").select("user_id").distinct()
    return e.crossJoin(F.broadcast(last)).where(F.expr("ts < last - interval 7 days")).join(active, "user_id", "left_anti").select("event_id")  # last: one row


@query("SELECT source, doc_id // 1000 AS part, count(*) AS n, list_sort(list(doc_id)) AS ids FROM documents GROUP BY ALL")
def expected_by_doc(spark, sf_dir):
    """The ids that each source should have, in lists of a thousand numbers, so a large source is many rows."""
    return V.table(spark, sf_dir, "documents").groupBy("source", F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("doc_id")).alias("ids"))


@query()
def formula_kernels(spark, sf_dir):
    """LaTeX and formula forms, tokens and compositions of strings built from part numbers."""
    p = V.spread(V.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    n = F.col("p_size").cast("string")
    latex = F.concat(F.lit("$\\dfrac12 x_"), n, F.lit(" + \\left( \\alpha y \\right)$"))
    chem = F.concat(F.lit("Fe"), n, F.lit("(SO₄)₃ · "), n, F.lit("H₂O"))
    out = p.select("p_partkey", T.norm_latex(latex).alias("latex"), T.norm_chem(chem).alias("formula"))
    return out.select("p_partkey", "latex", F.size(T.latex_tokens(F.col("latex"))).alias("n_latex"), "formula", F.size(T.chem_tokens(F.col("formula"))).alias("n_chem"), F.map_entries(T.composition(F.col("formula"))).alias("atoms"))


@query()
def table_cells(spark, sf_dir):
    """Cells of an HTML table and of a Markdown one made from region names."""
    r = V.table(spark, sf_dir, "region")
    html = F.concat(F.lit("<table><tr><th colspan=2>"), F.col("r_name"), F.lit("</th></tr><tr><td>"), F.col("r_regionkey"), F.lit("</td><td>x</td></tr></table>"))
    md = F.concat(F.lit("| name | key |\n|---|---|\n| "), F.col("r_name"), F.lit(" | "), F.col("r_regionkey"), F.lit(" |"))
    return r.select("r_regionkey", F.lit("html").alias("kind"), F.explode(tables.html_table(html)).alias("cell")).unionByName(r.select("r_regionkey", F.lit("markdown").alias("kind"), F.explode(tables.markdown_table(md)).alias("cell"))).select("r_regionkey", "kind", "cell.*")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_quantity, 2)::DECIMAL(38,18) AS parsed FROM lineitem")
def parse_numeric(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), T.parse_numeric(F.regexp_replace(F.col("l_quantity").cast("decimal(12,2)").cast("string"), r"\.", ",")).alias("parsed"))


ALIASES = {"en": "text", "fr": "table", "de": "math", "es": "image"}


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'text' WHEN 'fr' THEN 'table' WHEN 'de' THEN 'math' WHEN 'es' THEN 'image' ELSE 'other' END AS object_type, coalesce(nullif(text, ''), source) AS reference FROM documents")
def gt_canon(spark, sf_dir):
    """One name an object type by an alias map, and the first payload that is there."""
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(alias[F.col("lang")], F.lit("other")).alias("object_type"), F.coalesce(F.nullif("text", F.lit("")), "source").alias("reference"))


@query("SELECT page, gt_id, cand_id, round(dy, 6) AS dy FROM (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY dy, w DESC, cand_id) AS n FROM (SELECT g.page, g.id AS gt_id, c.id AS cand_id, round(abs(c.y0 - g.y1), 9) AS dy, round(greatest(0, least(g.x1, c.x1) - greatest(g.x0, c.x0)) / least(g.x1 - g.x0, c.x1 - c.x0), 9) AS w FROM b g JOIN b c ON g.page = c.page AND g.id % 2 = 1 AND c.id % 2 = 0) WHERE dy <= 0.08 AND w >= 0.2) WHERE n = 1", V.BOXES)
def join_caption(spark, sf_dir):
    """Nearest caption under each box, of those that share a fifth of its width."""
    return rounded(matching.captions(*V.boxes(spark, sf_dir), ["page"]))


@query("""SELECT o_orderkey, count(a.q) AS n_reference, count(b.q) AS n_predicted, count(*) FILTER (a.q IS NOT NULL AND b.q IS NOT NULL) AS n_both, round(sum(CASE WHEN a.q = b.q THEN 1.0 ELSE 0.0 END) / nullif(count(a.q), 0), 6) AS content
    FROM (SELECT coalesce(a.k, b.k) AS o_orderkey, a.q, b.q FROM a FULL JOIN b ON a.k = b.k AND a.r = b.r) x(o_orderkey, aq, bq), LATERAL (SELECT aq AS q) a, LATERAL (SELECT bq AS q) b GROUP BY o_orderkey""",
       "a AS (SELECT l_orderkey AS k, l_linenumber AS r, floor(l_quantity) AS q FROM lineitem)", "b AS (SELECT l_orderkey AS k, l_linenumber AS r, floor(l_quantity - (l_linenumber % 2)) AS q FROM lineitem)")
def join_cells(spark, sf_dir):
    """Cells of two tables by their place: how many each has, both have, and have alike."""
    li = V.table(spark, sf_dir, "lineitem")
    a = li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("r"), F.floor("l_quantity").alias("aq"))
    b = li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("r"), F.floor(F.col("l_quantity") - F.col("l_linenumber") % 2).alias("bq"))
    j = a.join(b, ["o_orderkey", "r"], "full_outer")
    alike = F.sum(F.when(F.col("aq") == F.col("bq"), 1.0).otherwise(0.0))
    return rounded(j.groupBy("o_orderkey").agg(F.count("aq").alias("n_reference"), F.count("bq").alias("n_predicted"), F.count_if(F.col("aq").isNotNull() & F.col("bq").isNotNull()).alias("n_both"), F.try_divide(alike, F.count("aq")).alias("content")))


@query("SELECT doc_id, concat_ws(',', CASE WHEN m < 0.72 * n THEN 'short' END, CASE WHEN m > 1.35 * n THEN 'long' END, CASE WHEN distance > 0.05 * n THEN 'characters' END) AS tags FROM e", V.TEXT_PAIRS, _EDITS)
def error_tags(spark, sf_dir):
    """Why a prediction lost: tags of the rules that hold."""
    n, m = F.length("reference"), F.length("predicted")
    tags = F.concat_ws(",", F.when(m < 0.72 * n, "short"), F.when(m > 1.35 * n, "long"), F.when(M.farther(F.col("reference"), F.col("predicted"), 0.05 * n), "characters"))
    return V.text_pairs(spark, sf_dir).select("doc_id", tags.alias("tags"))


@query("SELECT user_id, event_id, raw_ok, std_ok FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY std_ok DESC, raw_ok DESC, ts, event_id) AS n FROM (SELECT user_id, event_id, ts, value > 50 AS raw_ok, value > 50 AND event_type <> 'click' AS std_ok FROM events) WHERE raw_ok) WHERE n = 1")
def pick_cache(spark, sf_dir):
    """First compatible cache by stage reached, then age; a later stage holds only if the earlier ones do."""
    e = V.table(spark, sf_dir, "events").withColumn("raw_ok", F.col("value") > 50).withColumn("std_ok", F.col("raw_ok") & (F.col("event_type") != "click")).where("raw_ok")
    return A.first_by(e, ["user_id"], [F.desc("std_ok"), F.desc("raw_ok"), "ts", "event_id"]).select("user_id", "event_id", "raw_ok", "std_ok")


@query("""SELECT user_id, grp::BIGINT AS grp, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT user_id, event_id, ts,
    CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 21600 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL""")
def win_gap_groups(spark, sf_dir):
    """Rows split where the gap to the one before is too wide."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("double") - F.lag("ts").over(own).cast("double")
    e = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("new", F.when(gap <= 21600, 0).otherwise(1))
    e = e.withColumn("grp", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "grp").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT doc_id, 'missing' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def set_missing_extra(spark, sf_dir):
    d, lab = (V.table(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    return d.join(lab, "doc_id", "left_anti").withColumn("state", F.lit("missing")).unionByName(lab.join(d, "doc_id", "left_anti").withColumn("state", F.lit("extra")))


from gradus.plans import detectors, documents, integrity, layout, provenance, scored, standard, streams  # noqa: E402, F401  (they register their queries here)
