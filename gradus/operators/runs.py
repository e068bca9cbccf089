"""Runs of tools: operational rows, integrity rules, reuse of stages, contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """A number that is there, no NaN and not infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def positive(c: Column) -> Column:
    return F.when(finite(c) & (c > 0), c)


def resource_row(pairs: DataFrame) -> DataFrame:
    """Seconds, memory and cost of each (tool, document) by what was measured.

    Cloud: processing, then latency, then wall time; local: wall time, then the invocation's. Memory of the process tree,
    then of the process. GPU memory of the process, then of the device where the framework was active, else 0. Local
    runs cost nothing; others what they cost, then what was estimated, then unknown.
    """
    c = F.col
    cloud, local = c("kind") == "cloud", c("kind") == "local"
    seconds = F.when(cloud, F.coalesce(positive(c("processing_seconds")), positive(c("latency_seconds")), F.when(finite(c("wall_seconds")), c("wall_seconds")))).otherwise(F.coalesce(positive(c("wall_seconds")), F.when(finite(c("invocation_seconds")), c("invocation_seconds"))))
    held = lambda x: F.when(finite(x), x)
    active = F.coalesce(positive(c("framework_allocated_mb")), positive(c("framework_reserved_mb"))).isNotNull()
    vram = F.coalesce(positive(c("gpu_process_mb")), F.when(active, positive(c("gpu_device_mb"))), F.lit(0.0))
    cost = F.when(local, 0.0).otherwise(F.coalesce(held(c("actual_cost")), held(c("estimated_cost"))))
    basis = F.when(local, "not_applicable_local").when(finite(c("actual_cost")), "actual").when(finite(c("estimated_cost")), "estimated").otherwise("unavailable")
    out = pairs.select("tool", "document", "pages", seconds.alias("seconds"), F.coalesce(held(c("tree_rss_mb")), held(c("rss_mb"))).alias("ram"), vram.alias("vram"), cost.alias("cost"), basis.alias("cost_basis"))
    return out.withColumn("sec_per_page", F.when(c("pages") > 0, c("seconds") / c("pages")))


STAGES = ("raw_acquisition", "standardization", "normalization", "evaluation")


def cache_compat(cached: DataFrame, current: dict[str, str]) -> DataFrame:
    """What of each cached pair may be reused: a stage holds only if all before it do. Columns <stage>_ok and reasons.

    cached: tool, document, source_sha256, config_sha256 and a fingerprint (or null) of each stage; current: what each should be.
    """
    differs = lambda k: F.when(F.col(k).isNull(), F.lit(f"{k}_missing")).when(F.col(k) != current[k], F.lit(f"{k}_changed"))
    ok = F.coalesce((F.col("source_sha256") == current["source_sha256"]) & (F.col("config_sha256") == current["config_sha256"]), F.lit(False))
    out = []
    for stage in STAGES:
        ok = ok & F.coalesce(F.col(stage) == current[stage], F.lit(False))
        out.append(ok.alias(f"{stage}_ok"))
    reasons = F.filter(F.array(*[differs(k) for k in ("source_sha256", "config_sha256", *STAGES)]), lambda x: x.isNotNull())
    return cached.select("tool", "document", *out, reasons.alias("reasons"))


def plan_from_cache(compat: DataFrame, paid: Column) -> DataFrame:
    """The least work that a pair needs; what would be paid for again is refused."""
    act = F.when(F.col("evaluation_ok"), "reuse_all").when(F.col("normalization_ok"), "evaluate_only").when(F.col("standardization_ok"), "normalize_only").when(F.col("raw_acquisition_ok"), "standardize_only").when(paid, "refuse").otherwise("run_adapter")
    return compat.withColumn("action", act)


def run_integrity(runs: DataFrame, results: DataFrame, expected: DataFrame) -> DataFrame:
    """One row a broken rule: severity, code, tool, document, value.

    runs: tool, document, status, pages, seconds, matched, missing; results: tool, document, object_id, category, score;
    expected: document, object_id, category. Ids are compared by anti-joins both ways.
    """
    issue = lambda df, code, value, severity="error": df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "tool", "document", value.cast("double").alias("value"))
    tools = runs.select("tool", "document").distinct()
    want = tools.join(expected, "document")
    counts = results.groupBy("tool", "document").agg(F.count("*").alias("n"))
    twice = results.groupBy("tool", "document", "object_id").agg(F.count("*").alias("n")).where("n > 1")
    sized = runs.join(counts, ["tool", "document"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    checks = [
        issue(runs.where("status <> 'success' or status is null"), "run_not_successful", F.lit(None)),
        issue(runs.where("pages is null or pages <= 0"), "bad_page_count", F.col("pages")),
        issue(runs.where(~finite(F.col("seconds").cast("double")) | (F.col("seconds") <= 0)), "bad_processing_time", F.col("seconds")),
        issue(sized.where("n <> matched + missing"), "object_count_mismatch", F.col("n")),
        issue(twice, "object_twice", F.col("n")),
        issue(results.where(~finite(F.col("score").cast("double")) | ~F.col("score").between(0, 100)), "score_out_of_range", F.col("score")),
        issue(want.join(results, ["tool", "document", "object_id"], "left_anti"), "object_missing", F.lit(None)),
        issue(results.join(expected.select("document", "object_id"), ["document", "object_id"], "left_anti"), "object_unexpected", F.lit(None)),
        issue(results.join(want.withColumnRenamed("category", "wanted"), ["tool", "document", "object_id"]).where("category <> wanted"), "category_changed", F.lit(None)),
        issue(runs.groupBy("tool", "document").agg(F.count("*").alias("n")).where("n > 1"), "run_twice", F.col("n")),
        issue(sized.where("n > 0").join(results.groupBy("tool", "document").agg(F.max("score").alias("top")), ["tool", "document"]).where("top = 0"), "all_scores_zero", F.col("top"), "warning"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def selected(df: DataFrame, column: str, wanted: list) -> DataFrame:
    """Rows of the wanted ids; an id that no row has fails."""
    ids = df.sparkSession.createDataFrame([(w,) for w in wanted], f"{column} {dict(df.dtypes)[column]}")
    unknown = ids.join(df.select(column).distinct(), column, "left_anti").collect()  # as many as the caller named
    if unknown:
        raise ValueError(f"unknown {column}: " + ", ".join(sorted(str(r[0]) for r in unknown)))
    return df.join(F.broadcast(ids), column, "left_semi")  # as many ids as the caller named


def content_counts(elements: DataFrame, keys: list[str], kind: str) -> DataFrame:
    return elements.groupBy(*keys, kind).agg(F.count("*").alias("n"))


#: What every pair must have written, and the scores that a report names.
ARTIFACTS = ("standardized", "normalized", "matches", "object_evaluation")
ISSUE = ("severity", "code", "tool", "document", "metric", "value")


def validate_runs(tools: DataFrame, documents: DataFrame, manifests: DataFrame, pairs: DataFrame, results: DataFrame, reports: DataFrame, expected: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """All broken rules of the runs of some tools over some documents, one row each: severity, code, tool, document, metric, value.

    tools (tool) and documents (document) are what should be there, expected (document, object_id) the objects of each document.
    manifests: tool, readable, pairs_readable, selected_tools, selected_documents; pairs: tool, document, status, object_count, matched,
    missing, artifacts (array of names), version, raw_files, std_readable, std_document, std_tool, std_pages, evaluation_readable; results: tool, document,
    object_id, score, metrics (map); reports: tool, score_name, score. A tool without a manifest that can be read is looked at no further, nor is a pair
    that is missing or failed. Object ids are compared as sets, by anti-joins both ways; every other rule is a filter or a count.
    """
    none = F.lit(None)

    def issue(df: DataFrame, code: str, metric=none, value=none, severity: str = "error") -> DataFrame:
        document = F.col("document") if "document" in df.columns else none
        return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "tool", document.cast("long").alias("document"), metric.cast("string").alias("metric"), value.cast("double").alias("value"))

    bad = lambda c: ~F.coalesce(finite(c) & c.between(0, 100), F.lit(False))
    read = manifests.where("readable")
    n_documents = documents.agg(F.array_sort(F.collect_list("document"))).first()[0]  # as many as the benchmark's plan names
    grid = read.select("tool", F.explode(F.lit(n_documents)).alias("document"))
    listed = pairs.join(read.where("pairs_readable").select("tool"), "tool", "left_semi")
    there = listed.join(grid, ["tool", "document"], "left_semi")
    ok = there.where("status = 'success'")
    want = expected.groupBy("document").agg(F.count("*").alias("wanted"))
    sized = ok.join(want, "document", "left").withColumn("wanted", F.coalesce("wanted", F.lit(0)))
    lacking = there.where("status = 'success'").select("tool", "document", F.explode(F.array_except(F.lit(list(ARTIFACTS)), F.coalesce("artifacts", F.array().cast("array<string>")))).alias("name"))
    std = ok.where("std_readable")
    scored = results.join(ok.where("evaluation_readable").select("tool", "document"), ["tool", "document"], "left_semi")
    due = ok.where("evaluation_readable").select("tool", "document").join(expected, "document")
    apart = due.join(scored, ["tool", "document", "object_id"], "left_anti").select("tool", "document").unionByName(scored.join(expected, ["document", "object_id"], "left_anti").select("tool", "document")).distinct()
    metrics = scored.select("tool", "document", F.explode("metrics").alias("metric", "value"))
    named = reports.join(read.select("tool"), "tool", "left_semi")
    of_tool = named.select("tool").distinct()
    asked = of_tool.select("tool", F.explode(F.lit([f"{c}_score" for c in categories])).alias("score_name")).join(named, ["tool", "score_name"], "left")
    overall = of_tool.join(named.where("score_name = 'overall_quality_score'").select("tool", "score"), "tool", "left")
    total = scored.groupBy("tool").agg(F.count("*").alias("n")).where(F.col("n") != expected.count())
    found = [
        issue(tools.select("tool").join(manifests, "tool", "left_anti"), "missing_run_manifest"),
        issue(manifests.where("not readable"), "invalid_run_manifest"),
        issue(read.where(~F.coalesce(F.col("selected_tools") == F.array("tool"), F.lit(False))), "wrong_tool_in_run"),
        issue(read.where(~F.coalesce(F.array_sort("selected_documents") == F.lit(n_documents), F.lit(False))), "incomplete_document_selection"),
        issue(read.where("not pairs_readable"), "invalid_pair_results"),
        issue(grid.join(listed, ["tool", "document"], "left_anti"), "missing_pair_result"),
        issue(there.where("status <> 'success' or status is null"), "failed_run"),
        issue(sized.where("object_count is null or object_count <> wanted"), "object_count_mismatch", value=F.col("object_count")),
        issue(sized.where("coalesce(matched, 0) + coalesce(missing, 0) <> wanted"), "match_accounting_mismatch", value=F.coalesce("matched", F.lit(0)) + F.coalesce("missing", F.lit(0))),
        issue(lacking, "missing_pair_artifact", F.col("name")),
        issue(std.where("std_document <> document or std_tool <> tool"), "standardized_identity_mismatch"),
        issue(std.where("std_pages = 0"), "empty_standardized_document"),
        issue(ok.where("not std_readable"), "invalid_standardized_json"),
        issue(apart, "object_id_set_mismatch"),
        issue(scored.where(bad(F.col("score").cast("double"))), "impossible_object_score", value=F.col("score")),
        issue(metrics.where(bad(F.col("value").cast("double"))), "impossible_metric_value", F.col("metric"), F.col("value")),
        issue(ok.where("not evaluation_readable"), "invalid_object_evaluation"),
        issue(ok.where("version is null or version = ''"), "missing_version_snapshot", severity="warning"),
        issue(ok.where("coalesce(raw_files, 0) = 0"), "raw_output_missing"),
        issue(asked.where("score is null"), "missing_category_score", F.col("score_name")),
        issue(asked.where(F.col("score").isNotNull() & bad(F.col("score").cast("double"))), "impossible_category_score", F.col("score_name"), F.col("score")),
        issue(overall.where("score is null"), "missing_overall_score"),
        issue(overall.where(F.col("score").isNotNull() & bad(F.col("score").cast("double"))), "impossible_overall_score", value=F.col("score")),
        issue(read.select("tool").join(of_tool, "tool", "left_anti"), "invalid_evaluation_report"),
        issue(total, "tool_total_object_count_mismatch", value=F.col("n")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def run_status(tools: DataFrame, issues: DataFrame) -> DataFrame:
    """tool, status (clean without errors, else corrupt), errors, warnings."""
    n = issues.groupBy("tool").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = tools.select("tool").join(n, "tool", "left").fillna(0, ["errors", "warnings"])
    return out.select("tool", F.when(F.col("errors") == 0, "clean").otherwise("corrupt").alias("status"), "errors", "warnings")
