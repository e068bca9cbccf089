"""File sources and sinks of the evaluation: strict JSON lines, delimited tables, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

GROUND_TRUTH = "object_id string, document_id string, page int, object_type string, bbox array<double>, reference map<string,string>"


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Objects from JSON lines; a bad line fails the read, an object_id held twice fails the query."""
    rows = spark.read.schema(GROUND_TRUTH).json(path, mode="FAILFAST")
    twice = rows.groupBy("object_id").count().where("count > 1").limit(1)
    guard = twice.select(F.raise_error(F.concat(F.lit("object_id twice: "), "object_id")).cast("string").alias("object_id"))
    return rows.join(guard, "object_id", "left_anti")


def _objects(spark: SparkSession, path: str, loose: bool) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    strict = {"mode": "FAILFAST"}
    many = f"array<struct<{GROUND_TRUTH}>>"
    inner = F.get_json_object("value", "$.objects")
    one = F.array(F.from_json("value", f"struct<{GROUND_TRUTH}>", strict))
    other = F.from_json(F.lit("[]"), many) if loose else F.when(F.get_json_object("value", "$.object_id").isNotNull(), one).otherwise(F.raise_error(F.concat(F.lit("no objects in "), F.input_file_name())).cast(many))
    rows = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", many, strict)).when(inner.rlike(r"^\["), F.from_json(inner, many, strict)).otherwise(other)
    return files.select(F.explode(rows).alias("o")).select("o.*")


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """Objects of whole JSON files, each a list, a list under `objects`, or a single object; a file of another form fails the read."""
    return _objects(spark, path, loose=False)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a manifest, a list or a list under `objects`; an object without that key holds none."""
    return _objects(spark, path, loose=True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table with a header, all columns text, a byte order mark left out."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, as delimited files need."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """Each table of a report as Parquet, as JSON lines and as delimited text."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        df.write.mode("overwrite").json(f"{path}/{name}.jsonl")
        flat(df).write.mode("overwrite").csv(f"{path}/{name}.csv", header=True)


def write_clean(tools: DataFrame, pairs: DataFrame, objects: DataFrame, issues: DataFrame, expected_tools: int, path: str) -> None:
    """Raw and clean tool rows, pairs, objects and issues as delimited text, and a summary of one row.

    A tool with an issue of severity error isn't clean. The summary's status is clean if all expected tools are and no
    issue is an error, else needs_attention.
    """
    bad = issues.where("severity = 'error' and tool is not null").select("tool").distinct()
    clean = tools.join(bad, "tool", "left_anti").select(*tools.columns)
    for name, df in {"raw_results_dataset": tools, "clean_results_dataset": clean, "pair_operational_dataset": pairs, "object_results_dataset": objects, "quality_issues": issues}.items():
        flat(df).write.mode("overwrite").csv(f"{path}/{name}.csv", header=True)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    found = issues.agg(F.count_if(F.col("severity") == "error").alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"))
    rows = [count(tools, "raw_tool_rows"), count(pairs, "pair_rows"), count(objects, "object_rows"), found, bad.agg(F.array_sort(F.collect_set("tool")).alias("excluded_tools"))]
    summary = clean.agg(F.count("*").alias("clean_tool_rows"), F.array_sort(F.collect_set("tool")).alias("clean_tools"))
    for r in rows:  # each of them is one row
        summary = summary.crossJoin(r)
    fine = (F.col("clean_tool_rows") == expected_tools) & (F.col("error_count") == 0)
    summary.withColumn("status", F.when(fine, "clean").otherwise("needs_attention")).coalesce(1).write.mode("overwrite").json(f"{path}/data_quality_summary.json")


SECRET_KEYS = r"(?i).*(secret|token|credential|api_?key|password).*"


def public(details: str):
    """A map column without secret keys, absolute paths cut to their last part."""
    kept = F.map_filter(details, lambda k, v: ~k.rlike(SECRET_KEYS))
    return F.transform_values(kept, lambda k, v: F.when(v.rlike(r"^(/|[A-Za-z]:[\\/])"), F.regexp_extract(v, r"([^\\/]+)[\\/]?$", 1)).otherwise(v))
