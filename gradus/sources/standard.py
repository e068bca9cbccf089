"""Standardized documents: whole nested JSON under a schema that is checked, and their pages' elements as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions import boxes as B
from gradus.functions import metrics as M

#: The format's fields, and what fields of choice may hold.
BOX = "struct<x_min: double, y_min: double, x_max: double, y_max: double>"
_OWN = f"element_id: string, page_number: int, bbox: {BOX}, confidence: double, order_index: int, provenance: map<string, string>"
_CAPTION = f"caption: struct<text: string, normalized_text: string, bbox: {BOX}>"
KINDS = {
    "text_blocks": ("text", "raw_text: string, normalized_text: string, block_type: string"),
    "tables": ("table", f"rows: int, columns: int, html: string, {_CAPTION}, cells: array<struct<row_index: int, column_index: int, row_span: int, column_span: int, text: string, normalized_text: string, is_header: boolean, bbox: {BOX}>>"),
    "formulas": ("formula", "raw_text: string, latex: string, normalized_latex: string, plain_text: string, formula_type: string"),
    "chemical_objects": ("chemical", "subtype: string, raw_formula: string, normalized_formula: string, text_labels: array<string>, asset_path: string"),
    "images": ("image", f"asset_path: string, extraction_success: boolean, {_CAPTION}"),
    "diagrams": ("diagram", f"diagram_type: string, asset_path: string, text_elements: array<string>, key_elements: array<string>, {_CAPTION}"),
}
CHOICES = {
    "text_blocks": ("block_type", ("paragraph", "heading", "list_item", "caption", "header", "footer", "unknown")),
    "formulas": ("formula_type", ("inline", "display", "unknown")),
    "chemical_objects": ("subtype", ("linear_formula", "structure")),
    "diagrams": ("diagram_type", ("chart", "electrical_scheme", "neural_network", "flowchart", "scientific_scheme", "unknown")),
}
PAGE = "page_number: int, width: double, height: double, " + ", ".join(f"{k}: array<struct<{_OWN}, {fields}>>" for k, (_, fields) in KINDS.items()) + ", reading_order: array<string>"
DOCUMENT = f"schema_version string, document_id string, source_pdf string, tool struct<tool_name: string, distribution_name: string, version: string>, pages array<struct<{PAGE}>>, raw_artifacts array<string>"


def _outside(b: Column) -> Column:
    """Whether a box lacks a side or leaves the page; false without a box."""
    return b.isNotNull() & ~F.coalesce(reduce(lambda x, y: x & y, [b[s].between(0, 1) for s in ("x_min", "y_min", "x_max", "y_max")]), F.lit(False))


def _any(items: Column, test) -> Column:
    return F.coalesce(F.exists(items, test), F.lit(False))


def _elements(test) -> Column:
    """Whether any element of any page, by its kind, fails a test."""
    of = lambda k: lambda e: F.coalesce(test(k, e), F.lit(False))
    return _any(F.col("d.pages"), lambda p: reduce(lambda a, b: a | b, [_any(p[k], of(k)) for k in KINDS]))


def parse(texts: DataFrame, text: str, name: str) -> DataFrame:
    """name, d (a DOCUMENT struct) and reasons (texts): what keeps a document from being one; empty for a good one.

    A text that isn't JSON, or holds a field of another type, is one of another form; its fields are null where they couldn't be read.
    Each text is parsed once, however many rules and filters read what it holds.
    """
    bad = "_bad"
    form = DOCUMENT + f", {bad} string"
    rows = M.kept(texts.select(F.col(name).alias("name"), F.col(text).alias("_text")), d=F.from_json("_text", form, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})).drop("_text")
    choice = lambda k, e: ~e[CHOICES[k][0]].isin(*CHOICES[k][1]) if k in CHOICES else F.lit(False)
    cell = lambda c: (c["row_index"].isNull() | (c["row_index"] < 0) | c["column_index"].isNull() | (c["column_index"] < 0) | (F.coalesce(c["row_span"], F.lit(1)) < 1) | (F.coalesce(c["column_span"], F.lit(1)) < 1))
    rules = {
        "not a document's JSON": F.col("d").isNull() | F.col(f"d.{bad}").isNotNull(),
        "a name is missing": F.col("d.document_id").isNull() | F.col("d.source_pdf").isNull() | F.col("d.tool.tool_name").isNull() | F.col("d.tool.distribution_name").isNull(),
        "a page without number or size": _any(F.col("d.pages"), lambda p: ~F.coalesce((p["page_number"] >= 1) & (p["width"] > 0) & (p["height"] > 0), F.lit(False))),
        "an element without id or page": _elements(lambda k, e: e["element_id"].isNull() | ~F.coalesce(e["page_number"] >= 1, F.lit(False))),
        "a box outside its page": _elements(lambda k, e: _outside(e["bbox"])) | _any(F.col("d.pages"), lambda p: _any(p["tables"], lambda t: _any(t["cells"], lambda c: _outside(c["bbox"])))),
        "a confidence outside 0 to 1": _elements(lambda k, e: ~e["confidence"].between(0, 1)),
        "an unknown choice": _elements(choice) | _any(F.col("d.pages"), lambda p: _any(p["chemical_objects"], lambda e: e["subtype"].isNull())),
        "a cell without place": _any(F.col("d.pages"), lambda p: _any(p["tables"], lambda t: _any(t["cells"], cell))),
    }
    reasons = F.filter(F.array(*[F.when(test, F.lit(why)) for why, test in rules.items()]), lambda r: r.isNotNull())
    return M.kept(rows, reasons=reasons).select("name", "d", "reasons")


def read_standardized(spark: SparkSession, path: str) -> DataFrame:
    """parse() of whole files below a path, name being the file's; a bad file is a row with its reasons, and the rest is read."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return parse(files.select(F.col("_metadata.file_path").alias("file"), "value"), "value", "file")


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("reasons") == 0).select("d.*").drop("_bad")


def issues(parsed: DataFrame) -> DataFrame:
    """(name, reason): a row for each reason of a bad document."""
    return parsed.select("name", F.explode("reasons").alias("reason"))


def pages(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("document_id").alias("document"), F.explode("pages").alias("p")).select("document", F.col("p.page_number").alias("page"), "p.width", "p.height", F.coalesce("p.reading_order", F.array().cast("array<string>")).alias("reading_order"))


def elements(documents: DataFrame) -> DataFrame:
    """Elements of all pages: document, page, kind, element_id, order_index, box and payload, a map of texts in which lists are JSON."""
    each = documents.select(F.col("document_id").alias("document"), F.explode("pages").alias("p"))

    def payload(e: Column, fields: str) -> Column:
        top, depth = [""], 0
        for c in fields:  # names of the outermost fields
            depth += (c == "<") - (c == ">")
            if c == "," and depth == 0:
                top.append("")
            else:
                top[-1] += c
        pairs = []
        for name, kind in (f.strip().split(": ", 1) for f in top):
            value = e[name]["text"] if name == "caption" else F.to_json(e[name]) if kind.startswith("array") else e[name].cast("string")
            pairs += [F.lit(name), value]
        return F.create_map(*pairs)

    b = lambda e: F.when(e["bbox"].isNotNull(), B.box(e["bbox"]["x_min"], e["bbox"]["y_min"], e["bbox"]["x_max"], e["bbox"]["y_max"]))
    row = lambda kind, fields: lambda e: F.struct(F.lit(kind).alias("kind"), e["element_id"].alias("element_id"), e["order_index"].alias("order_index"), b(e).alias("box"), payload(e, fields).alias("payload"))
    none = F.array().cast("array<struct<kind: string, element_id: string, order_index: int, box: struct<x0: double, y0: double, x1: double, y1: double>, payload: map<string, string>>>")
    made = [F.coalesce(F.transform(F.col("p")[k], row(*own)), none) for k, own in KINDS.items()]
    return each.select("document", F.col("p.page_number").alias("page"), F.explode(F.concat(*made)).alias("e")).select("document", "page", "e.*")
