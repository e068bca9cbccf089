"""Scores of one extracted object against its reference, by type, as columns. Null is not applicable; 0 is missed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gradus.functions import metrics as M
from gradus.functions import text as T

#: What each part weighs in the score of a type.
TEXT = {"cer_score": 0.40, "wer_score": 0.30, "edit_similarity": 0.10, "reading_order": 0.20}
MATH = {"raw_exact_match": 0.05, "normalized_exact_match": 0.35, "token_f1": 0.40, "edit_similarity": 0.20}
FORMULA = {"normalized_exact_match": 0.35, "token_f1": 0.30, "edit_similarity": 0.20, "composition_similarity": 0.15}
STRUCTURE = {"detection": 0.30, "iou": 0.25, "label_f1": 0.25, "extraction": 0.20}
TABLE = {"cell_f1": 0.30, "cell_content": 0.25, "structure": 0.20, "teds_like": 0.25}
IMAGE = {"detection": 0.30, "iou": 0.25, "extraction": 0.25, "caption": 0.20}
DIAGRAM = {"detection": 0.20, "iou": 0.15, "diagram_text_f1": 0.25, "caption": 0.15, "key_elements": 0.25}
#: The categories in their order, and category and subtype of each object type.
CATEGORIES = ("text", "table", "math", "chemistry", "image", "diagram")
KINDS = {"text": ("text", None), "table": ("table", None), "math_formula": ("math", None), "chemical_formula": ("chemistry", "linear_formula"), "chemical_structure": ("chemistry", "structure"), "image": ("image", None), "diagram": ("diagram", None)}

CELL = "struct<row: int, col: int, rowspan: int, colspan: int, header: boolean, text: string>"
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
PAYLOAD = (
    f"struct<text: string, reading_order: array<string>, rows: int, columns: int, cells: array<{CELL}>, latex: string, normalized_latex: string, formula: string, "
    f"box: {BOX}, labels: array<string>, extracted: boolean, caption: string, text_elements: array<string>, key_elements: array<string>, subfigures: int>"
)
CONTEXT = "struct<policy: string, tp: int, fp: int, fn: int>"


def _score(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    return M.weighted_mean([(w, parts[k]) for k, w in weights.items()])


def _f(flag: Column) -> Column:
    return F.when(flag, 1.0).otherwise(0.0)


def _prf(prefix: str, x: Column) -> dict[str, Column]:
    return {f"{prefix}_precision": x["precision"], f"{prefix}_recall": x["recall"], f"{prefix}_f1": x["f1"]}


def words(values: Column) -> Column:
    """Normalized tokens of all values of an array, in order."""
    return T.word_tokens(T.norm_text(F.concat_ws(" ", values), paragraphs=False))


def distinct_or_fail(values: Column, message: str) -> Column:
    return M.let(lambda x: F.when(F.size(F.array_distinct(x["v"])) == F.size(x["v"]), x["v"]).when(x["v"].isNotNull(), F.raise_error(F.lit(message)).cast("array<string>")), v=values)


def reading_order(reference: Column, predicted: Column) -> Column:
    """struct(coverage, pair_order, score): share of the reference ids that are there, share of their pairs in the right order, and the product; null without a reference order."""

    def body(v):
        n = F.size(v["at"])
        right = F.aggregate(F.transform(v["at"], lambda p, i: F.size(F.filter(F.slice(v["at"], i + 2, n), lambda q: q > p))), F.lit(0), lambda s, x: s + x)
        coverage = F.when(v["n"] == 0, _f(v["m"] == 0)).otherwise(F.try_divide(n.cast("double"), v["n"]))
        order = F.when(n < 2, 1.0).otherwise(F.try_divide(2.0 * right, n * (n - 1)))
        return F.when(v["n"] >= 0, F.struct(coverage.alias("coverage"), order.alias("pair_order")))

    def places(v):
        at = F.filter(F.transform(v["a"], lambda x: F.array_position(v["b"], x)), lambda p: p > 0)
        return F.struct(at.alias("at"), F.size(v["a"]).alias("n"), F.size(v["b"]).alias("m"))

    ref, pred = (distinct_or_fail(c, "an id twice in a reading order") for c in (reference, F.coalesce(predicted, F.array().cast("array<string>"))))
    both = M.let(lambda v: body(v["x"]), x=M.let(places, a=ref, b=pred))
    return M.let(lambda v: F.when(v["x"].isNotNull(), F.struct(v["x"]["coverage"].alias("coverage"), v["x"]["pair_order"].alias("pair_order"), (v["x"]["coverage"] * v["x"]["pair_order"]).alias("score"))), x=both)


def text_forms(reference: Column, predicted: Column) -> tuple[Column, Column]:
    return T.norm_text(F.coalesce(reference, F.lit(""))), T.norm_text(F.coalesce(predicted, F.lit("")))


def text_parts(reference: Column, predicted: Column, reference_order: Column, predicted_order: Column, forms: tuple[Column, Column] | None = None) -> dict[str, Column]:
    a, b = forms or text_forms(reference, predicted)
    x, y = T.word_tokens(a), T.word_tokens(b)
    cer = M.error_rate(M.distance(a, b), F.length(a), F.length(b))
    wer = M.error_rate(M.token_distance(x, y), F.size(x), F.size(y))
    order = reading_order(reference_order, predicted_order)
    parts = {"cer": cer, "cer_score": M.clamp01(1 - cer), "wer": wer, "wer_score": M.clamp01(1 - wer), "edit_similarity": M.edit_similarity(a, b), "reading_order_coverage": order["coverage"], "reading_order_pair_order": order["pair_order"], "reading_order": order["score"]}
    return parts | {"text_score": _score(parts, TEXT)}


def math_parts(reference: Column, predicted: Column, reference_form: Column | None = None, predicted_form: Column | None = None, worked_out: bool = False) -> dict[str, Column]:
    """Raw and normal forms, tokens and edits of LaTeX; a normal form that is given wins over the computed one (worked_out: it is never missing)."""
    a, b = F.coalesce(reference, F.lit("")), F.coalesce(predicted, F.lit(""))
    x = T.norm_latex(a) if reference_form is None else F.coalesce(reference_form, T.norm_latex(a)) if not worked_out else reference_form
    y = T.norm_latex(b) if predicted_form is None else F.coalesce(predicted_form, T.norm_latex(b)) if not worked_out else predicted_form
    parts = {"raw_exact_match": _f(a == b), "normalized_exact_match": _f(x == y), **_prf("token", M.multiset_prf(T.latex_tokens(x), T.latex_tokens(y))), "edit_similarity": M.edit_similarity(x, y)}
    return parts | {"math_score": _score(parts, MATH)}


def formula_forms(reference: Column, predicted: Column) -> tuple[Column, Column]:
    return T.norm_chem(F.coalesce(reference, F.lit(""))), T.norm_chem(F.coalesce(predicted, F.lit("")))


def formula_parts(reference: Column, predicted: Column, forms: tuple[Column, Column] | None = None) -> dict[str, Column]:
    a, b = forms or formula_forms(reference, predicted)
    alike = F.when((a == "") & (b == ""), 1.0).otherwise(M.composition_similarity(T.composition(a), T.composition(b)))
    parts = {"normalized_exact_match": _f(a == b), **_prf("token", M.multiset_prf(T.chem_tokens(a), T.chem_tokens(b))), "edit_similarity": M.edit_similarity(a, b), "composition_similarity": alike}
    return parts | {"chem_linear_score": _score(parts, FORMULA)}


def structure_parts(reference_box: Column, predicted_box: Column, reference_labels: Column, predicted_labels: Column, there: Column, extracted: Column) -> dict[str, Column]:
    """A structure's place and labels; the quality of what was extracted is null for one that was missed."""
    labels = F.when(there, F.coalesce(predicted_labels, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    parts = {"detection": _f(there), "iou": F.when(there, M.box_iou(reference_box, predicted_box)).otherwise(0.0), **_prf("label", M.multiset_prf(words(F.coalesce(reference_labels, F.array().cast("array<string>"))), words(labels))), "extraction": _f(there & F.coalesce(extracted, F.lit(False)))}
    parts["structured_extraction"] = F.when(there, _score(parts, {k: w for k, w in STRUCTURE.items() if k != "detection"}))
    return parts | {"chem_structure_score": _score(parts, STRUCTURE)}


def detection(tp: Column, fp: Column, fn: Column) -> Column:
    """struct(precision, recall, f1) of counts on a page."""
    return M.prf(tp, tp + fp, tp + fn)


def detection_by_policy(context: Column, there: Column) -> tuple[Column, Column, Column]:
    """Detection score, whether it is the page's F1, and the name of the policy.

    F1 where the policy asks for exhaustive pages, or where counts come without a policy; else whether the object is there.
    """
    counted = context["tp"].isNotNull() & context["fp"].isNotNull() & context["fn"].isNotNull()
    whole = F.coalesce(counted & (context["policy"].isNull() | (context["policy"] == "exhaustive_page_f1_v1")), F.lit(False))
    name = F.coalesce(context["policy"], F.when(F.coalesce(counted, F.lit(False)), "legacy_exhaustive_page_f1").otherwise("object_presence_recall"))
    return F.when(whole, detection(context["tp"], context["fp"], context["fn"])["f1"]).otherwise(_f(there)), whole, name


def caption_forms(reference: Column, predicted: Column) -> tuple[Column, Column]:
    return T.norm_caption(reference), T.norm_caption(F.coalesce(predicted, F.lit("")))


def caption_parts(reference: Column, predicted: Column, forms: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """Tokens and edits of captions; all null where the reference has none."""
    a, b = forms or caption_forms(reference, predicted)
    own = lambda c: F.when(reference.isNotNull(), c)
    f = M.multiset_prf(T.word_tokens(a), T.word_tokens(b))
    edit = M.edit_similarity(a, b)
    return {f"caption_{k}": own(v) for k, v in _prf("token", f).items()} | {"caption_edit_similarity": own(edit), "caption": own((f["f1"] + edit) / 2)}


def image_parts(reference_box: Column, predicted_box: Column, reference_caption: Column, predicted_caption: Column, there: Column, extracted: Column, found: Column | None = None, forms: tuple[Column, Column] | None = None) -> dict[str, Column]:
    found = _f(there) if found is None else found
    parts = {"detection": found, "iou": F.when(there, M.box_iou(reference_box, predicted_box)).otherwise(0.0), "extraction": _f(there & F.coalesce(extracted, F.lit(False))), **caption_parts(reference_caption, F.when(there, predicted_caption), forms)}
    return parts | {"image_score": _score(parts, IMAGE)}


def elements(values: Column) -> Column:
    """Each value of an array in its normal form; empty ones don't count."""
    joined = F.array_join(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.regexp_replace(v, r"\s+", " ")), "\n\n")
    return F.filter(F.split(T.norm_text(joined), "\n\n"), lambda v: v != "")


def diagram_parts(reference: Column, predicted: Column, there: Column, found: Column | None = None, forms: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """Of payload structs: place, texts, caption, key elements and the number of subfigures."""
    none = F.array().cast("array<string>")
    own = lambda k: F.when(there, F.coalesce(predicted[k], none)).otherwise(none)
    found = _f(there) if found is None else found
    want, have = elements(reference["key_elements"]), elements(own("key_elements"))
    recall = F.when(F.size(want) > 0, M.multiset_overlap(want, have).cast("double") / F.size(want))
    n, m = F.coalesce(reference["subfigures"], F.lit(0)), F.when(there, F.coalesce(predicted["subfigures"], F.lit(0))).otherwise(0)
    figures = F.when(n > 0, count_similarity(n, m))
    parts = {"detection": found, "iou": F.when(there, M.box_iou(reference["box"], predicted["box"])).otherwise(0.0), **_prf("diagram_text", M.multiset_prf(words(F.coalesce(reference["text_elements"], none)), words(own("text_elements"))))}
    parts |= {**caption_parts(reference["caption"], F.when(there, predicted["caption"]), forms), "element_recall": recall, "subfigure_score": figures, "key_elements": M.weighted_mean([(1.0, recall), (1.0, figures)])}
    return parts | {"diagram_score": _score(parts, DIAGRAM)}


def count_similarity(n: Column, m: Column) -> Column:
    return 1.0 - F.abs(n - m) / F.greatest(n, m, F.lit(1))


def cell_keys(cells: Column) -> Column:
    """Places and spans of a table's cells; two cells of one place and span fail."""
    keys = F.transform(F.coalesce(cells, F.array().cast(f"array<{CELL}>")), lambda c: F.concat_ws(":", c["row"], c["col"], c["rowspan"], c["colspan"]))
    return distinct_or_fail(keys, "two table cells of one place and span")


def merged_keys(cells: Column) -> Column:
    return cell_keys(F.filter(cells, lambda c: (c["rowspan"] > 1) | (c["colspan"] > 1)))


def table_tokens(rows: int, cells: list) -> list:
    """A table as a sequence of marks and texts: rows, and in them cells by column with header mark and spans."""
    marks = [((r, (end,)), ("row", end > 0)) for r in range(rows or 0) for end in (-1, float("inf"))]
    for c in cells:
        if c["row"] < (rows or 0):
            at, head = (c["col"], c["rowspan"], c["colspan"]), bool(c["header"])
            marks += [((c["row"], (*at, 0)), ("cell", head, *at)), ((c["row"], (*at, 1)), c["text"]), ((c["row"], (*at, 2)), ("end", head))]
    return ["table", *(m for _, m in sorted(marks, key=lambda x: x[0])), "end"]


def similar(a, b) -> float:
    return 1.0 if not a and not b else 1 - M.edit_distance(a, b) / max(len(a), len(b))


@F.pandas_udf(StructType([StructField("content", DoubleType()), StructField("teds", DoubleType())]))
def table_texts(rows: pd.Series, cells: pd.Series, predicted_rows: pd.Series, predicted_cells: pd.Series) -> pd.DataFrame:
    """Mean likeness of the reference's cells with what lies at their place, and of both tables as sequences of tokens."""

    def one(n, a, m, b):
        if a is None:
            return None, None
        a, b = ([{**c, "text": T.text_form(c["text"])} for c in (x if x is not None else ())] for x in (a, b))
        place = lambda c: (c["row"], c["col"], c["rowspan"], c["colspan"])
        there = {place(c): c["text"] for c in b}
        content = sum(similar(c["text"], there.get(place(c), "")) for c in a) / len(a) if a else float(not b)
        whole = lambda v: 0 if v is None or v != v else int(v)
        return content, similar(table_tokens(whole(n), a), table_tokens(whole(m), b))

    return pd.DataFrame([one(*x) for x in zip(rows, cells, predicted_rows, predicted_cells)], columns=["content", "teds"], dtype=float)


def table_parts(rows: Column, columns: Column, cells: Column, predicted_rows: Column, predicted_columns: Column, predicted_cells: Column) -> dict[str, Column]:
    none = F.array().cast(f"array<{CELL}>")
    cells = F.when(rows.isNotNull() | cells.isNotNull(), F.coalesce(cells, none))  # null for what isn't a table
    other = F.coalesce(predicted_cells, none)
    texts = table_texts(rows, cells, predicted_rows, other)
    own = lambda c: F.when(cells.isNotNull(), c)
    sizes = {k: own(count_similarity(F.coalesce(n, F.lit(0)), F.coalesce(m, F.lit(0)))) for k, n, m in (("row_structure", rows, predicted_rows), ("column_structure", columns, predicted_columns))}
    parts = {k: own(v) for k, v in (_prf("cell", M.set_prf(cell_keys(cells), cell_keys(other))) | _prf("merged", M.set_prf(merged_keys(cells), merged_keys(other)))).items()}
    parts |= sizes | {"cell_content": texts["content"], "teds_like": texts["teds"]}
    parts["structure"] = (parts["row_structure"] + parts["column_structure"] + parts["merged_f1"]) / 3
    return parts | {"table_score": _score(parts, TABLE)}


def evaluate_objects(matches: DataFrame) -> DataFrame:
    """One row an object: its keys, category, subtype, matched, object_score of 0 to 100, policy, and metrics by name.

    matches holds object_type, reference and prediction (PAYLOAD structs; null for what was not found) and context
    (CONTEXT). An object without prediction scores exactly 0 whatever its parts; these stay for diagnosis. An unknown
    type fails. Kernels see null for rows of other types. Normal forms, then all metrics, are worked out once a row.
    """
    kind = F.col("object_type")
    known = F.create_map(*[F.lit(x) for k, (c, _) in KINDS.items() for x in (k, c)])[kind]
    r, p, context = F.col("reference"), F.col("prediction"), F.col("context")
    there = p.isNotNull()
    of = lambda types, x: F.when(kind.isin(*types), x)
    pair = lambda t, k: (of([t], r[k]), of([t], p[k]))
    latex = [T.norm_latex(F.coalesce(x, F.lit(""))) for x in pair("math_formula", "latex")]
    made = {
        "text": text_forms(*pair("text", "text")), "math": [F.coalesce(x, y) for x, y in zip(pair("math_formula", "normalized_latex"), latex)], "formula": formula_forms(*pair("chemical_formula", "formula")),
        "image": caption_forms(*pair("image", "caption")), "diagram": caption_forms(*pair("diagram", "caption")),
    }
    held = M.kept(matches, **{f"_{k}{i}": of([t], x) for k, t in zip(made, ("text", "math_formula", "chemical_formula", "image", "diagram")) for i, x in enumerate(made[k])})
    forms = {k: (F.col(f"_{k}0"), F.col(f"_{k}1")) for k in made}
    found, whole, policy = detection_by_policy(context, there)
    formula = formula_parts(*pair("chemical_formula", "formula"), forms["formula"])
    formula |= {"detection": _f(there), "structured_extraction": F.when(there, formula["chem_linear_score"])}
    image = image_parts(*pair("image", "box"), *pair("image", "caption"), there, p["extracted"], found, forms["image"])
    diagram = diagram_parts(of(["diagram"], r), of(["diagram"], p), there, found, forms["diagram"])
    for parts in (image, diagram):
        score = parts.pop("detection")
        parts |= {"detection_f1": F.when(whole, score), "detection_recall": F.when(~whole, score), "detection_score": score}
    by = {
        "text": (text_parts(*(of(["text"], x) for x in (r["text"], p["text"], r["reading_order"], p["reading_order"])), forms["text"]), "text_score"),
        "table": (table_parts(*(of(["table"], x[k]) for x in (r, p) for k in ("rows", "columns", "cells"))), "table_score"),
        "math_formula": (math_parts(*pair("math_formula", "latex"), *forms["math"], worked_out=True), "math_score"),
        "chemical_formula": (formula, "chem_linear_score"),
        "chemical_structure": (structure_parts(r["box"], p["box"], *pair("chemical_structure", "labels"), there, p["extracted"]), "chem_structure_score"),
        "image": (image, "image_score"),
        "diagram": (diagram, "diagram_score"),
    }
    metrics = None
    for t, (parts, _) in by.items():
        entry = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v.cast("double"))])
        metrics = F.when(kind == t, entry) if metrics is None else metrics.when(kind == t, entry)
    keep = [c for c in matches.columns if c not in ("reference", "prediction", "context")]
    out = M.kept(held, metrics=metrics)
    out = out.select(*keep, F.coalesce(known, F.raise_error(F.concat(F.lit("unknown object type: "), kind)).cast("string")).alias("category"), F.create_map(*[F.lit(x) for k, (_, s) in KINDS.items() if s for x in (k, s)])[kind].alias("subtype"), there.alias("matched"), F.when(kind.isin("image", "diagram"), policy).alias("policy"), "metrics")
    score = F.col("metrics")[F.create_map(*[F.lit(x) for t, (_, main) in by.items() for x in (t, main)])[kind]]
    return out.withColumn("object_score", F.when(F.col("matched"), 100.0 * score).otherwise(0.0))


def metric_records(objects: DataFrame) -> DataFrame:
    """Long form of evaluate_objects: one row a metric with raw_value and metric_value, 0 to 100 and higher is better.

    Nulls and names that end with _score give none; error rates keep their raw value beside the quality made of it.
    """
    keep = [c for c in objects.columns if c not in ("metrics", "object_score", "policy")]
    rows = objects.select(*keep, "metrics", F.explode("metrics").alias("metric_name", "raw_value")).where(F.col("raw_value").isNotNull() & ~F.col("metric_name").endswith("_score"))
    rate = F.col("metric_name").isin("cer", "wer")
    quality = F.when(rate, F.col("metrics")[F.concat("metric_name", F.lit("_score"))]).otherwise(F.col("raw_value"))
    return rows.select(*keep, "metric_name", "raw_value", (100 * M.clamp01(quality)).alias("metric_value"), (~rate).alias("higher_is_better"))
