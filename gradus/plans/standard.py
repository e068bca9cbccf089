"""Registered queries of standardized documents and of layout output, made from the documents' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.plans import views as V
from gradus.plans.registry import query, rounded
from gradus.sources import layouts as L
from gradus.sources import standard as S


def _standardized(spark, sf_dir):
    """Each document as JSON: its paragraphs as blocks of one page; some are cut off, miss a name, or have a bad box or type."""
    d, k = V.table(spark, sf_dir, "documents"), F.col("doc_id") % 20
    box = F.struct(F.lit(0.1).alias("x_min"), F.lit(0.1).alias("y_min"), F.when(k == 1, 1.5).otherwise(0.9).alias("x_max"), F.lit(0.2).alias("y_max"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    block = F.transform(lines, lambda t, i: F.struct(F.concat(F.lit("b"), i).alias("element_id"), F.lit(1).alias("page_number"), box.alias("bbox"), t.alias("raw_text"), F.when(k == 2, "poem").otherwise("paragraph").alias("block_type"), i.alias("order_index")))
    page = F.struct(F.when(k == 3, 0).otherwise(1).alias("page_number"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), block.alias("text_blocks"))
    tool = F.struct(F.lit("t").alias("tool_name"), F.lit("d").alias("distribution_name"))
    text = F.to_json(F.struct(F.when(k != 4, F.col("doc_id").cast("string")).alias("document_id"), F.lit("x.pdf").alias("source_pdf"), tool.alias("tool"), F.array(page).alias("pages")))
    text = F.when(k == 5, F.substring(text, 1, 40)).when(k == 6, F.regexp_replace(text, '"width":100.0', '"width":"wide"')).otherwise(text)
    return S.parse(d.select("doc_id", text.alias("json")), "json", "doc_id")


@query("""SELECT doc_id, CASE doc_id % 20 WHEN 1 THEN 'a box outside its page' WHEN 2 THEN 'an unknown choice' WHEN 3 THEN 'a page without number or size' WHEN 4 THEN 'a name is missing' ELSE 'not a document''s JSON' END AS reason,
    NULL::BIGINT AS n_blocks, NULL AS digest FROM documents WHERE doc_id % 20 BETWEEN 1 AND 6
    UNION ALL SELECT doc_id, NULL, len(string_split(coalesce(text, ''), chr(10))), md5(coalesce(text, '')) FROM documents WHERE doc_id % 20 NOT BETWEEN 1 AND 6""")
def src_std(spark, sf_dir):
    """Documents read under the schema: the blocks of good ones, the first reason of each bad one."""
    parsed = _standardized(spark, sf_dir)
    bad = S.issues(parsed).groupBy(F.col("name").alias("doc_id")).agg(F.min_by("reason", F.when(F.col("reason") == "not a document's JSON", 0).otherwise(1)).alias("reason"))
    e = S.elements(S.good(parsed)).groupBy(F.col("document").cast("long").alias("doc_id")).agg(F.count("*").alias("n_blocks"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", F.col("payload")["raw_text"].alias("t")))), lambda x: x["t"]), "\n")).alias("digest"))
    return bad.select("doc_id", "reason", F.lit(None).cast("long").alias("n_blocks"), F.lit(None).cast("string").alias("digest")).unionByName(e.select("doc_id", F.lit(None).cast("string").alias("reason"), "n_blocks", "digest"))


def layout_json(spark, sf_dir):
    """Each document as a parser's output: a box for every three lines, and the lines behind it; some boxes say more than their lines, some
    documents name the parents, and a line of every fourth box lies outside it."""
    d, k = V.table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: F.trim(t) != "")
    n = F.size(lines)

    def group(g):
        three = F.slice(lines, g * 3 + 1, 3)
        up = 1000.0 - g.cast("double") * 7 % 900
        at = lambda y, h: F.concat_ws("", F.lit("["), F.concat_ws(",", F.lit("10"), y.cast("string"), F.lit("90"), (y + h).cast("string")), F.lit("]"))
        named = lambda p: F.when(k == 1, F.map_from_arrays(F.array(F.lit("parent_text_index")), F.array(p))).otherwise(F.create_map().cast("map<string,string>"))
        own = F.concat(F.array_join(three, " \n"), F.when((k == 2) & (g % 2 == 0), " and more").otherwise(""))
        head = F.map_concat(F.create_map(F.lit("text"), own, F.lit("bbox"), at(up, F.lit(5.0)), F.lit("layout_type"), F.lit("LTTextBoxHorizontal")), named(F.lit(None).cast("string")))
        rest = F.transform(three, lambda t, i: F.map_concat(F.create_map(F.lit("text"), t, F.lit("bbox"), at(F.when((k == 3) & (g % 4 == 0) & (i == 1), up - 3).otherwise(up + i), F.lit(1.0)), F.lit("layout_type"), F.lit("LTTextLineHorizontal")), named((g * 4).cast("string"))))
        return F.concat(F.array(head), rest)

    blocks = F.flatten(F.transform(F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / 3).cast("int"))).otherwise(F.array().cast("array<int>")), group))
    strings = lambda **v: F.create_map(*[x for a, b in v.items() for x in (F.lit(a), F.lit(b))])
    page = F.struct(F.lit(1).alias("page_number"), F.lit(100.0).alias("width"), F.lit(1010.0).alias("height"), blocks.alias("text_blocks"), F.array(strings(name="i", bbox="[1,2,30,40]")).alias("images"), F.array(strings(name="f", vector_count="3")).alias("figures"))
    return d.select("doc_id", F.to_json(F.struct(F.array(page).alias("pages"))).alias("json"))


@query()
def std_layout(spark, sf_dir):
    """Elements of every document's layout output, in reading order: lines, the boxes that aren't wholly in their lines, an image and a figure."""
    e = L.standardize(layout_json(spark, sf_dir), "json", "doc_id")
    return rounded(e.select("document", "page", "reading", "kind", "element_id", "order_index", F.md5(F.coalesce(F.col("payload")["raw_text"], F.lit(""))).alias("digest"), F.col("payload")["parent_text_index"].cast("long").alias("parent"), "box.x0", "box.y0", "box.x1", "box.y1"))


@query("""SELECT p_partkey, '{' || chr(92) || 'x{C' || p_size || '}}-NH2(OH)2' AS expression, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS row_label, 'NH2,OH,OH' AS labels FROM part WHERE p_size % 3 > 0""")
def det_md_structures(spark, sf_dir):
    """Structures in the image addresses of a table's rows about parts; the braces of some are never closed."""
    p = V.table(spark, sf_dir, "part")
    url = F.concat(F.lit("https://x.y/?q=%5Cchem%7B{%5Cx{C"), "p_size", F.when(F.col("p_size") % 3 > 0, "}}-NH2%28OH%292%7D").otherwise("}-NH2"))
    text = F.concat(F.lit("head\n| "), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(""), F.lit(" | ![a]("), url, F.lit(") | ![b](https://x.y/none) |"))
    found = p.select("p_partkey", F.explode(L.markdown_structures(text)).alias("s"))
    return found.select("p_partkey", "s.expression", "s.row_label", F.array_join("s.labels", ",").alias("labels"))
