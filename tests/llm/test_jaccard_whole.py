"""Near-duplicates: a repeated doc_id is compared by each of its texts."""

from gradus.llm import jaccard


def test_a_repeated_id_with_a_copy_keeps_its_other_text(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(3, text("a")), (7, text("a")), (7, text("b")), (9, text("b") + " more"), (11, text("c")), (12, text("c")), (12, text("c"))]
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3), (7, 3), (9, 3), (11, 11), (12, 11)}
