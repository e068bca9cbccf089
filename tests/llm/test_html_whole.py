"""HTML extraction: blocks of hand-made pages, whole blocks as features, very long and empty pages."""

import time

import numpy as np
import pytest

from gradus.llm import html_blocks
from gradus.llm.queries import op6_html


@pytest.mark.parametrize(
    "html,want",
    [
        ("<p>a<p/>b</p>", ["a", "b"]),
        ("x<div/>y", ["x", "y"]),
        ("a<br/>b<hr/>c", ["a b", "c"]),
        ("<p>one</p><video><p>x</p></video><p>two</p>", ["one", "two"]),
        ("<p>one</p><video><p>x</p><p>two</p>", ["one", "x", "two"]),
        ("<p>a <svg><path/><text>t</text></svg> b</p>", ["a b"]),
        ("<svg/><p>after</p>", ["after"]),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then</p>", ["if x=1 then"]),
        ("<script>a</script><p>b", ["b"]),
        ("<p>b</p><script>a", ["b"]),
        ("<ul><li>one<li>two</ul>three", ["one", "two", "three"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<p>Caf&eacute; &amp;\n\t more &#8212; x</p>", ["Café & more — x"]),
        ("<div>a<p>b</div>c", ["a", "b", "c"]),
        ("", []),
        ("<", ["<"]),
        ("</p></div>", []),
    ],
)
def test_blocks_of_hand_made_pages(html, want):
    assert [b[2] for b in html_blocks.leaves(html)] == want


def test_every_word_of_a_block_is_a_feature():
    words = [f"w{i}" for i in range(3000)]
    one, other = (html_blocks.leaves("<p>" + " ".join(words[:-1] + [last]) + "</p>") for last in ("w2999", "zzz"))
    a, b = html_blocks.vectors(one), html_blocks.vectors(other)
    part = slice(html_blocks.PATHS, html_blocks.PATHS + html_blocks.WORDS)
    assert a[0, part].sum() == pytest.approx(1) and not np.array_equal(a[0, part], b[0, part])


def test_unclosed_tags_take_linear_time():
    began = time.time()
    assert len(html_blocks.leaves("<b>" * 20_000 + "<p>x</p>" * 20_000)) == 20_000
    assert time.time() - began < 10


def test_query_over_odd_pages(spark, tmp_path):
    body = "".join(f"<p>Sentence number {i} of a very long page, with some words in it.</p>" for i in range(4000))
    rows = [(1, "u", f"<html><body><nav><a href=/>Home</a></nav><article><h1>T</h1>{body}</article></body></html>", 1), (2, None, None, 1), (None, "u", "", 1), (3, "u", "<p", 1), (3, "u", "<p", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    out = op6_html(spark, str(tmp_path))
    assert out.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    got = out.collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    long = next(r for r in got if r.page_id == 1)
    assert long.text.startswith("T\nSentence number 0") and long.text.count("\n") == 4000 and "Home" not in long.text
    assert html_blocks.extract(df.limit(0)).count() == 0


def test_pages_without_a_frame():
    model, rng = html_blocks.default_model(), np.random.default_rng(99)
    sentence = "The committee met on Tuesday and agreed that the old bridge should be repaired before the winter."
    for page in (sentence, f"<p>{sentence}</p>", f"<html><body><p>{sentence}</p></body></html>"):
        assert html_blocks.main_texts(model, [page]) == [sentence]
    made = [html_blocks.bare_page(rng) for _ in range(200)]
    got = html_blocks.main_texts(model, [h for h, _ in made])
    assert np.mean([g == "\n".join(" ".join(t.split()) for t in m) for g, (_, m) in zip(got, made)]) > 0.93
