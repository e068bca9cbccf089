"""Main text of HTML pages by a recurrent block labeller."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.tokens import slices

#: Fixed values of HTML: elements without content, elements whose text is no text, and elements that run within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript svg iframe object canvas audio video annotation".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mspace mstyle mfenced".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("article aside body div footer form header html main nav ol section table td th ul dl button".split())


PATHS, WORDS = 96, 32
_slots: dict[str, int] = {}


def slot(word: str, size: int) -> int:
    if len(_slots) > 200_000:
        _slots.clear()
    h = _slots.get(word)
    if h is None:
        h = _slots[word] = zlib.crc32(word.encode())
    return h % size


class Leaves(HTMLParser):
    """The page's leaf blocks in order: (hashed tags and names of its path, its depth, text, characters within links).

    A self-closing tag of an element that has content opens it, as in HTML. An open element holds the features of its
    whole path, of which there are at most PATHS, and counts of open tags tell whether a search of the stack can hit.
    """

    def __init__(self, silent: frozenset):
        super().__init__(convert_charrefs=True)
        self.never, self.blocks, self.stack, self.count, self.text, self.linked, self.silent = silent, [], [], {}, [], 0, []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            tag, features = self.stack[-1] if self.stack else ("", frozenset())
            self.blocks.append((features | {slot("=" + tag, PATHS)} if tag else features, len(self.stack), text, self.linked))
        self.text, self.linked = [], 0

    def pop(self, tags, scopes=frozenset()) -> None:
        if not any(self.count.get(t) for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                if any(t not in INLINE for t, _ in self.stack[i:]):
                    self.flush()
                for t, _ in self.stack[i:]:
                    self.count[t] -= 1
                del self.stack[i:]
                return
            if self.stack[i][0] in scopes:
                return

    def handle_starttag(self, tag, attrs):
        if tag in self.never:
            self.silent.append(tag)
        if self.silent:
            return
        if tag == "br":
            self.text.append(" ")
        if tag not in INLINE:
            self.flush()
            if tag in CLOSES_P:
                self.pop(("p",), SCOPES)
            if tag in SIBLINGS:
                self.pop(SIBLINGS[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        if tag not in VOID:
            names = [w for k, v in attrs if k in ("class", "id", "role") and v for w in re.findall(r"[a-z]+", v.lower())]
            features = (self.stack[-1][1] if self.stack else frozenset()) | {slot("<" + tag, PATHS), *(slot("." + n, PATHS) for n in names)}
            self.stack.append((tag, features))
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        if not self.silent or tag in self.never:  # foreign elements within a silent one are closed as they are opened
            self.handle_starttag(tag, attrs)
        if tag in self.never and tag == "svg":
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.silent:
            del self.silent[self.silent.index(tag) :]
        elif not self.silent and tag not in VOID:
            self.pop((tag,))

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if self.count.get("a"):
                self.linked += len(data)


def leaves(html: str) -> list:
    """Leaf blocks of a page. What follows an element without text that is never closed isn't lost: such an element counts
    for nothing. Only an unclosed script or style runs to the end of the page, and a tag that the page's end cuts is no text, as in HTML."""
    silent, last = SILENT, html.rfind("<")
    if last >= 0 and ">" not in html[last:] and re.match("<[A-Za-z/!?]", html[last : last + 2]):
        html = html[:last]
    while True:
        p = Leaves(silent)
        p.feed(html)
        p.close()
        p.flush()
        unclosed = set(p.silent) - {"script", "style"}
        if not unclosed:
            return p.blocks
        silent = silent - unclosed


def vectors(blocks: list) -> np.ndarray:
    """A row a block: hashed tags and names of its path, its hashed words (all of them), and a few counts."""
    x = np.zeros((len(blocks), PATHS + WORDS + 6))
    for i, (features, depth, text, linked) in enumerate(blocks):
        x[i, list(features)] = 1
        words = text.lower().split()
        x[i, PATHS : PATHS + WORDS] = np.bincount([slot(w, WORDS) for w in words], minlength=WORDS) / len(words)
        n = len(text)
        x[i, PATHS + WORDS :] = np.log1p(n) / 6, min(1.0, linked / n), i / len(blocks), text[-1] in ".!?", min(1.0, text.count(",") * 20 / n), depth / 8
    return x


class Labeller:
    """A bidirectional LSTM over a page's blocks and a logistic unit on both states; plain numpy, trained by Adam."""

    def __init__(self, size: int, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w = {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.15, (size, 4 * hidden))
            self.w["h" + d] = rng.normal(0, 0.15, (hidden, 4 * hidden))
            self.w["c" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.w["o"], self.w["b"] = rng.normal(0, 0.15, (2 * hidden + size, 1)), np.zeros(1)

    def states(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States of one direction for pages (pages, blocks, features); a step without block leaves the state as it is."""
        n, t, _ = x.shape
        z = x @ self.w["x" + d] + self.w["c" + d]
        h, c, H = np.zeros((n, self.h)), np.zeros((n, self.h)), self.h
        out, tape = np.zeros((n, t, H)), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            a = z[:, k] + h @ self.w["h" + d]
            s = 1 / (1 + np.exp(-a[:, : 3 * H]))
            i, f, o, g = s[:, :H], s[:, H : 2 * H], s[:, 2 * H :], np.tanh(a[:, 3 * H :])
            m = mask[:, k, None]
            new = f * c + i * g
            th = np.tanh(new)
            tape.append((k, h, c, i, f, o, g, th, m))
            c = m * new + (1 - m) * c
            h = m * (o * th) + (1 - m) * h
            out[:, k] = h
        return out, tape

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.states(x, mask, "f")[0], self.states(x, mask, "b")[0], x], 2)
        return (both @ self.w["o"])[:, :, 0] + self.w["b"][0]

    def gradients(self, x, mask, y):
        (hf, tf), (hb, tb) = self.states(x, mask, "f"), self.states(x, mask, "b")
        both = np.concatenate([hf, hb, x], 2)
        p = 1 / (1 + np.exp(-((both @ self.w["o"])[:, :, 0] + self.w["b"][0])))
        e = (p - y) * mask / mask.sum()
        grad = {"o": np.einsum("nth,nt->h", both, e)[:, None], "b": np.array([e.sum()])}
        H = self.h
        for d, tape, part in (("f", tf, slice(0, H)), ("b", tb, slice(H, 2 * H))):
            down = e[:, :, None] * self.w["o"][part, 0]
            dh, dc = np.zeros((len(x), H)), np.zeros((len(x), H))
            gx, gh, gc = (np.zeros_like(self.w[n + d]) for n in "xhc")
            for k, h0, c0, i, f, o, g, th, m in reversed(tape):
                dh = dh + down[:, k]
                own = dh * m
                dn = dc * m + own * o * (1 - th**2)
                da = np.concatenate([dn * g * i * (1 - i), dn * c0 * f * (1 - f), own * th * o * (1 - o), dn * i * (1 - g**2)], 1)
                gx += x[:, k].T @ da
                gh += h0.T @ da
                gc += da.sum(0)
                dh = da @ self.w["h" + d].T + dh * (1 - m)
                dc = dn * f + dc * (1 - m)
            grad |= {"x" + d: gx, "h" + d: gh, "c" + d: gc}
        return grad

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 260, batch: int = 24, rate: float = 0.01, seed: int = 6) -> Labeller:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        for step in range(1, rounds + 1):
            some = [pages[i] for i in rng.integers(0, len(pages), batch)]
            x, mask, y = padded([p[0] for p in some], [p[1] for p in some])
            for k, g in self.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self


def padded(xs, ys=None):
    t = max(map(len, xs))
    x, mask, y = np.zeros((len(xs), t, xs[0].shape[1])), np.zeros((len(xs), t)), np.zeros((len(xs), t))
    for i, one in enumerate(xs):
        x[i, : len(one)], mask[i, : len(one)] = one, 1
        if ys is not None:
            y[i, : len(one)] = ys[i]
    return x, mask, y


def sample_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A made-up page and its main blocks. Words are random syllables, so only places, lengths and context tell."""
    syllables = [a + b for a in "b d f g k l m n p r s t v ch th st".split() for b in "a e i o u an en or".split()]
    pick = lambda *a: a[int(rng.integers(0, len(a)))]
    words = lambda a, b: " ".join("".join(syllables[i] for i in rng.integers(0, len(syllables), rng.integers(1, 4))) for _ in range(int(rng.integers(a, b))))
    sentence = lambda a=4, b=18: words(a, b).capitalize() + pick(".", ".", ".", "!", "?", "")
    prose = lambda: " ".join(sentence() for _ in range(int(rng.integers(1, 7))))
    main: list[str] = []

    def links(n):
        return "<ul>" + "".join(f'<li><a href="/{words(1, 2)}">{words(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def keep(text, form):
        main.append(text)
        return form % text

    def junk():
        kind = int(rng.integers(0, 8))
        if kind == 0:
            return f'<div class="{pick("ad", "ads", "advert", "advertisement", "banner ad", "sponsored", "promo")}">{prose() if rng.random() < 0.6 else words(2, 8)}</div>'
        if kind == 1:
            return f'<{pick("aside", "div")} class="{pick("sidebar", "related", "widget", "share social")}">' + (f"<h3>{words(1, 4)}</h3>" if rng.random() < 0.6 else "") + links(int(rng.integers(1, 6))) + "</div></aside>"
        if kind == 2:
            return f'<form class="{pick("search", "newsletter", "login", "subscribe")}"><label>{words(1, 4)}</label><input type="text"><button>{words(1, 3)}</button><p>{sentence()}</p></form>'
        if kind == 3:
            return f'<div class="{pick("cookie", "notice", "consent banner", "alert notice", "popup")}"><p>{prose()}</p></div>'
        if kind == 4:
            return f'<{pick("section", "div")} {pick("id", "class")}="{pick("comments", "comment list", "replies", "discussion")}"><h3>{words(1, 3)}</h3>' + "".join(f'<div class="comment"><p class="author">{words(1, 3)}</p><p>{prose()}</p></div>' for _ in range(int(rng.integers(1, 5)))) + "</div></section>"
        if kind == 5:
            return f'<nav class="{pick("breadcrumb", "menu", "pagination", "toc")}">{links(int(rng.integers(1, 6)))}</nav>'
        if kind == 6:
            return f'<div class="{pick("meta", "byline", "tags", "social share")}">{words(1, 6)}</div>'
        return f"<aside><p>{prose()}</p></aside>"

    def content():
        parts = [keep(pick(words(2, 9), prose()), pick("<h1>%s</h1>", "<h1>%s</h1>", '<h1 class="title">%s</h1>', "<h2>%s</h2>"))] if rng.random() < 0.9 else []
        for _ in range(int(rng.integers(0, 16))):
            r = rng.random()
            if r < 0.7:
                parts.append(keep(pick(prose(), prose(), sentence(1, 5)), pick("<p>%s</p>", "<p>%s</p>", "<p><b>%s<br>", "<p>%s", '<p class="text">%s</p>', "<div><p>%s</p></div>")))
            elif r < 0.78:
                parts.append(keep(words(1, 7), pick("<h2>%s</h2>", "<h3>%s</h3>", "<h4>%s</h4>")))
            elif r < 0.86:
                parts.append(pick("<ul>", "<ol>") + "".join(keep(pick(words(2, 8), prose()), "<li>%s</li>") for _ in range(int(rng.integers(1, 6)))) + "</ul></ol>")
            elif r < 0.92:
                parts.append(keep(prose(), pick("<blockquote>%s</blockquote>", "<blockquote><p>%s</p></blockquote>", "<pre>%s</pre>", "<figure><figcaption>%s</figcaption></figure>")))
            elif r < 0.95:
                parts.append("<table><tr>" + "".join(keep(words(1, 4), "<td>%s</td>") for _ in range(int(rng.integers(2, 5)))) + "</tr></table>")
            else:
                parts.append(junk())
        return "".join(parts)

    head = f'<!DOCTYPE html><html><head><title>{words(2, 9)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
    before = [f"<nav>{links(int(rng.integers(1, 8)))}</nav>"] * (rng.random() < 0.8) + [f"<header><h1>{words(1, 4)}</h1><p>{words(2, 9)}</p></header>"] * (rng.random() < 0.3)
    before += [junk() for _ in range(int(rng.integers(0, 3)))]
    opened, closed = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main"><div class="post body">', "</div></div>"), ('<div class="article">', "</div>"), ('<div class="entry content" role="main">', "</div>"))
    body = opened + content() + closed
    after = [junk() for _ in range(int(rng.integers(0, 3)))] + [f"<footer>&copy; {words(1, 4)}.example &middot; {pick(words(1, 8), prose())}</footer>"] * (rng.random() < 0.9)
    order = list(range(len(before)))
    rng.shuffle(order)
    return head + "".join(before[i] for i in order) + body + "".join(after) + "</body></html>" * (rng.random() < 0.9), main


def bare_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A made-up page without any frame: a few of its paragraphs alone, as plain text, in one element, or in a body. All of it is main text."""
    pool: list[str] = []
    while not pool:
        pool = sample_page(rng)[1]
    some = pool[: int(rng.integers(1, 4))]
    form = int(rng.integers(0, 5))
    if form == 0:
        return some[0], some[:1]
    if form == 1:
        return f"<p>{some[0]}</p>", some[:1]
    body = "".join(f"<p>{t}</p>" for t in some) if form < 4 else f"<h1>{some[0]}</h1>" + "".join(f"<p>{t}</p>" for t in some[1:])
    return (f"<html><body>{body}</body></html>" if form > 2 else body), some


@lru_cache(1)
def default_model(pages: int = 700, seed: int = 4) -> Labeller:
    """Trained on made-up pages, every tenth without a frame; a block is main text if it is one of its page's main blocks."""
    rng = np.random.default_rng(seed)
    data = []
    for k in range(pages):
        html, main = bare_page(rng) if k % 10 == 9 else sample_page(rng)
        blocks, own = leaves(html), {" ".join(t.split()) for t in main}
        if blocks:
            data.append((vectors(blocks), np.array([b[2] in own for b in blocks], float)))
    return Labeller(PATHS + WORDS + 6).train(data)


def main_texts(model: Labeller, htmls: list[str], cells: int = 20_000) -> list[str]:
    """Main blocks of each page, one a line; pages of like length are labelled together."""
    blocks = [leaves(h) for h in htmls]
    order = sorted((i for i in range(len(htmls)) if blocks[i]), key=lambda i: len(blocks[i]))
    out = [""] * len(htmls)
    while order:
        n = max(1, min(len(order), cells // max(1, len(blocks[order[-1]]))))
        some, order = order[-n:], order[:-n]
        x, mask, _ = padded([vectors(blocks[i]) for i in some])
        for i, s in zip(some, model.scores(x, mask)):
            out[i] = "\n".join(b[2] for b, v in zip(blocks[i], s) if v > 0)
    return out


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page: its main blocks in order, one a line.

    Whole pages; a null or empty page, or one without main text, has the empty text; repeated rows stay repeated; no
    rows in, none out. One pass without a shuffle; the model is some thousand numbers.
    """
    model = model or default_model()
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = main_texts(model, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
