"""Personal data in texts: fixed patterns, and spans of a character tagger over overlapping windows, reconciled by text."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradus.llm.common import id_text
from gradus.llm.tagger import CLASS, CONTROL, DIGIT, OUT, Tagger, classes, tag_line
from gradus.llm.tokens import slices

#: The base kinds in the order of ties, with their patterns (a run of digits is never entered in its middle,
#: which finds the same and takes no longer for long runs), and the two kinds that the tagger alone finds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by start, then kind. Each takes time in proportion to the text."""
    out = []
    past = 0
    for m in DOMAIN.finditer(text):
        # a local part holds no @, so that of each @ is the run before it, up to the end of the match before
        a = m.start()
        while a > past and LOCAL.match(text, a - 1):
            a -= 1
        if a < m.start():
            out.append((a, 0, m.end()))
            past = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def sound(kind: int, s: str) -> bool:
    """The exact check of a tagged span: what a thing of its kind must fulfil, whatever surrounds it."""
    d = digits_of(s)
    if kind == 0:
        return re.fullmatch(r"[^\s@<>()\[\]{}\",;:]+@[^\s@<>()\[\]{}\",;:/]+\.[^\W\d_]{2,}", s) is not None
    if kind == 1:
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", s) is not None and all(int(p) <= 255 for p in s.split("."))
    if kind == 2:
        return re.fullmatch(r"[0-9][0-9 .\-/]+[0-9]", s) is not None and 12 <= len(d) <= 19 and luhn(d)
    if kind == 3:
        return re.fullmatch(r"\(?[0-9][0-9 ().\-/]+[0-9]", s) is not None and 9 <= len(d) <= 15 and len(s) - len(d) >= 2 and s.count("(") == s.count(")") <= 1 and (d[0] == "0" or re.search("[0-9]{3}", s) is not None)
    if kind == 4:
        s = re.sub("[ -]", "", s)
        return re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s) is not None and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    return re.fullmatch(r"(?!000|666|9)[0-9]{3}([ .-])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}", s) is not None


WIDTH, STEP = 160, 96  # windows overlap by 64 characters, more than a tagged span of ordinary length


def tag_spans(model: Tagger, text: str, tags: np.ndarray, e: np.ndarray, at: int) -> list[tuple]:
    """(start, end, kind, gain) of a window's tags; the gain is the span's emissions over those of OUT."""
    out, inside = [], np.flatnonzero(tags != OUT)
    if not len(inside):
        return out
    # a span goes on while tags are inside ones of the same kind as before
    starts = [i for i in inside if tags[i] == 1 or i == 0 or tags[i - 1] == OUT]
    for i in starts:
        j = i + 1
        while j < len(tags) and tags[j] > 1:
            j += 1
        kind = max((int(k) for k in tags[i:j]), default=1) - 2
        if kind >= 0 and at + j <= len(text):
            out.append((at + int(i), at + int(j), kind, float((e[np.arange(i, j), tags[i:j]] - e[i:j, OUT]).sum())))
    return out


def reconciled(found: list[tuple]) -> list[tuple]:
    """The spans of all windows of a text as one set that doesn't overlap: pieces of one kind that overlap are one span
    (windows cut it); of the rest the set with the largest total gain, by weighted interval scheduling; ties to the earlier."""
    joined: list[list] = []
    last: dict[int, int] = {}
    for a, b, kind, gain in sorted(set(found)):
        k = last.get(kind)
        if k is not None and a < joined[k][1]:
            joined[k][1], joined[k][3] = max(b, joined[k][1]), max(gain, joined[k][3])
        else:
            last[kind] = len(joined)
            joined.append([a, b, kind, gain])
    spans = sorted((tuple(s) for s in joined if s[3] > 0), key=lambda s: (s[1], s[0], s[2]))
    ends, best, took = [s[1] for s in spans], [0.0], []
    for i, s in enumerate(spans):
        j = bisect.bisect_right(ends, s[0], 0, i)
        took.append(j if best[j] + s[3] > best[i] else None)
        best.append(max(best[i], best[j] + s[3]))
    out, i = [], len(spans)
    while i:
        if took[i - 1] is None:
            i -= 1
        else:
            out.append(spans[i - 1])
            i = took[i - 1]
    return out[::-1]


class Scanner:
    """Base spans of texts, and those of the tagger that touch none of them.

    Every kind has digits or an @, and its exact check asks for them: a window without any can yield no span that is kept,
    so it isn't run; of the windows that are run, those are decoded of which it isn't certain that they hold nothing.
    """

    def __init__(self, model: Tagger | None = None, lanes: int = 1024):
        self.model, self.lanes = model or default_model(), lanes
        self.telling = np.zeros(256, bool)
        self.telling[[DIGIT, CLASS[ord("@")]]] = True

    def tagged(self, texts: list[str]) -> list[list[tuple]]:
        """(start, end, kind, gain) of each text, reconciled."""
        places, rows = [], []
        for i, t in enumerate(texts):
            code = classes(t)
            sums = np.concatenate([[0], np.cumsum(self.telling[code])])
            for a in range(0, max(1, len(t) - (WIDTH - STEP)), STEP):
                if sums[min(len(t), a + WIDTH)] > sums[a]:
                    row = np.full(WIDTH, CONTROL, np.uint8)
                    row[: min(WIDTH, len(t) - a)] = code[a : a + WIDTH]
                    rows.append(row)
                    places.append((i, a))
        found: list[list[tuple]] = [[] for _ in texts]
        for k in range(0, len(rows), self.lanes):
            codes = np.array(rows[k : k + self.lanes]).T
            e = self.model.emissions(codes)
            some = np.flatnonzero(~self.model.best_is_out(e))
            if len(some):
                e = e[:, some]
                tags = self.model.viterbi(e)
                for j, lane in enumerate(some):
                    i, a = places[k + lane]
                    found[i] += tag_spans(self.model, texts[i], tags[:, j], e[:, j], a)
        return [reconciled(f) for f in found]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
        """(start, kind, end, is it a base span) by start, then kind."""
        out = []
        for t, tagged in zip(texts, self.tagged(texts)):
            base = base_spans(t)
            own = []
            for a, b, kind, _ in tagged:
                while a < b and not (t[a].isalnum() or t[a] == "(" and kind == 3):
                    a += 1
                while b > a and not t[b - 1].isalnum():
                    b -= 1
                whole = (a == 0 or not (t[a - 1].isalnum() or t[a - 1] in "+.-_@/")) and (b == len(t) or not (t[b].isalnum() or t[b] in "-_@/")) and not re.match(r"[.,:][0-9]", t[b : b + 2])
                if whole and sound(kind, t[a:b]) and not any(a < e and s < b for s, _, e in base):
                    own.append((a, kind, b, False))
            out.append(sorted([(*s, True) for s in base] + own))
        return out


SYLLABLES = [a + b for a in ("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "th", "ch", "st", "") for b in ("a", "e", "i", "o", "u", "an", "en", "or", "é", "ü", "ing", "ion")]
#: Spellings by made-up parts: {w} a word, {W} one in lower case, {1} to {9} so many digits, {x} and {X} a hexadecimal or a capital code.
EMAILS = ["{W}.{W}@{W}.com", "{W}{2}@{W}.example.com", "{W}.{2}@{W}{1}.example.com", "{W}_{W}@{W}.org", "{W}@{W}-{W}.de", "{W}+{W}@{W}.co.uk", "{W}.{W}@{W}.fr", "{W}.{2}@{W}.net"]
PHONES = ["+1 ({3}) {3}-{4}", "+{2} {3} {7}", "+{2}-{3}-{3}-{4}", "({3}) {3}-{4}", "({3}) {3} {4}", "{3}-{3}-{4}", "{3}.{3}.{4}", "{3} {3} {4}", "0{3} / {3} {4}", "0{1} {2} {2} {2} {2}", "({3}){3}-{4}", "({3}) {3}-{4}"]
PLAIN = [
    "{1}", "{2}", "{3}", "{4}", "{5}", "{6}", "{8}", "{9}", "20{2}-0{1}-1{1}", "1{1}/2{1}/19{2}", "0{1}.1{1}.20{2}", "1{1}:{2}:{2}", "{2}:{2}", "${2},{3}.{2}", "{1}.{2}", "v{1}.{2}.{1}", "{1}.{3}.{3}", "{1},{3},{3}", "19{2}-20{2}", "978-{1}-{2}-{6}-{1}",
    "#{5}", "{2} %", "({1})", "[{2}]", "{w}-{2}", "{w}{3}", "RFC {4}", "ISO {4}", "page {3}", "id {5}", "{x}", "{x}", "AKIA{X}", 'token = "{x}"', "secret: {x}", "@{w}", "{w}@{w}", "{3} x {3}", "{2}° {2}' N", "{1}.{1}.{1}", "{3}-{2}", "{4} {4}", "https://{W}.org/{4}/{2}", "{3} {3}", "{1} {3} {3}", "{9}{4}-{2}", "{5}-{4}",
    "{2}-{3}", '<{w} {w}="{2}">', "{w}({1}, {2})", "{4}, {4} {w} {4}", "{3}, {3}, {3}",
]


def samples(n: int, seed: int = 3, width: int = WIDTH):
    """Made-up labelled texts: (text, [(start, end, kind)]). Words are random syllables; between them lie private things in
    many spellings, and things that look like them: dates, prices, versions, codes, hashes, numbers."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choices("0123456789", k=k))

    def word():
        s = "".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) or "a"
        return s.capitalize() if rng.random() < 0.15 else s

    def part(m):
        c = m[1]
        if c.isdigit():
            return num(int(c))
        return word() if c == "w" else word().lower() if c == "W" else "".join(rng.choices("0123456789abcdef", k=rng.randint(16, 48))) if c == "x" else "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))

    spelled = lambda forms: re.sub(r"\{(\w)\}", part, rng.choice(forms))
    grouped = lambda d, sep: sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def private():
        r = rng.random()
        if r < 0.2:
            return spelled(EMAILS), 0
        if r < 0.3:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4)), 1
        if r < 0.45:
            d = num(rng.choice((15, 15, 15, 12, 17, 18)))
            return grouped(next(d + c for c in "0123456789" if luhn(d + c)), rng.choice(("", " ", "-", ".", " - ", "  "))), 2
        if r < 0.7:
            return spelled(PHONES), 3
        if r < 0.85:
            land, body = rng.choice(("DE", "FR", "ES", "GB", "NL", "IT", "CH", "AT", "PL", "SE")), "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=rng.choice((0, 0, 4)))) + num(rng.randint(12, 19))
            check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
            return grouped(f"{land}{check:02d}{body}", rng.choice(("", " "))), 4
        sep = rng.choice("---- .")
        return f"{rng.randint(1, 665):03d}{sep}{rng.randint(1, 99):02d}{sep}{rng.randint(1, 9999):04d}", 5

    made = []
    while len(made) < n:
        text, spans = "", []
        while len(text) < 2 * width:
            r = rng.random()
            if r < 0.14:
                if rng.random() < 0.4:
                    text += rng.choice(("call", "tel", "Tel.:", "phone:", "mail", "from", "IBAN", "SSN", "card", "account", "contact", "reach")) + " "
                thing, kind = private()
                spans.append((len(text), len(text) + len(thing), kind))
                text += thing + rng.choice(("", "", ".", ",", ")", ";"))
            elif r < 0.34:
                text += spelled(PLAIN) + rng.choice(("", "", ".", ",", ";"))
            else:
                text += word() + rng.choice(("", "", "", "", ".", ",", ":"))
            text += rng.choice((*" " * 12, "\n", "\n\n", "  "))
        cut = rng.randrange(len(text) - width) if rng.random() < 0.7 else 0
        own = [(a - cut, b - cut, k) for a, b, k in spans if b > cut and a < cut + width]
        made.append((text[cut : cut + width], own))
    return made


def batch(some, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(codes, tags), a column a text; a span that the window's start cuts begins with inside tags."""
    codes, tags = np.full((width, len(some)), CONTROL, np.uint8), np.zeros((width, len(some)), np.int64)
    for j, (text, spans) in enumerate(some):
        codes[: len(text), j] = classes(text)[:width]
        whole = tag_line(2 * width + 64, [(a + 64, b + 64, k) for a, b, k in spans if a > -64])
        tags[:, j] = whole[64 : 64 + width]
    return codes, tags


@lru_cache(1)
def default_model(rounds: int = 700, lanes: int = 32, seed: int = 3) -> Tagger:
    """Trained on made-up texts of 96 characters."""
    made = samples(4000, seed, 96)
    rng = np.random.default_rng(seed)
    return Tagger(len(KINDS), 24).train(batch([made[i] for i in rng.integers(0, len(made), lanes)], 96) for _ in range(rounds))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row; the counts and the digest are of base spans.

    Whole texts of any length, offsets in code points, end exclusive. A null or empty text has no spans; repeated rows stay
    repeated, rows without id too; extra columns are not read; no rows in, none out. One pass without a shuffle; the model
    is some ten thousand numbers, trained on the driver when first used.
    """
    model = model or default_model()

    def run(batches):
        scanner = Scanner(model)
        for b in batches:
            for part in slices(b):
                found = scanner.spans(part.column("text").to_pylist())
                base = [[s for s in f if s[3]] for f in found]
                cols = [part.column("doc_id"), *(pa.array([sum(s[1] == k for s in f) for f in base], pa.int64()) for k in range(4))]
                cols += [pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base], pa.string()), pa.array([joined(f) for f in found], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
