"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import id_text
from gradus.llm.tokens import slices

#: The base kinds in the order of ties, with the pattern of each.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")

SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Ordinary parts of identifiers, paths and slugs, from which ordinary samples are put together.
PARTS = (
    "get set add remove update create delete find list read write load save open close start stop run make build parse format "
    "user account order item page file path name value index count total size type state status event message error result request "
    "response client server config option default test data table column row field key map node tree graph queue stack list array "
    "string number date time year month day hour minute second first last next previous current parent child left right top bottom "
    "image video audio text title header footer content body style class window button label input output buffer stream channel thread "
    "process session context handler manager service factory builder adapter controller model view template version release report "
    "summary detail history archive backup source target local remote public private internal external main common shared utils helper "
    "international transformation understanding development environment information management organization communication"
).split()
#: Common words and endings of four languages, from which long ordinary words and compounds are put together.
WORDS = (
    "the of and to in is that for it with as was on are by this be at from or have an which you not but they his her had were tion ing er ed ly ment ness ble ous est al re th an on "
    "der die das und ist nicht ein eine mit auf von sich auch werden haben sein fuer dass wird bei oder einen dem den des ung lich keit heit sch chen zung ver ge be er en te ieren schaft "
    "le la les des une dans est pour que qui sur avec par plus pas nous vous ont sont cette leur mais elle ment eux aux eur ais ent aire ique ette re de en ou "
    "el los las una del que por con para como mas pero sus este esta son entre cuando muy sobre tambien hasta hay donde cion mente ado ida aje eza oso ia os as es ar er ir"
).split()


#: Syllables of any pronounceable word: how they begin, their vowels, how they end.
ONSETS = "b c d f g h j k l m n p qu r s t v w x y z ch sh th ph ck br cr dr fr gr pr tr bl cl fl gl pl sl sc sk sm sn sp st sr sch str ll rr tt ss pf zw kn wh th tz cz sz rz w".split()
VOWELS, ENDS = "a e i o u y a e i o ai ei ou au oe ie ia io".split(), ["", "", "", "", "", "n", "r", "s", "l", "m", "t", "d", "rd", "nd", "st", "ck", "ll", "ch", "pf", "ng", "tz"]


class MarkovPair:
    """Second-order character chains of two classes, smoothed by shorter contexts; ratio(s) is the log-likelihood ratio of
    a string's distinct runs of three characters: a pattern that is only repeated says nothing new."""

    def __init__(self, random_strings: list[str], ordinary: list[str]):
        n = len(SYMBOLS)
        self.place = {c: i for i, c in enumerate(SYMBOLS)}
        logs = []
        for samples in (random_strings, ordinary):
            two, one, none = np.zeros((n, n, n)), np.zeros((n, n)), np.ones(n)
            for s in samples:
                i = np.array([self.place[c] for c in s if c in self.place])
                np.add.at(none, i, 1)
                np.add.at(one, (i[:-1], i[1:]), 1)
                np.add.at(two, (i[:-2], i[1:-1], i[2:]), 1)
            # each context falls back on the next shorter one by a weight of four samples
            one = (one + 4 * none / none.sum()) / (one.sum(1, keepdims=True) + 4)
            logs.append(np.log((two + 4 * one[None]) / (two.sum(2, keepdims=True) + 4)))
        self.log_ratio = logs[0] - logs[1]

    def ratio(self, s: str) -> float:
        i = np.array([self.place[c] for c in s])
        n = len(SYMBOLS)
        return float(self.log_ratio.ravel()[np.unique((i[:-2] * n + i[1:-1]) * n + i[2:])].sum()) if len(i) > 2 else 0.0


def samples(n: int = 6000, seed: int = 11) -> tuple[list[str], list[str]]:
    """Labelled strings: random ones of several alphabets, and ordinary identifiers, paths, slugs, versions, words and numbers."""
    rng = np.random.default_rng(seed)
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", SYMBOLS[:62], SYMBOLS[26:62], SYMBOLS[:26] + SYMBOLS[52:62], SYMBOLS[:64], SYMBOLS[:62] + "_-")
    random_strings = ["".join(np.array(list(a))[rng.integers(0, len(a), rng.integers(16, 65))]) for a in alphabets for _ in range(n // len(alphabets))]
    ordinary = []
    for i in range(n):  # words, numbers
        if i % 8 == 0:
            s = "".join(np.array(list("0123456789"))[rng.integers(0, 10, rng.integers(8, 25))])
        else:
            if i % 8 < 6:
                parts = [WORDS[j] for j in rng.integers(0, len(WORDS), rng.integers(2, 9))]
            else:
                parts = [a[int(rng.integers(0, len(a)))] for _ in range(int(rng.integers(2, 9))) for a in (ONSETS, VOWELS, ENDS)]
            s = "".join(parts)
            s = s.upper() if i % 8 == 1 else s.capitalize() if i % 8 < 4 else s
        ordinary.append(s)
    for _ in range(n):
        parts = [PARTS[i] for i in rng.integers(0, len(PARTS), rng.integers(2, 6))]
        if rng.random() < 0.7:
            parts.insert(int(rng.integers(1, len(parts) + 1)), str(rng.integers(0, 10 ** int(rng.integers(1, 5)))))
        kind = int(rng.integers(0, 6))
        if kind == 0:
            s = parts[0] + "".join(p.capitalize() for p in parts[1:])
        elif kind == 1:
            s = "".join(p.capitalize() for p in parts)
        else:
            s = ("_", "-", "/", "_")[kind - 2].join(parts)
            s = s.upper() if kind == 5 else s
        ordinary.append(s)
    return random_strings, ordinary


@lru_cache(1)
def default_model() -> MarkovPair:
    return MarkovPair(*samples())


class Scanner:
    """All spans of a text: the base kinds, and runs of key characters that the models call random and no base span touches.

    Runs of fewer than `shortest` characters say too little; of the others the log-likelihood ratio alone decides, whatever they are made of.
    """

    def __init__(self, model: MarkovPair | None = None, least: float = 11.2, shortest: int = 12):
        self.model, self.least = model or default_model(), least
        self.runs = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % shortest)

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, kind, end, where the secret itself begins), by start, then kind."""
        out, low = [], text.lower()
        if any(w in low for w in ("passw", "secret", "token", "api")):
            out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
        out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
        base = list(out)
        for m in self.runs.finditer(text):
            a, b = m.span()
            if not any(a < e and s < b for s, _, e, _ in base) and self.model.ratio(m[0]) > self.least:
                out.append((a, 3, b, a))
        return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def redacted(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with every secret (of an assignment its value alone) replaced; spans that touch count as one."""
    cuts: list[list[int]] = []
    for a, b in sorted((a, b) for _, _, b, a in spans):
        if cuts and a <= cuts[-1][1]:
            cuts[-1][1] = max(b, cuts[-1][1])
        else:
            cuts.append([a, b])
    for a, b in reversed(cuts):
        text = text[:a] + mark + text[b:]
    return text


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: MarkovPair | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    Whole texts of any length, offsets in code points, end exclusive. A null or empty text has no spans; repeated rows
    stay repeated, rows without id too; extra columns are not read; no rows in, none out. One pass without a shuffle.
    """
    model = model or default_model()

    def run(batches):
        scanner = Scanner(model)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                found = [scanner.spans(t) for t in texts]
                base = [[s for s in f if s[1] < 3] for f in found]
                cols = [part.column("doc_id"), *(pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(3))]
                cols += [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()), pa.array([joined(f) for f in found], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def scrub(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", model: MarkovPair | None = None) -> DataFrame:
    """df with every secret of its text replaced by a mark and the length column, if there is one, put right.

    All rows and columns stay; a text without secrets, a null or an empty one stays as it is.
    """
    model = model or default_model()
    names, schema = df.columns, df.schema
    held = df.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("text", F.coalesce(f"c{names.index(text_col)}", F.lit("")))
    at, length = names.index(text_col), names.index(length_col) if length_col in names else None

    def run(batches):
        scanner = Scanner(model)
        for batch in batches:
            for part in slices(batch):
                cols = [part.column(i) for i in range(len(names))]
                texts = part.column("text").to_pylist()
                new = [redacted(t, f) if (f := scanner.spans(t)) else None for t in texts]
                if any(n is not None for n in new):
                    old, sizes = cols[at].to_pylist(), cols[length].to_pylist() if length is not None else None
                    cols[at] = pa.array([o if n is None else n for o, n in zip(old, new)], cols[at].type)
                    if sizes is not None:
                        cols[length] = pa.array([o if n is None else len(n) for o, n in zip(sizes, new)], cols[length].type)
                yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(names))])

    out = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema))
    return held.mapInArrow(run, out).toDF(*names)
