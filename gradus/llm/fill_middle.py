"""Fill-in-the-middle transformation: a table-driven byte automaton counts units and sentinels, a second pass finds the cuts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradus.llm.common import id_text
from gradus.llm.tokens import slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

# Classes of bytes: white space, the three parts of a sentinel, any other first byte of a character, a UTF-8 continuation,
# and the padding behind a text's end.
SPACE, LESS, LETTER, MORE, OTHER, TAIL, PAD = range(7)
# States: at the start or in white space; in a word; in a word behind "<"; in a word behind "<" and a sentinel's letter.
GAP, WORD, OPENED, NAMED = range(4)
N_STATES, N_CLASSES = 4, 7
#: What a transition counts, packed into one integer: a character, a unit that ended before this byte, a sentinel that ends here.
CHAR, UNIT, SENTINEL = 1, 1 << 10, 1 << 20
BLOCK = 64  # bytes; fewer than 1 << 10, so that no count runs over


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each byte, next state, count) with state * N_CLASSES + class as the place in the latter two."""
    kind = np.full(256, OTHER, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind[0x80:0xC0] = TAIL
    kind[list(b"PSM")] = LETTER
    kind[ord("<")], kind[ord(">")] = LESS, MORE
    follow, count = np.zeros((N_STATES, N_CLASSES), np.uint8), np.zeros((N_STATES, N_CLASSES), np.int32)
    follow[:, SPACE], follow[:, LESS], follow[:, LETTER], follow[:, MORE], follow[:, OTHER] = GAP, OPENED, WORD, WORD, WORD
    follow[OPENED, LETTER] = NAMED
    follow[:, TAIL] = WORD  # the rest of a character is within a word, and never a part of a sentinel
    follow[:, PAD] = range(N_STATES)
    count[:, [SPACE, LESS, LETTER, MORE, OTHER]] = CHAR
    count[WORD:, SPACE] += UNIT
    count[NAMED, MORE] += SENTINEL
    return kind, follow.ravel(), count.ravel()


KIND, NEXT, COUNT = tables()


class Scan:
    """One scan of many texts (as UTF-8): characters, units and sentinels of each, and what is needed to find a unit's end.

    Texts are cut into blocks of BLOCK bytes and all blocks run through the automaton side by side, each from all four
    states, so a long text costs no more steps than short ones. Blocks then are composed, from the start of each text.
    """

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        blocks = -(-self.sizes // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(blocks)])
        total = int(self.first[-1])
        kinds = np.full(total * BLOCK, PAD, np.uint8)
        for t, at in zip(texts, (self.first * BLOCK).tolist()):
            kinds[at : at + len(t)] = KIND[np.frombuffer(t, np.uint8)]
        self.kinds = kinds.reshape(total, BLOCK).T.copy()  # a row a step
        state = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], total, 1)
        counts = np.zeros((N_STATES, total), np.int32)
        for step in self.kinds:
            place = state * np.uint8(N_CLASSES) + step
            counts += COUNT[place]
            state = NEXT[place]
        self.entry = self.composed(state)
        own = counts[self.entry, np.arange(total)].astype(np.int64)
        # totals before each block, in the order of all texts
        self.units = np.concatenate([[0], np.cumsum(own >> 10 & 1023)])
        self.chars = np.concatenate([[0], np.cumsum(own & 1023)])
        marks = np.concatenate([[0], np.cumsum(own >> 20)])
        spans = lambda sums: sums[self.first[1:]] - sums[self.first[:-1]]
        self.n_chars, self.sentinels = spans(self.chars), spans(marks)
        self.n = spans(self.units) + (self.sizes > 0)  # the last unit ends with its text

    def composed(self, state: np.ndarray) -> np.ndarray:
        """The state in which each block is entered: prefix compositions of the blocks' maps, by doubling."""
        total = state.shape[1]
        starts = np.zeros(total, bool)
        starts[self.first[:-1][self.first[:-1] < self.first[1:]]] = True
        maps = np.where(starts, state[GAP], state)  # a text begins in GAP, whatever came before it
        reach = 1
        while reach < total:
            later = np.take_along_axis(maps[:, reach:], maps[:, :-reach], 0)
            maps = np.concatenate([maps[:, :reach], later], 1)
            reach *= 2
        entry = np.full(total, GAP, np.uint8)
        entry[1:] = maps[GAP, :-1]
        entry[starts] = GAP
        return entry

    def ends(self, text: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, characters) before the end of the unit-th unit of each listed text: 0 for unit 0, all for the last one.

        The second pass: counts before blocks tell the block, and the automaton runs through these blocks alone.
        """
        size, chars = np.where(unit >= self.n[text], self.sizes[text], 0), np.where(unit >= self.n[text], self.n_chars[text], 0)
        inner = np.flatnonzero((unit > 0) & (unit < self.n[text]))
        if len(inner):
            t = text[inner]
            goal = self.units[self.first[t]] + unit[inner]
            block = np.searchsorted(self.units, goal, "left") - 1
            state, seen = self.entry[block], self.units[block]
            passed, char = np.full(len(inner), -1), self.chars[block] - self.chars[self.first[t]]
            for k in range(BLOCK):
                place = state * np.uint8(N_CLASSES) + self.kinds[k, block]
                seen = seen + (COUNT[place] >> 10 & 1023)
                here = (seen == goal) & (passed < 0)
                passed[here] = k
                char = char + np.where(passed < 0, COUNT[place] & 1023, 0)
                state = NEXT[place]
            size[inner] = (block - self.first[t]) * BLOCK + passed
            chars[inner] = char
        return size, chars


def drawn(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the hex sha256 of `seed:doc_id`, as integers; a null id counts as no digits."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))


def restore(output: bytes, form: str) -> bytes:
    """The text from which an output of this form was made."""
    if form == "psm":
        prefix, rest = output[len(PREFIX) :].split(SUFFIX, 1)
        suffix, middle = rest.split(MIDDLE, 1)
    elif form == "spm":
        suffix, rest = output[len(SUFFIX) :].split(PREFIX, 1)
        prefix, middle = rest.split(MIDDLE, 1)
    else:
        return output
    return prefix + middle + suffix


def transformed(ids: list, texts: list[bytes], seed: int = 42, rate: int = 50, spm_rate: int = 80):
    """(n, form, prefix characters, middle characters, output) of each text.

    rate of 100 documents are cut, spm_rate of 100 of these put the suffix first. A text that is empty or holds a sentinel stays plain.
    """
    scan = Scan(texts)
    h = np.array([drawn(i, seed) for i in ids], np.int64).reshape(len(ids), 4)
    n = scan.n
    low, high = np.minimum(h[:, 0] % (n + 1), h[:, 1] % (n + 1)), np.maximum(h[:, 0] % (n + 1), h[:, 1] % (n + 1))
    plain = (scan.sizes == 0) | (scan.sentinels > 0) | (h[:, 2] % 100 >= rate)
    cut = np.flatnonzero(~plain)
    (a, a_chars), (b, b_chars) = scan.ends(cut, low[cut]), scan.ends(cut, high[cut])
    out = [(int(k), "plain", None, None, t) for k, t in zip(n, texts)]
    for j, i in enumerate(cut.tolist()):
        t = texts[i]
        prefix, middle, suffix = t[: a[j]], t[a[j] : b[j]], t[b[j] :]
        spm = h[i, 3] % 100 < spm_rate
        made = SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if spm else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
        out[i] = (int(n[i]), "spm" if spm else "psm", int(a_chars[j]), int(b_chars[j] - a_chars[j]), made)
    return out


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, digests: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row; with digests, of the output and of the text
    rebuilt from it, the sha256 instead.

    Whole texts of any length; a null text is empty and, as an empty one, plain with n = 0; a null id is hashed as no
    digits; repeated rows stay repeated, extra columns are not read, no rows give none. One pass without a shuffle.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                made = transformed(part.column("doc_id").to_pylist(), texts, seed, rate, spm_rate)
                n, form, prefix, middle, output = zip(*made)
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
                if digests:
                    cols += [pa.array([hashlib.sha256(o).hexdigest() for o in output]), pa.array([hashlib.sha256(restore(o, f)).hexdigest() for o, f in zip(output, form)])]
                else:
                    cols.append(pa.array([o.decode() for o in output], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", *(("output_sha256", "restored_sha256") if digests else ("output",))])

    last = "output_sha256 string, restored_sha256 string" if digests else "output string"
    return id_text(df, id_col, text_col).mapInArrow(run, f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {last}")
