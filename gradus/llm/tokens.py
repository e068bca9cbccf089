"""Whole-text tokenization by the tokenizers library, one call per distinct piece of text."""

from __future__ import annotations

import base64
import os
import re
from array import array

import numpy as np

#: The splitting pattern of the word-end BPE file (its pre_tokenizer holds the same string).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Chunks(dict):
    """chunk -> made(chunk), kept in two generations: when the young one is full it becomes the old one."""

    def __init__(self, make, limit: int = 100_000, long: int = 64):
        self.make, self.limit, self.long, self.old = make, limit, long, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.long:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


#: Texts without other characters than these split alike by any Unicode version: NFC changes nothing, lower-casing has
#: no context, white space is tab to carriage return and the space, letters and numbers are the classes below.
ODD = re.compile("[^\t-\r -~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f]").search
L = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
N = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"


class WordBpe:
    """Ids of texts by a lower-casing word-end BPE whose pre-tokenizer never crosses white space.

    Such a tokenizer normalizes and merges each piece alone, so a text's ids are the concatenation of its pieces'
    ids; the pieces are kept with their ids (as bytes). A text of Latin characters is lower-cased and split here, and
    each new piece goes to the library's BPE model; of any other text, each new chunk between ASCII white space goes
    through the whole library tokenizer. The strings of special tokens are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.model = self.lib.model
        self.split = re.compile(WORD_PATTERN.replace(r"\p{L}", L).replace(r"\p{N}", N)).findall
        self.chars = dict(enumerate(byte_chars()))
        self.pieces, self.chunks = Chunks(self.piece, 200_000), Chunks(self.chunk, 25_000)

    def piece(self, p: str) -> bytes:
        shown = p if p.isascii() else p.encode().decode("latin-1").translate(self.chars)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def chunk(self, word: bytes) -> bytes:
        return array("I", self.lib.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        piece, chunk, split = self.pieces.__getitem__, self.chunks.__getitem__, self.split
        out = []
        for t in texts:
            t = t or ""
            out.append(b"".join(map(chunk, t.encode().split())) if ODD(t) else b"".join(map(piece, split(t.lower()))))
        return out


class ByteBpe:
    """Byte-level BPE by a rank file: the tokenizers library merges each match of the pattern, as tiktoken would.

    Every way to make a token from two is a merge, in the order of the tokens' ranks; a match that is a token whole is
    taken whole. Matches are kept with their ids; a text with other than Latin characters goes through the library's
    own splitter. table[id] is a token's bytes.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        chars = byte_chars()
        shown = lambda b: "".join([chars[x] for x in b])
        merges = [
            (shown(k[:i]), shown(k[i:]))
            for k in sorted(ranks, key=ranks.get)
            for i in range(len(k) - 1, 0, -1)
            if k[:i] in ranks and k[i:] in ranks
        ]
        self.lib = Tokenizer(models.BPE(vocab={shown(k): v for k, v in ranks.items()}, merges=merges, ignore_merges=True))
        self.lib.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.model = self.lib.model
        self.split = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{L}{N}]").replace(r"\p{L}", f"[{L}]").replace(r"\p{N}", f"[{N}]")).findall
        self.chars = dict(enumerate(chars))
        self.pieces = Chunks(self.piece)
        # the byte table reversed: characters of a vocabulary entry back to its bytes
        back = {c: b for b, c in enumerate(chars)}
        self.table = [b""] * (max(ranks.values()) + 1)
        for entry, i in self.lib.get_vocab().items():
            self.table[i] = bytes([back[c] for c in entry])
        self.sizes = np.array([len(b) for b in self.table], np.int64)

    def piece(self, p: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.chars))]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        piece, split, lib = self.pieces.__getitem__, self.split, self.lib
        return [array("I", lib.encode(t, add_special_tokens=False).ids).tobytes() if ODD(t) else b"".join(map(piece, split(t))) for t in (x or "" for x in texts)]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all tokens in a row; a character that was split between tokens is whole again."""
        return b"".join(map(self.table.__getitem__, array("I", ids)))

    def spans(self, ids: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last; of a split character each part spans all of it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])
        start = np.concatenate([[0], end[:-1]]).astype(np.int64) if len(end) else end
        return (char[start], char[end - 1] + 1) if len(end) else (end, end)


_kept: dict = {}


def kept(kind, *args):
    """One tokenizer a worker process."""
    if (kind, args) not in _kept:
        _kept[kind, args] = kind(*args)
    return _kept[kind, args]


def slices(batch, budget: int = 2_000_000, column: str = "text"):
    """Cut an Arrow batch so that each part holds about budget bytes of its text (or other) column, or one row."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > budget:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)
