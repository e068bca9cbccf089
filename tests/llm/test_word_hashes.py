"""Word hashes: equal words alike whatever their text and case, others apart; words as the contract has them."""

import random
import re

import numpy as np
import pyarrow as pa

from gradus.llm import common

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_words_of_whole_texts(monkeypatch):
    rng = random.Random(3)
    pool = ["a", "B", "b", "é", "É", "𝄞", "x1", "\x1c", " ", " ", " ", "\n", "\t", "\x0b", "\x85"]
    texts = ["", " ", "one", "One ONE"] + ["".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(400)] + ["w" * 5000 + " w " + "w" * 4999, ""]
    seen: dict[bytes, int] = {}
    for piece in (1 << 20, 64, 7):  # words longer than a piece, too
        monkeypatch.setattr(common, "PIECE", piece)
        for column in (pa.array(texts), pa.array(["skip me", *texts])[1:], pa.array(texts, pa.large_string())):
            h, size = common.word_hashes(column)
            words = [WORD.findall(t.encode()) for t in texts]
            assert size.tolist() == [len(w) for w in words]
            for w, x in zip((w for ws in words for w in ws), h.tolist()):
                low = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
                assert seen.setdefault(low, x) == x
    assert len(set(seen.values())) == len(seen)
    assert [len(x) for x in common.word_hashes(pa.array([], pa.string()))] == [0, 0]


def test_few_bits_are_alike():
    words = [f"w{i}" for i in range(200_000)]
    h, _ = common.word_hashes(pa.array([" ".join(words)]))
    assert len(np.unique(h)) == len(words)
    counts = np.bincount((h >> np.uint64(56)).astype(int), minlength=256)
    assert counts.min() > 600 and counts.max() < 1000
