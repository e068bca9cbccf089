"""Similarity and scoring kernels as columns. Null means not applicable; a missed object scores 0."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def let(body, **values: Column) -> Column:
    """body of a struct of values, each of which is worked out once however often body names it."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 1)


def kept(df: DataFrame, **values: Column) -> DataFrame:
    """df with columns that are worked out once a row: what is built on them names them, and the optimizer doesn't put their expressions in its place."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def prf(tp: Column, predicted: Column, reference: Column) -> Column:
    """struct(precision, recall, f1) of counts; nothing predicted and nothing expected is perfect."""

    def body(v):
        p = F.when(v["p"] > 0, F.when(v["r"] > 0, v["t"] / v["p"]).otherwise(0.0)).otherwise(1.0)
        r = F.when(v["r"] > 0, F.when(v["p"] > 0, v["t"] / v["r"]).otherwise(0.0)).otherwise(1.0)
        f1 = F.when(v["p"] + v["r"] == 0, 1.0).otherwise(2 * v["t"] / F.greatest(v["p"] + v["r"], F.lit(1.0)))
        return F.when(v["t"].isNotNull(), F.struct(p.alias("precision"), r.alias("recall"), f1.alias("f1")))

    return let(body, t=tp.cast("double"), p=predicted.cast("double"), r=reference.cast("double"))


@F.pandas_udf(IntegerType())
def multiset_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the multiset intersection of two arrays, in time linear in their lengths."""
    return pd.Series([None if x is None or y is None else (Counter(x) & Counter(y)).total() for x, y in zip(a, b)], dtype="Int32")


def multiset_prf(reference: Column, predicted: Column) -> Column:
    return prf(multiset_overlap(reference, predicted), F.size(predicted), F.size(reference))


def set_prf(reference: Column, predicted: Column) -> Column:
    return prf(F.size(F.array_intersect(reference, predicted)), F.size(F.array_distinct(predicted)), F.size(F.array_distinct(reference)))


def error_rate(distance: Column, reference_length: Column, predicted_length: Column) -> Column:
    """Distance by the reference's length; may exceed 1; of an empty reference 0 or 1."""
    return let(lambda v: F.when(v["n"] == 0, F.when(v["m"] == 0, 0.0).otherwise(1.0)).otherwise(F.try_divide(v["d"].cast("double"), v["n"])), d=distance, n=reference_length, m=predicted_length)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def edit_distance(a, b) -> int:
    """Least number of insertions, deletions and replacements between two sequences of any length.

    Myers' bit vectors as Python integers of the longer one's length, one step an item of the shorter one.
    """
    if len(a) < len(b):
        a, b = b, a
    start, end = 0, 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    while end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not len(b):
        return len(a)
    places: dict = {}
    wanted = set(b)
    for i, x in enumerate(a):
        if x in wanted:
            places.setdefault(x, []).append(i)

    def bits(at: list[int]) -> int:
        held = bytearray(len(a) // 8 + 1)
        for i in at:
            held[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(held, "little")

    common = {x: bits(at) for x, at in places.items() if 256 * len(at) >= len(a)}  # at most 256; the others are made when met
    mask = (1 << len(a)) - 1
    up, down = mask, 0
    for x in b:
        same = common.get(x)
        if same is None:
            same = bits(places[x]) if x in places else 0
        v = same | down
        h = ((((same & up) + up) ^ up) | same) & mask
        more, less = down | (mask ^ (h | up)), up & h
        more, less = ((more << 1) | 1) & mask, (less << 1) & mask
        up, down = less | (mask ^ ((v | more) & mask)), more & v
    return len(b) + up.bit_count() - down.bit_count()


#: Blocks of 64 items that run side by side, unless one pair has more, and the entries of a pair's bit masks that are still held at once.
LANES, MASKS = 4096, 1 << 22


class _Pair:
    """A pair of arrays of codes whose distance is being worked out: its bit vectors, a block of 64 items of the longer array
    each (the first one's low bits are padded), and how far they are."""

    def __init__(self, i: int, a: np.ndarray, b: np.ndarray):
        names, own = np.unique(b, return_inverse=True)
        self.i, self.blocks, self.width = i, -(-len(a) // 64), len(names) + 1
        pad = 64 * self.blocks - len(a)
        place = np.minimum(np.searchsorted(names, a), len(names) - 1)
        hit = np.flatnonzero(names[place] == a)
        row = hit + pad
        self.masks = np.zeros(self.blocks * self.width, np.uint64)
        np.add.at(self.masks, (row >> 6) * self.width + place[hit], np.uint64(1) << (row & 63).astype(np.uint64))
        self.text = np.full(len(b) + 2 * self.blocks, len(names), np.int64)  # before and behind it, what no item equals
        self.text[self.blocks : self.blocks + len(b)] = own
        self.state = np.zeros((4, self.blocks), np.uint64)  # differences upwards and downwards, and those passed on
        self.state[0] = 2**64 - 1
        self.state[0, 0] <<= np.uint64(pad)
        self.done, self.steps, self.distance = 0, len(b) + self.blocks - 1, len(a)


def _run(pairs: list[_Pair], least: int) -> None:
    """All pairs' next steps, until they end or fewer than `least` blocks still have steps; those with most steps come first.

    Myers' bit vectors of all blocks at once: in each step a block takes the item of the second array that the block before
    it took one step ago, with the difference that this one passed on.
    """
    one, top = np.uint64(1), np.uint64(63)
    blocks, width = np.array([p.blocks for p in pairs]), np.array([p.width for p in pairs])
    last = np.cumsum(blocks) - 1
    first = last - blocks + 1
    lanes = int(last[-1]) + 1
    text, masks, state = np.concatenate([p.text for p in pairs]), np.concatenate([p.masks for p in pairs]), np.concatenate([p.state for p in pairs], axis=1)
    offset = lambda parts: np.cumsum([0, *map(len, parts)])[:-1]
    own = np.arange(lanes) - np.repeat(first, blocks)
    base = np.repeat(offset([p.masks for p in pairs]), blocks) + np.repeat(width, blocks) * own
    at = np.repeat(offset([p.text for p in pairs]) + blocks + [p.done for p in pairs], blocks) - own
    code, work = np.empty(lanes, np.int64), np.empty((7, lanes), np.uint64)
    change = np.zeros(len(pairs), np.int64)
    ran = 0
    for p in range(len(pairs) - 1, -1, -1):  # the first p + 1 pairs still run
        n, begin, end, total = int(last[p]) + 1, first[: p + 1], last[: p + 1], change[: p + 1]
        if n < least:
            break
        at_, base_, code_ = at[:n], base[:n], code[:n]
        up, down, plus, minus = (x[:n] for x in state)
        same, xv, xh, more, less, plus_out, minus_out = (x[:n] for x in work)
        gap = minus_out.view(np.int64)
        for _ in range(pairs[p].steps - pairs[p].done - ran):
            plus[begin] = one
            minus[begin] = 0
            text.take(at_, out=code_, mode="clip")
            np.add(code_, base_, out=code_)
            masks.take(code_, out=same, mode="clip")
            np.add(at_, 1, out=at_)
            np.bitwise_or(same, down, out=xv)
            np.bitwise_or(same, minus, out=same)
            np.bitwise_and(same, up, out=xh)
            np.add(xh, up, out=xh)
            np.bitwise_xor(xh, up, out=xh)
            np.bitwise_or(xh, same, out=xh)
            np.bitwise_or(xh, up, out=more)
            np.invert(more, out=more)
            np.bitwise_or(more, down, out=more)
            np.bitwise_and(up, xh, out=less)
            np.right_shift(more, top, out=plus_out)
            np.right_shift(less, top, out=minus_out)
            np.left_shift(more, one, out=more)
            np.bitwise_or(more, plus, out=more)
            np.left_shift(less, one, out=less)
            np.bitwise_or(less, minus, out=less)
            np.bitwise_or(xv, more, out=up)
            np.invert(up, out=up)
            np.bitwise_or(up, less, out=up)
            np.bitwise_and(more, xv, out=down)
            plus[1:] = plus_out[:-1]
            minus[1:] = minus_out[:-1]
            np.subtract(plus_out, minus_out, out=minus_out)
            total += gap[end]
        ran = pairs[p].steps - pairs[p].done
    for p, start, c in zip(pairs, first, change):
        p.distance += int(c)
        p.done = min(p.steps, p.done + ran)
        p.state = state[:, start : start + p.blocks].copy()


def edit_distances(pairs) -> list[int | None]:
    """edit_distance of each pair of arrays of codes (null where one is missing); pairs of few steps and many blocks go one by one."""
    out: list[int | None] = [None] * len(pairs)
    todo = []
    for i, (a, b) in enumerate(pairs):
        if a is None or b is None:
            continue
        if len(a) < len(b):
            a, b = b, a
        apart = np.flatnonzero(a[: len(b)] != b)
        start = int(apart[0]) if len(apart) else len(b)
        a, b = a[start:], b[start:]
        apart = np.flatnonzero(a[len(a) - len(b) :] != b)
        end = len(b) - 1 - int(apart[-1]) if len(apart) else len(b)
        a, b = a[: len(a) - end], b[: len(b) - end]
        blocks = -(-len(a) // 64)
        if not len(b):
            out[i] = len(a)
        elif 2 * len(b) < blocks or blocks * len(b) > MASKS and blocks * len(np.unique(b)) > MASKS:
            out[i] = edit_distance(a.tolist(), b.tolist())
        else:
            todo.append((len(b) + blocks, i, a, b))
    todo.sort(key=lambda x: x[0])  # longest last
    live: list[_Pair] = []
    while live or todo:
        lanes, held = sum(p.blocks for p in live), sum(len(p.masks) for p in live)
        while todo and lanes < LANES and held < MASKS:
            live.append(_Pair(*todo.pop()[1:]))
            lanes, held = lanes + live[-1].blocks, held + len(live[-1].masks)
        live.sort(key=lambda p: p.done - p.steps)
        _run(live, lanes * 3 // 4 if todo else 0)
        for p in live:
            if p.done == p.steps:
                out[p.i] = p.distance
        live = [p for p in live if p.done < p.steps]
    return out


def _points(s: str | None) -> np.ndarray | None:
    """Code points of a text."""
    return None if s is None else np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


@F.pandas_udf(IntegerType())
def distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two texts in characters (code points)."""
    return pd.Series(edit_distances([*zip(a.map(_points), b.map(_points))]), dtype="Int32")


@F.pandas_udf(IntegerType())
def token_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of token arrays."""

    def codes(x, y):
        if x is None or y is None:
            return None, None
        places: dict = {}
        return tuple(np.array([places.setdefault(w, len(places)) for w in v], np.int64) for v in (x, y))

    return pd.Series(edit_distances([codes(x, y) for x, y in zip(a, b)]), dtype="Int32")


#: Words between white space of any script.
_WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@F.pandas_udf(StructType([StructField(k, IntegerType()) for k in ("characters", "words", "n", "m")]))
def text_distances(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """distance of two texts, token_distance of their word_tokens, and how many words each has; a missing text has none."""
    words, sizes = [], []
    for x, y in zip(a, b):
        places: dict = {}
        both = [_WORD.findall(t or "") for t in (x, y)]
        sizes.append([len(t) for t in both])
        words.append([np.array([places.setdefault(w, len(places)) for w in t], np.int64) for t in both])
    out = pd.DataFrame(sizes, columns=["n", "m"], dtype="Int32")
    return out.assign(words=pd.array(edit_distances(words), dtype="Int32"), characters=pd.array(edit_distances([*zip(a.map(_points), b.map(_points))]), dtype="Int32"))[["characters", "words", "n", "m"]]


def farther(a: Column, b: Column, most: Column) -> Column:
    """Whether two texts' edit distance is over a number; it isn't worked out where their lengths alone say so."""
    apart = F.abs(F.length(a) - F.length(b)) > most
    near = F.when(~apart, a), F.when(~apart, b)
    return apart | (distance(*near) > most)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the distance by the longer length; two empty texts are alike."""
    return let(lambda v: F.when(v["n"] == 0, 1.0).otherwise(1 - F.try_divide(v["d"].cast("double"), v["n"])), d=distance(a, b), n=F.greatest(F.length(a), F.length(b)))


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def box_overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for a null box or an empty union."""
    both = box_overlap(a, b)
    return F.coalesce(F.when(box_area(a) + box_area(b) - both > 0, both / (box_area(a) + box_area(b) - both)), F.lit(0.0))


def box_ios(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    least = F.least(box_area(a), box_area(b))
    return F.coalesce(F.when(least > 0, box_overlap(a, b) / least), F.lit(0.0))


def weighted_mean(pairs: list[tuple[float, Column]]) -> Column:
    """Weighted mean of the values that are not null; null if all are. A negative weight is an error."""
    if any(w < 0 for w, _ in pairs):
        raise ValueError("a weight is negative")
    held = F.filter(F.array(*[F.struct(F.lit(float(w)).alias("w"), v.cast("double").alias("v")) for w, v in pairs]), lambda x: x["v"].isNotNull())
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    return F.aggregate(held, zero, lambda acc, x: F.struct((acc["s"] + x["w"] * x["v"]).alias("s"), (acc["w"] + x["w"]).alias("w")), lambda acc: F.try_divide(acc["s"], acc["w"]))


def composition_similarity(a: Column, b: Column) -> Column:
    """1 less the share of atoms that differ; null counts as 0."""
    gap = F.map_zip_with(a, b, lambda k, x, y: F.struct(F.abs(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).alias("d"), (F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))).alias("s")))
    total = F.aggregate(F.map_values(gap), F.struct(F.lit(0).alias("d"), F.lit(0).alias("s")), lambda acc, v: F.struct((acc["d"] + v["d"]).alias("d"), (acc["s"] + v["s"]).alias("s")))
    return F.coalesce(F.when(total["s"] == 0, 1.0).otherwise(1 - F.try_divide(total["d"].cast("double"), total["s"])), F.lit(0.0))
