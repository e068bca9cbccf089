"""N-gram Jaccard join by vertical partitioning: the global n-gram order cut into fragments."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import MIX, Scratch, components, few, gram_hashes, id_text, mix64, word_hashes
from gradus.llm.tokens import slices


def spare(differ: int) -> int:
    """Fragments beyond the pigeonhole's need: they grow with the fragments, as the empty ones do, and outnumber these but by rare chance."""
    return 4 + differ // 6


def shingles(texts, n: int) -> list[np.ndarray]:
    """For each text of an Arrow column, the sorted hashes of its distinct n-word shingles."""
    h, size = word_hashes(texts)
    ends = np.cumsum(size)
    return [np.unique(gram_hashes(h[e - s : e], n)) for s, e in zip(size.tolist(), ends.tolist())]


class Classes:
    """Size classes and their fragments for the threshold num / den.

    Linked sets differ by at most (den - num) / (den + num) of their sizes' sum and their sizes lie in one class or in
    two neighbouring ones. A class whose largest size is s cuts the order of hashes into D(s) + 1 + SPARE fragments of
    equal width, SPARE = spare(D(s)); D(s) differing n-grams spoil D(s) fragments at most, so two linked sets agree wholly on more than
    SPARE fragments.
    """

    def __init__(self, num: int, den: int, limit: int = 1 << 40):
        sizes = [den // (den - num) - 1 if den > num else limit]
        while sizes[-1] < limit:
            sizes.append(max(sizes[-1] + 1, sizes[-1] * den // num))
        self.sizes = np.array(sizes, np.int64)
        self.num, self.den = num, den

    def fragments(self, c: int) -> tuple[int, int]:
        """How many fragments a class has and how many of them may differ."""
        differ = int(2 * self.sizes[c] * (self.den - self.num) // (self.den + self.num))
        return (differ + 1 + spare(differ), differ) if differ else (0, 0)

    def keys(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and 1 for the first of each class: a hash of (class, fragment, its n-grams) for the first D + 1 fragments with n-grams, in the set's class and the next one.

        Of two linked sets, take the one whose D + 1 fragments end earlier: one of them agrees, and as it isn't empty and
        lies before the other's end, it is among the other's first ones too. A set with fewer than D + 1 such
        fragments gives a key for each of them and for each empty one.
        """
        out, starts = [], []
        c = int(np.searchsorted(self.sizes, len(grams)))
        for k in (c, c + 1):
            cuts, differ = self.fragments(k)
            if not cuts:
                continue  # so small that only equal sets are linked
            frag = ((grams >> np.uint64(32)) * np.uint64(cuts)) >> np.uint64(32)
            at = np.flatnonzero(np.diff(frag, prepend=np.uint64(cuts)))
            sums = np.add.reduceat(mix64(grams), at)  # an order-free digest of a fragment's n-grams
            tag = np.uint64(k) << np.uint64(40)
            starts.append(sum(map(len, out)))
            out.append(mix64(mix64(sums ^ mix64(frag[at] + tag)) + np.uint64(k))[: differ + 1])
            if len(at) <= differ:  # the fragments that agree could all be empty
                empty = np.setdiff1d(np.arange(cuts, dtype=np.uint64), frag[at])
                out.append(mix64(mix64(empty + tag) + np.uint64(1)))
        keys = np.concatenate(out) if out else np.zeros(0, np.uint64)
        first = np.zeros(len(keys), np.int8)
        first[starts] = 1
        return keys, first


def bitmap(grams: np.ndarray) -> bytes:
    """Parities of how many n-grams fall on each place: as many bits as n-grams, up to a power of two, 64 at least.

    Two bitmaps differ in no more places than the sets in n-grams. Half as wide a bitmap is one half xor the other.
    """
    width = max(64, 1 << max(0, len(grams) - 1).bit_length())
    return np.packbits(np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(x: int, y: int, wide_x: int, wide_y: int) -> int:
    """In how many places two bitmaps (as numbers) differ, at the smaller of their widths in bits."""
    while wide_x > wide_y:
        wide_x //= 2
        x = (x >> wide_x) ^ (x & ((1 << wide_x) - 1))
    while wide_y > wide_x:
        wide_y //= 2
        y = (y >> wide_y) ^ (y & ((1 << wide_y) - 1))
    return (x ^ y).bit_count()


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set and its bitmap (null for an empty one)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                grams = shingles(part.column("text"), n)
                size = np.array([len(g) for g in grams], np.int64)
                with np.errstate(over="ignore"):
                    one = np.array([mix64(g).sum(dtype=np.uint64) for g in grams], np.uint64).astype(np.int64)
                    two = np.array([mix64(g ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64) for g in grams], np.uint64).astype(np.int64)
                none = size == 0
                bits = pa.array([bitmap(g) if len(g) else None for g in grams], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(one, mask=none), pa.array(two, mask=none), bits], names=["doc_id", "n_shingles", "h1", "h2", "bits"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bits binary")


WIDE = 40  # a row's spread: how far from it the documents that it stands for are, times 2 ** WIDE, plus their largest size


def key_rows(docs: DataFrame, n: int, classes: Classes) -> DataFrame:
    """(key, a, spread, lead): which document holds which fragment key; spread 0 for a document that stands for itself
    alone; lead 1 for a set's first key in each class, and for ties.

    Within a batch, documents of one key with bitmaps of one width that differ by at most a quarter of what links allow
    from the first such one are tied to that one and not sent on, so a key that a large group of near copies holds
    arrives as about one row a batch. A tie is two rows of a key of its own.
    """
    num, den = classes.num, classes.den

    def run(batches):
        for batch in batches:
            for part in slices(batch, 4_000_000):
                doc, key, leads, size, wide, bits = [], [], [], [], [], []
                seen: dict[tuple[bytes, bytes], int] = {}
                ties: set[tuple[int, int]] = set()
                ids, sets = part.column("doc_id").to_pylist(), shingles(part.column("text"), n)
                for d, i in sorted(zip(ids, range(len(ids)))):
                    grams = sets[i]
                    k, first_keys = classes.keys(grams)
                    if not len(k):
                        continue  # no n-grams, or so few that only equal sets are linked
                    own = bitmap(grams)
                    if (first := seen.setdefault((k.tobytes(), own), d)) != d:
                        ties.add((first, d))  # the same throughout: most often copies
                        continue
                    key.append(k)
                    leads.append(first_keys)
                    doc.append(d)
                    size.append(len(grams))
                    wide.append(8 * len(own))
                    bits.append(int.from_bytes(own, "little"))
                if not key:
                    continue
                at = np.repeat(np.arange(len(doc)), [len(k) for k in key])
                key = np.concatenate(key)
                order = np.argsort(key, kind="stable")  # ids ascend within a key
                key, at = key[order], at[order]
                new = np.flatnonzero(np.diff(key, prepend=key[0] ^ np.uint64(1)))
                many = np.diff(np.append(new, len(key)))
                send = np.ones(len(key), bool)
                spread = np.zeros(len(key), np.int64)
                for start, stop in zip(new[many > 1].tolist(), (new + many)[many > 1].tolist()):
                    heads: list[list[int]] = []  # place among the rows, document, radius, largest size
                    for r, x in enumerate(at[start:stop].tolist(), start):
                        near = size[x] * (den - num) // (2 * (den + num))
                        for h in heads:
                            z = h[1]
                            if wide[z] == wide[x]:
                                if (apart := (bits[z] ^ bits[x]).bit_count()) <= near:
                                    h[2], h[3] = max(h[2], apart), max(h[3], size[x])
                                    send[r] = False
                                    if doc[z] != doc[x]:
                                        ties.add((doc[z], doc[x]))
                                    break
                        else:
                            heads.append([r, x, 0, size[x]])
                    for r, _, radius, most in heads:
                        spread[r] = (radius << WIDE) + most
                ids = np.array(doc, np.int64)[at]
                pairs = np.array(sorted(ties), np.int64).reshape(-1, 2)
                tie = mix64(mix64(pairs[:, 0].astype(np.uint64)) * MIX + pairs[:, 1].astype(np.uint64))
                keys = np.concatenate([key[send], tie, tie]).astype(np.int64)
                lead = np.concatenate([np.concatenate(leads)[order][send], np.ones(2 * len(pairs), np.int8)])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([ids[send], pairs[:, 0], pairs[:, 1]])), pa.array(np.concatenate([spread[send], np.zeros(2 * len(pairs), np.int64)])), pa.array(lead)], names=["key", "a", "spread", "lead"])

    return docs.mapInArrow(run, "key long, a long, spread long, lead byte")


def candidate_edges(docs: DataFrame, sized: DataFrame, n: int, classes: Classes, scratch: Scratch, block: int = 1024) -> DataFrame:
    """(a, b): edges that connect all pairs that share a fragment key and whose bitmaps allow a link, few of them spare.

    A bucket is the documents of one key; buckets with the same documents count once. Bitmaps meet in blocks of at most
    2 * block rows: a larger bucket is cut by a hash into chunks, and each pair of chunks is a block. What a row stands
    for besides itself is at most its radius away, so two rows may hold a link if their bitmaps differ by no more than
    links of their largest sizes allow and both radii.

    Near copies share most of their keys, so the rows of leading keys go first; then, in all buckets, only documents that
    these left apart are compared and connected.
    """
    num, den = classes.num, classes.den
    own = Window.partitionBy("key")
    rows = key_rows(docs, n, classes).select("key", "a", "spread", "lead", F.count("*").over(own).alias("many"), F.bit_xor(F.xxhash64("a", "spread")).over(own).alias("bucket"))
    rows = rows.where("many > 1").groupBy("bucket", "many", "a", "spread").agg(F.max("lead").alias("lead"))
    rows = scratch.save(rows, "buckets")

    def differ(rows: list[tuple], parent: dict[int, int]):
        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        across = rows[0][2] != rows[0][3]
        apart: dict[int, list[tuple]] = {}  # rows seen so far by what they are connected to
        for _, _, _, _, a, spread, chunk, size, label, bits in rows:
            at, most, radius, wide, bits = root(label), (spread & ((1 << WIDE) - 1)) or size, spread >> WIDE, 8 * len(bits), int.from_bytes(bits, "little")
            for other in [k for k in apart if k != at]:
                for b, chunk_b, most_b, radius_b, wide_b, bits_b in apart[other]:
                    if (not across or chunk != chunk_b) and differing(bits, bits_b, wide, wide_b) <= (most + most_b) * (den - num) // (den + num) + radius + radius_b:
                        yield a, b
                        low, high = min(at, other), max(at, other)
                        parent[high] = low
                        apart[low] = apart.get(low, []) + apart.pop(high, [])
                        at = low
                        break
            apart.setdefault(at, []).append((a, chunk, most, radius, wide, bits))

    def run(batches):
        last, rows, out = None, [], []
        parent: dict[int, int] = {}  # of all the task's buckets so far: what is connected isn't connected again
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] != last:
                    if len(rows) > 1:
                        out.extend(differ(rows, parent))
                    last, rows = row[:4], []
                rows.append(row)
            if len(out) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
                out = []
        if len(rows) > 1:
            out.extend(differ(rows, parent))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def connected(rows: DataFrame, label: str) -> DataFrame:
        held = rows.join(sized.where("bits is not null").select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("size"), "bits"), "a")
        held = held.withColumn("chunks", F.ceil(F.col("many") / block).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int"))
        held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
        held = held.select("bucket", "many", "i", "j", "a", "spread", "chunk", "size", F.expr(label).alias("label"), "bits")
        return held.repartition("bucket", "many", "i", "j").sortWithinPartitions("bucket", "many", "i", "j", "chunk").mapInArrow(run, "a long, b long")

    first = scratch.save(connected(rows.where("lead = 1"), "a").distinct(), "first")
    met = components(first, scratch, "met").select(F.col("node").alias("a"), "label")
    rest = rows.join(met, "a", "left").withColumn("label", F.coalesce("label", "a"))  # a key may lead for some of its documents only
    apart = rest.groupBy("bucket", "many").agg(F.count_distinct("label").alias("labels")).where("labels > 1").select("bucket", "many")
    return first.unionByName(connected(rest.join(apart, ["bucket", "many"], "left_semi"), "label"))


def overlaps(sets: list[np.ndarray], rows: range, cols: range, width: int = 4096) -> np.ndarray:
    """|x & y| for x of rows and y of cols: counts within each fragment of the order, summed over the fragments."""
    both = [*rows, *cols]
    grams = np.concatenate([sets[i] for i in both])
    owner = np.repeat(np.arange(len(both)), [len(sets[i]) for i in both])
    shared, place, many = np.unique(grams, return_inverse=True, return_counts=True)
    rank = np.cumsum(many > 1) - 1
    hold = many[place] > 1
    place, owner = rank[place[hold]], owner[hold]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    total = np.zeros((len(rows), len(cols)), np.float32)
    for start in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        a, b = np.searchsorted(place, (start, start + width))
        part = np.zeros((len(both), width), np.float32)
        part[owner[a:b], place[a:b] - start] = 1
        total += part[: len(rows)] @ part[len(rows) :].T
    return total


def links_within(ids: np.ndarray, sets: list[np.ndarray], cut: int, num: int, den: int, tile: int = 1024) -> list[tuple[int, int]]:
    """A spanning forest of all links among sets[:cut] x sets[cut:] (or, with cut 0, among all); exact counts."""
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    size = np.array([len(s) for s in sets], np.float64)
    out = []
    left, right = (range(len(ids)), range(len(ids))) if not cut else (range(cut), range(cut, len(ids)))
    for r0 in range(left.start, left.stop, tile):
        rows = range(r0, min(left.stop, r0 + tile))
        for c0 in range(right.start, right.stop, tile):
            cols = range(c0, min(right.stop, c0 + tile))
            if not cut and c0 < r0:
                continue
            both = overlaps(sets, rows, cols).astype(np.float64)
            union = size[rows.start : rows.stop, None] + size[None, cols.start : cols.stop] - both
            for i, j in zip(*np.nonzero((both > 0) & (den * both >= num * union))):
                a, b = root(rows.start + int(i)), root(cols.start + int(j))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(ids[rows.start + int(i)]), int(ids[cols.start + int(j)])))
    return out


def jaccard_components(df: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = 1_000_000, block_rows: int = 2048) -> DataFrame:
    """doc_id, n_shingles, component_id: connected classes of documents whose sets of n-word shingles have
    den * |x & y| >= num * |x | y|; component_id is the smallest doc_id reachable.

    A document of fewer than n words has its whole sequence as one shingle; one without words (null, empty, white
    space) has none and is linked with nothing. Rows of one doc_id count as one node of the link graph and each is
    returned; rows without doc_id are returned unlinked, without component. No rows in, none out.

    Equal sets meet by their hashes. Different linked sets agree on a whole fragment of the global n-gram order
    (Classes) and their bitmaps differ by no more than the sets may, so the components of the pairs with both hold
    every link; they are candidate groups. Within each group, blocks of bounded size count overlaps fragment by fragment and sum them, and give back a spanning forest
    of the true links. A group too large for a block is cut by a hash into chunks, and each pair of chunks is a block.
    N-grams are told apart by 64-bit hashes.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "jaccard")
    classes = Classes(num, den)
    docs = id_text(df, id_col, text_col)
    known = docs.where(F.col("doc_id").isNotNull())
    sized = scratch.save(sets_of(docs, n), "sets")
    keys, mine = ["h1", "h2", "n_shingles"], sized.where("h1 is not null and doc_id is not null")
    same = scratch.save(mine.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("many")).where("many > 1"), "same")
    # sets that more than a thousandth of all rows hold, so fewer than 1000, meet their rows without a shuffle
    hot = F.broadcast(same.where(F.col("many") > max(1000, sized.count() // 1000)))
    rest = mine.join(hot.select(*keys), keys, "left_anti").join(same, keys)
    copies = mine.join(hot, keys).unionByName(rest).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"), *keys)
    copied = scratch.save(copies.distinct(), "copies")
    copies = copied.select("a", "b")
    shared = scratch.save(candidate_edges(known, sized, n, classes, scratch), "shared")
    groups = components(shared.unionByName(copies), scratch, "groups")
    # one document of each set stands for it; a repeated doc_id stays if any of its sets is no copy
    sets = sized.where("h1 is not null and doc_id is not null").groupBy(F.col("doc_id").alias("node")).agg(F.count_distinct("h1", "h2", "n_shingles").alias("sets"))
    dropped = copied.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("copies")).join(sets, "node").where("copies = sets")
    members = groups.join(dropped.select("node"), "node", "left_anti")
    several = members.groupBy("label").agg(F.count("*").alias("members")).where("members > 1")
    members = scratch.save(members.join(several, "label").select(F.col("node").alias("doc_id"), "label"), "members")

    def grams(batches):
        for batch in batches:
            for part in slices(batch):
                own = shingles(part.column("text"), n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([len(g) for g in own], pa.int64()), pa.array([g.tobytes() for g in own], pa.binary())], names=["doc_id", "label", "size", "grams"])

    texts = known.join(few(members), "doc_id").select("doc_id", "label", "text")
    held = scratch.save(texts.mapInArrow(grams, "doc_id long, label long, size long, grams binary"), "held")
    size = held.groupBy("label").agg(F.sum("size").alias("total"), F.count("*").alias("rows"))
    chunks = size.select("label", F.greatest(F.ceil(F.col("total") / block_shingles), F.ceil(F.col("rows") / block_rows)).cast("int").alias("chunks"))
    cut = held.join(chunks, "label").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    # chunk i meets every chunk j: as (i, j) with i <= j
    paired = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["doc_id", "grams"]).sort_values(["chunk", "doc_id"])
        sets = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
        chunk = rows["chunk"].to_numpy()
        first = int((chunk == chunk[0]).sum()) if len(chunk) else 0
        out = links_within(rows["doc_id"].to_numpy(), sets, first if first < len(chunk) else 0, num, den) if len(chunk) > 1 and (first < len(chunk) or rows["i"].iat[0] == rows["j"].iat[0]) else []
        return pd.DataFrame({"a": [a for a, _ in out], "b": [b for _, b in out]}, dtype="int64")

    links = scratch.save(paired.select("label", "i", "j", "doc_id", "chunk", "grams").groupBy("label", "i", "j").applyInPandas(block, "a long, b long"), "links")
    found = components(links.unionByName(copies), scratch, "found")
    out = sized.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
