"""Filter interaction audit: joint failures of all sets of filters, inverted to what every order of the filters removes."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)  # a set of filters is a number, filter k its bit k


def flags(text: Column) -> list[Column]:
    """Failures of A to D: under 50 words; under 65 % of them distinct; over 5 % capitals; a character of code or tables."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 50, 100 * distinct.cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, flags A to E as 0 or 1, n): how many documents of a part fail alike.

    Rows are narrow from the first shuffle on: an id, a digest, flags. They meet their labels by id; then rows of a
    digest are summed by part before the digests' smallest ids meet, so a text of which a third of all rows are copies
    is a row for each part and label there.
    """
    text = F.coalesce("text", F.lit(""))
    held = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *[f.cast("int").alias(k) for k, f in zip(FILTERS, flags(text))],
    )
    own = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
    )
    # rows without id meet no label, so they needn't be shuffled to one place
    met = held.where("doc_id IS NOT NULL").join(own, "doc_id", "left").fillna(0, ["good", "toxic"])
    keys = ["part", *FILTERS[:4], "good", "toxic"]
    one = met.groupBy("doc_id", "digest", *keys).agg(F.count("*").alias("n"))
    alike = one.groupBy("digest", *keys).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    counted = alike.select(*keys, "n", F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0).alias("firsts"))
    both = counted.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("E"), F.col("firsts").alias("n")), F.struct(F.lit(1).alias("E"), (F.col("n") - F.col("firsts")).alias("n")))).alias("x"))
    whole = both.select(*keys, "x.E", "x.n")
    nameless = held.where("doc_id IS NULL").groupBy("part", *FILTERS[:4]).agg(F.count("*").alias("n")).withColumns({"good": F.lit(0), "toxic": F.lit(0), "E": F.lit(0)})
    return whole.unionByName(nameless)


def joint(found: DataFrame) -> DataFrame:
    """(part, every, good, toxic): arrays of SETS counts, place s of a set s: how many documents fail all filters of s.

    Each is a sum of the product of the set's flags, in one aggregate.
    """

    def product(s: int, weight: Column) -> Column:
        for k, f in enumerate(FILTERS):
            if s >> k & 1:
                weight = weight * F.col(f)
        return F.sum(weight)

    n = F.col("n")
    measures = {"every": n, "good": n * F.col("good"), "toxic": n * F.col("toxic")}
    return found.groupBy("part").agg(*[F.array(*[product(s, w) for s in range(SETS)]).alias(m) for m, w in measures.items()])


def _over(sets: Column, test, weight) -> Column:
    """The sum of weight(s) over all sets s of filters that pass the test."""
    return F.aggregate(F.filter(sets, test), F.lit(0).cast("long"), lambda total, s: total + weight(s))


def _sign(s: Column) -> Column:
    return F.when(F.bit_count(s) % 2 == 0, 1).otherwise(-1)


def inverted(found: DataFrame) -> DataFrame:
    """Adds what Moebius inversion gives: survivors of each set of filters (all, good, toxic), and for each filter the
    failures of it alone and its Shapley value times 120, from the Harsanyi dividends of the game "removed by a set"."""
    sets = F.sequence(F.lit(0), F.lit(SETS - 1))
    at = lambda m, s: F.element_at(m, s + 1)
    survive = lambda m: F.transform(sets, lambda kept: _over(sets, lambda s: s.bitwiseAND(kept) == s, lambda s: _sign(s) * at(F.col(m), s)))
    # fail filter f alone: all sets that hold f, with signs of the rest
    holds = lambda s, f: F.getbit(s.cast("int"), f) == 1
    places = F.sequence(F.lit(0), F.lit(len(FILTERS) - 1))
    alone = F.transform(places, lambda f: _over(sets, lambda s: holds(s, f), lambda s: -_sign(s) * at(F.col("every"), s)))
    # the dividend of a set is its joint failures with the sign of its size; its members share it
    shapley = F.transform(places, lambda f: _over(sets, lambda s: holds(s, f), lambda s: -_sign(s) * at(F.col("every"), s) * F.floor(F.lit(120) / F.bit_count(s))))
    return found.withColumns({"kept_every": survive("every"), "kept_good": survive("good"), "kept_toxic": survive("toxic"), "alone": alone, "shapley_of": shapley})


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter keeps, removes and repeats, for each part (source), order of the filters and step.

    Counts are of rows. A null text is empty, a null source the empty part. E fails a row whose text is that of a row
    with a smaller doc_id anywhere in the table; a row without doc_id neither fails E nor makes another fail it, and has no label. Of a
    doc_id's labels, any that says quality or toxic counts. Extra columns are not read; no documents give no rows.
    """
    orders = " ".join("".join(p) for p in permutations(FILTERS))
    filled = inverted(joint(patterns(docs, labels))).select("*", F.explode(F.split(F.lit(orders), " ")).alias("filter_order"))
    steps = filled.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {{}}, 1)) - 1)"
    steps = steps.withColumn("passed", F.expr(f"aggregate(sequence(1, step), 0, (s, i) -> s | {bit.format('i')})")).withColumn("own", F.expr(bit.format("step")))
    filter_of = F.expr(f"instr('{FILTERS}', substr(filter_order, step, 1))")
    gone = lambda m: F.element_at(F.col(m), F.col("passed") - F.col("own") + 1) - F.element_at(F.col(m), F.col("passed") + 1)
    return steps.select(
        "part", "filter_order", "step", F.element_at("kept_every", F.col("passed") + 1).alias("kept"), gone("kept_every").alias("removed"),
        (F.element_at("every", F.col("own") + 1) - gone("kept_every")).alias("redundant"), F.element_at("alone", filter_of).alias("unique_fails"),
        gone("kept_good").alias("good_lost"), gone("kept_toxic").alias("toxic_lost"), F.element_at("shapley_of", filter_of).alias("shapley"),
    )
