"""Filter interaction audit: what each of five filters removes under every order of applying them.

A document's text decides four bits of its failure mask by built-in expressions inside its row; the fifth (a copy of a
smaller document's text) comes from grouping by text with its minimum doc_id. Whatever order the filters run in, a
document is removed by the first of them whose bit it has, so 32 cells a part (documents of each mask, with how many of
them are good and toxic) hold everything: all 120 orders are read off the cells, and no document is looked at twice.

Texts are told apart by their SHA-256, so that only narrow rows are shuffled. All copies of a text share the four bits
of the text; a group of copies is therefore added up by (text, part, labels) before it meets the minimum of its text,
and a hot text, part or label never lies in one task as rows.

Defined results: a null text is an empty one (copies of each other); a null part is the empty string; a document without
doc_id has no smaller one, so it never counts as a copy, and has no labels; of rows with one doc_id none is the smaller;
several label rows of a document count together (good if any says so, toxic if any does); an empty table gives no row;
extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfolk.llm.quality_hosts import let, words_of

#: The filters in order of their bits.
FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_UPPER_PERCENT = 5


def text_mask(text: Column) -> Column:
    """Bits A to D of a text that is not null: few words, repetitive words, capitals, symbols."""

    def by_words(w: Column) -> Column:
        few = F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0)
        same = F.when(100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT_PERCENT * F.size(w), 2).otherwise(0)
        return few + same

    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    capitals = F.when(100 * upper.cast("long") > MOST_UPPER_PERCENT * F.length(text).cast("long"), 4).otherwise(0)
    symbols = F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    return let(words_of(text), by_words) + capitals + symbols


def _key(doc: Column, digest: Column) -> Column:
    """The join key of a document; rows without doc_id are spread by their text."""
    return F.when(doc.isNull(), F.concat(F.lit("?"), digest)).otherwise(F.concat(F.lit("="), doc.cast("string")))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: the documents of each kind. docs: doc_id, text, source; labels: doc_id, quality, toxic."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.sha2("text", 256).alias("digest"), text_mask(F.col("text")).cast("int").alias("m"))
    rows = rows.withColumn("k", _key(F.col("doc_id"), F.col("digest")))
    said = labels.filter("doc_id is not null").groupBy(F.concat(F.lit("="), F.col("doc_id").cast("string")).alias("k"))
    said = said.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(said, "k", "left").na.fill(False, ["good", "toxic"])
    kind = ["digest", "m", "part", "good", "toxic"]
    same_id = rows.groupBy("k", "doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))  # already dealt by k
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = same_id.groupBy(*kind).agg(first.alias("first"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    each = groups.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))  # a text has a row per part and label
    firsts = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    originals = each.withColumn("kept", firsts + F.col("no_id"))
    split = F.array(F.struct(F.col("m").alias("mask"), F.col("kept").alias("n")), F.struct((F.col("m") + 16).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))
    return originals.select("part", "good", "toxic", F.explode(split).alias("s")).select("part", "s.mask", "good", "toxic", "s.n").filter("n > 0")


def cells(kinds: DataFrame) -> DataFrame:
    """part, and arrays of 32 counts by mask: n, good, toxic."""
    sums = []
    for name, of in (("n", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic"))):
        sums += [F.sum(F.when(of & (F.col("mask") == m), F.col("n")).otherwise(0)).alias(f"{name}{m}") for m in range(CELLS)]
    flat = kinds.groupBy("part").agg(*sums)
    return flat.select("part", *(F.array(*(F.col(f"{name}{m}") for m in range(CELLS))).alias(name) for name in ("n", "good", "toxic")))


def _total(counts: Column, where) -> Column:
    """The sum of the cells whose mask where() accepts."""
    chosen = F.filter(F.transform(counts, lambda x, m: F.struct(x.alias("x"), m.alias("m"))), lambda c: where(c["m"]))
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, c: a + c["x"])


def steps_of(at: DataFrame) -> DataFrame:
    """at with every order and step: filter_order, step, the step's bit and the bits of the steps before it."""
    every = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    at = at.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = F.expr(f"transform(split(filter_order, ''), x -> shiftleft(1, ascii(x) - {ord(FILTERS[0])}))")
    before = F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b)
    return at.withColumn("bits", bits).withColumn("bit", F.get("bits", F.col("step") - 1)).withColumn("before", before).drop("bits")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: part, filter_order, step, and the counts of that step."""
    at = steps_of(cells(masks(docs, labels)))
    bit, before = F.col("bit"), F.col("before")

    def fails(m: Column) -> Column:
        return m.bitwiseAND(bit) != 0

    def earlier(m: Column) -> Column:
        return m.bitwiseAND(before) != 0

    def removed(m: Column) -> Column:
        return fails(m) & ~earlier(m)

    # A filter comes first of the p filters that a mask names in 120 / p of the orders, which is whole for p up to 5.
    shares = F.array(*(F.lit(factorial(len(FILTERS)) // max(m.bit_count(), 1)) for m in range(CELLS)))
    worth = F.transform("n", lambda x, m: x * F.get(shares, m))
    return at.select(
        "part",
        "filter_order",
        "step",
        _total(F.col("n"), lambda m: ~earlier(m) & ~fails(m)).alias("kept"),
        _total(F.col("n"), removed).alias("removed"),
        _total(F.col("n"), lambda m: fails(m) & earlier(m)).alias("redundant"),
        _total(F.col("n"), lambda m: m == bit).alias("unique_fails"),
        _total(F.col("good"), removed).alias("good_lost"),
        _total(F.col("toxic"), removed).alias("toxic_lost"),
        _total(worth, fails).alias("shapley"),
    )
