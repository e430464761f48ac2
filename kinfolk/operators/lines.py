"""Line-level evidence: the line table, links by shared lines, coverage, rare literals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.functions.text import MIN_LITERAL, line_array
from kinfolk.runtime import sized_join, stored

#: Share of the larger side's lines from which on two documents are linked: the lowest tier.
LEAST = 0.5


def distinct_lines(text: Column) -> Column:
    """The distinct folded lines of at least MIN_LITERAL characters."""
    return F.array_distinct(F.filter(line_array(text), lambda x: F.length(x) >= MIN_LITERAL))


def line_table(docs: DataFrame, *keep: str) -> DataFrame:
    """id, the kept columns, and a row per distinct folded line of at least MIN_LITERAL characters."""
    # the array is a column of its own: next to explode() an expression would be worked out again for every line
    found = docs.select("doc_id", *keep, distinct_lines(F.col("text")).alias("_lines"))
    return found.select("doc_id", *keep, F.size("_lines").alias("n_lines"), F.explode("_lines").alias("line"))


def hashed_sets(docs: DataFrame, sets: Column, *keep: str) -> DataFrame:
    """doc_id, the kept columns, set_id and hs (hashes of the distinct elements); documents without elements stay out.

    Documents with equal sets share set_id, a 128-bit hash of the sorted elements.
    """
    # exploded as one row: a filter on it then does not work the sets out once more
    found = docs.select("doc_id", *keep, F.explode(F.array(F.sort_array(F.array_distinct(sets)))).alias("_e")).filter(F.size("_e") > 0)
    return found.select("doc_id", *keep, F.md5(F.array_join("_e", "\n").cast("binary")).alias("set_id"), F.transform("_e", lambda x: F.xxhash64(x)).alias("hs"))


def similar_sets(sets: DataFrame, asked: DataFrame, least: float = LEAST) -> DataFrame:
    """q_set, c_set, hits, q_n, c_n: all pairs of an asked set and any set (itself included) that share at least the share
    least of the larger one's elements.

    sets: set_id, hs, once each; asked: set_id. Exact, by prefixes: with the elements of a set ordered from rare to
    frequent, two sets of that overlap share one of their first n - ceil(least * n) + 1, so frequent elements are joined on
    only for sets that have little else. Both sides of the join are stored, so AQE can split a hot element.
    """
    sets = stored(sets.select("set_id", "hs", F.size("hs").alias("n")), "sets")
    elements = sets.select("set_id", "n", F.explode("hs").alias("h"))
    often = stored(elements.groupBy("h").agg(F.count("*").alias("df")), "frequency")
    ordered = sized_join(elements, often, "h", "inner").groupBy("set_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("e"))
    first = (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")
    prefixes = stored(ordered.select("set_id", "n", F.explode(F.slice("e", 1, first)).alias("x")).select("set_id", "n", "x.h"), "prefixes")
    q = sized_join(prefixes, stored(asked.select("set_id").distinct(), "asked"), "set_id", "left_semi").select(F.col("set_id").alias("q_set"), F.col("n").alias("q_n"), "h")
    c = prefixes.select(F.col("set_id").alias("c_set"), F.col("n").alias("c_n"), "h")
    sizes = F.least("q_n", "c_n") >= F.lit(least) * F.greatest("q_n", "c_n")
    pairs = stored(q.join(c, "h").filter(sizes).select("q_set", "c_set").distinct(), "pairs")
    side = lambda p: sets.select(F.col("set_id").alias(f"{p}_set"), F.col("hs").alias(f"{p}_hs"), F.col("n").alias(f"{p}_n"))
    met = pairs.join(side("q"), "q_set").join(side("c"), "c_set")
    met = met.select("q_set", "c_set", F.size(F.array_intersect("q_hs", "c_hs")).cast("long").alias("hits"), "q_n", "c_n")
    return met.filter(F.col("hits") >= F.lit(least) * F.greatest("q_n", "c_n"))


def folds(rows: DataFrame) -> DataFrame:
    """Rows of one set, source and language as one: set_id, source, lang, first and last doc_id, n."""
    return rows.groupBy("set_id", "source", "lang").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))


def link_documents(links: DataFrame, asked: DataFrame, folded: DataFrame, key: str = "set_id") -> DataFrame:
    """Links of sets as links of documents to folds: see line_links. asked: doc_id, source, lang, set_id and key."""
    q = asked.select(F.col(key).alias("q_set"), F.col("set_id").alias("q_own"), F.col("doc_id").alias("q_id"), F.col("source").alias("q_source"), F.col("lang").alias("q_lang"))
    c = folded.select(F.col(key).alias("c_set"), F.col("set_id").alias("c_own"), "first", "last", F.col("source").alias("c_source"), F.col("lang").alias("c_lang"), "n")
    met = sized_join(stored(links.join(c, "c_set"), "links"), q, "q_set", "inner")
    own = (F.col("q_own") == F.col("c_own")) & F.col("q_source").eqNullSafe(F.col("c_source")) & F.col("q_lang").eqNullSafe(F.col("c_lang"))
    out = met.withColumn("c_id", F.when(F.col("first") == F.col("q_id"), F.col("last")).otherwise(F.col("first"))).withColumn("c_copies", F.col("n") - own.cast("int"))
    return out.filter("c_copies > 0 and q_id <> c_id").drop("q_own", "c_own", "first", "last", "n")


#: Documents that meet on an element in one block, and meetings of a partition.
BLOCK, MEETINGS = 1024, 4 << 20


class Links:
    """The links of documents by their sets, made as they are read: no pair is written or shuffled before it is used.

    rows: doc_id, source, lang, set_id, hs (as of hashed_sets) and key, by which sets are linked (set_id by default); asked
    marks the queries. Exact, by prefixes as in similar_sets: documents and folds meet on the shared elements of their
    prefixes and bring their sets along, so a pair is judged where it meets, and counts at its first common element only.
    Documents of an element are dealt into blocks; each pair of blocks is a unit of work of its own.
    """

    def __init__(self, rows: DataFrame, asked: Column, least: float = LEAST, key: str = "set_id"):
        self.least, self.key = least, key
        self.rows = rows
        self.asked = stored(rows.filter(asked).select("doc_id", "source", "lang", *dict.fromkeys(("set_id", key))), "asked")
        sets = stored(rows.groupBy(F.col(key).alias("set")).agg(F.first("hs").alias("hs"), F.count("*").alias("copies")), "sets")  # equal in all rows of a set
        elements = sets.select("set", "copies", F.explode("hs").alias("h"))
        often = stored(elements.groupBy("h").agg(F.count("*").alias("df")), "frequency")
        listed = sized_join(elements, often, "h", "inner").groupBy("set", "copies").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("e"))
        ordered = stored(listed.select("set", "copies", F.size("e").alias("n"), F.transform("e", lambda x: x["h"]).alias("e")), "ordered")
        first = (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")
        prefixes = ordered.select("set", "copies", F.explode(F.slice("e", 1, first)).alias("h"))
        met = stored(prefixes.groupBy("h").agg(F.sum("copies").alias("k")).filter("k > 1").select("h", "k", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")), "met")
        shared = stored(sized_join(prefixes.select("set", "h"), met.select("h", "blocks"), "h", "inner"), "shared")
        self.held = stored(shared.join(ordered.select("set", "n", "e"), "set"), "held")
        total = met.agg(F.sum(F.col("k").cast("double") * F.col("k"))).first()[0] or 0.0
        self.parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / MEETINGS))

    def pairs(self, q_more: DataFrame | None = None, c_more: DataFrame | None = None) -> DataFrame:
        """q_id, q_source, q_lang, c_id, c_source, c_lang, c_copies, hits, q_lines, c_lines, line_sim as of line_links, then
        what is known of single documents: the columns of q_more (by q_id, each once) and of c_more (by c_id)."""
        key, least = self.key, F.lit(self.least)
        more = {p: [c for c in df.columns if c != f"{p}_id"] if df is not None else [] for p, df in (("q", q_more), ("c", c_more))}
        asked = self.asked if q_more is None else self.asked.join(q_more.withColumnRenamed("q_id", "doc_id"), "doc_id", "left")
        rows = self.rows.select("doc_id", "source", "lang", *dict.fromkeys(("set_id", key)))
        rows = rows if c_more is None else rows.join(c_more.withColumnRenamed("c_id", "doc_id"), "doc_id", "left")
        ends = [f(F.struct("doc_id", *more["c"])).alias(x) for f, x in ((F.min, "first"), (F.max, "last"))] if more["c"] else [F.struct(f("doc_id").alias("doc_id")).alias(x) for f, x in ((F.min, "first"), (F.max, "last"))]
        folded = rows.groupBy(*dict.fromkeys(("set_id", key)), "source", "lang").agg(*ends, F.count("*").alias("copies"))
        side = lambda p, df, own, *cols: self.held.join(df.withColumnRenamed(key, "set") if key != "set_id" else df.withColumn("set", F.col("set_id")), "set").select("h", "blocks", F.col("set").alias(f"{p}_set"), F.col("n").alias(f"{p}_lines"), F.col("e").alias(f"{p}_e"), F.col("set_id").alias(f"{p}_own"), F.col("source").alias(f"{p}_source"), F.col("lang").alias(f"{p}_lang"), F.pmod(F.xxhash64(own), "blocks").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), *cols)
        at = ["h", "q_block", "c_block"]
        q = side("q", asked, "doc_id", F.col("doc_id").alias("q_id"), *more["q"]).drop("blocks").withColumnsRenamed({"own": "q_block", "other": "c_block"}).repartition(self.parts, *at)
        c = side("c", folded, "first.doc_id", "first", "last", "copies").drop("blocks").withColumnsRenamed({"own": "c_block", "other": "q_block"}).repartition(self.parts, *at)
        longer = F.greatest("q_lines", "c_lines")
        same = F.col("q_set") == F.col("c_set")
        is_first = F.col("h") == F.col("q_e")[0]
        met = q.join(c, at).filter((F.least("q_lines", "c_lines") >= least * longer) & (~same | is_first))
        # exploded as one row, so that the filter does not work the common elements out once more
        met = met.withColumn("both", F.explode(F.array(F.when(same, F.col("q_e")).otherwise(F.array_intersect("q_e", "c_e")))))
        met = met.filter((F.size("both") >= least * longer) & (F.col("both")[0] == F.col("h")))
        own = (F.col("q_own") == F.col("c_own")) & F.col("q_source").eqNullSafe(F.col("c_source")) & F.col("q_lang").eqNullSafe(F.col("c_lang"))
        pick = lambda x: F.when(F.col("first.doc_id") == F.col("q_id"), F.col(f"last.{x}")).otherwise(F.col(f"first.{x}"))
        hits = F.size("both").cast("long")
        out = met.select("q_id", "q_source", "q_lang", pick("doc_id").alias("c_id"), "c_source", "c_lang", (F.col("copies") - own.cast("int")).alias("c_copies"), hits.alias("hits"), "q_lines", "c_lines", (hits / longer).alias("line_sim"), *more["q"], *(pick(x).alias(x) for x in more["c"]))
        return out.filter("c_copies > 0 and q_id <> c_id")


def document_links(docs: DataFrame, is_query: Column, least: float = LEAST) -> Links:
    """The links of documents by their lines, asked ones with all."""
    rows = stored(hashed_sets(docs, distinct_lines(F.col("text")), "source", "lang"), "line_sets")
    return Links(rows, is_query, least)


def line_links(docs: DataFrame, is_query: Column, least: float = LEAST) -> DataFrame:
    """All links of the asked documents: q_id, q_source, q_lang, c_id, c_source, c_lang, c_copies, hits, q_lines, c_lines,
    line_sim = hits / the larger number of lines, at least least.

    Candidates of one source and language with the same lines are one row: c_id is the smallest of these c_copies documents
    (the largest if the smallest is q_id itself). No link is lost, and no group of copies becomes pairs of its members.
    """
    return document_links(docs, is_query, least).pairs()


def rare_lines(lines: DataFrame, group: str = "source", most: int = 5) -> DataFrame:
    """Lines that occur in two to most groups, with their breadth."""
    return lines.groupBy("line").agg(F.count_distinct(group).alias("breadth")).filter((F.col("breadth") >= 2) & (F.col("breadth") <= most))


def rare_line_hits(docs: DataFrame, is_query: Column, most: int = 5) -> DataFrame:
    """q_id, c_id, c_copies, hits: documents of other sources that share rare lines with an asked one, folded as in
    line_links: a rare line stands in few sources but may stand in any number of copies there."""
    rows = stored(hashed_sets(docs, distinct_lines(F.col("text")), "source", "lang"), "line_sets")
    folded = stored(folds(rows), "folds")
    asked = stored(rows.filter(is_query).select("doc_id", "source", "lang", "set_id"), "asked")
    sets = rows.dropDuplicates(["set_id"]).select("set_id", F.explode("hs").alias("h"))
    sources = folded.select("set_id", "source").distinct()
    rare = sets.join(sources, "set_id").groupBy("h").agg(F.count_distinct("source").alias("breadth"))
    rare = stored(rare.filter((F.col("breadth") >= 2) & (F.col("breadth") <= most)).select("h"), "rare")
    held = stored(sized_join(sets, rare, "h", "left_semi"), "held")
    q = sized_join(held, stored(asked.select("set_id").distinct(), "asked_sets"), "set_id", "left_semi")
    links = q.select(F.col("set_id").alias("q_set"), "h").join(held.select(F.col("set_id").alias("c_set"), "h"), "h").groupBy("q_set", "c_set").agg(F.count("*").alias("hits"))
    return link_documents(links, asked, folded).filter(F.col("q_source") != F.col("c_source")).select("q_id", "c_id", "c_copies", "hits")


def pair_upsert(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """Known pairs (q_id, c_id, score) raised or completed by line hits."""
    both = pairs.join(hits, ["q_id", "c_id"], "full_outer")
    return both.select("q_id", "c_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("hits", F.lit(0)).alias("hits"), F.col("score").isNotNull().alias("known"))


def line_coverage(docs: DataFrame) -> DataFrame:
    """Share of each document's lines that an earlier document holds: doc_id, n_lines, covered, coverage, top_source."""
    lines = line_table(docs, "source")
    owner = stored(lines.groupBy("line").agg(F.min(F.struct("doc_id", "source")).alias("o")), "owners")
    met = sized_join(lines, owner, "line", "inner").withColumn("covered", F.col("doc_id") > F.col("o.doc_id"))
    by = met.groupBy("doc_id", "n_lines", F.when(F.col("covered"), F.col("o.source")).alias("s")).agg(F.count("*").alias("n"))
    best = F.max_by("s", F.when(F.col("s").isNotNull(), F.struct("n", "s")))
    covered = F.sum(F.when(F.col("s").isNotNull(), F.col("n")).otherwise(0))
    out = by.groupBy("doc_id", "n_lines").agg(covered.alias("covered"), best.alias("top_source"))
    return out.withColumn("coverage", F.col("covered") / F.col("n_lines"))
