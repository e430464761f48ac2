"""Quality rules: document rules, then host-level rates shrunk by an empirical beta prior.

Native: built-in functions only. All counts of a document are taken inside its row, so texts are never shuffled; only a
narrow row per document is written, summed by host and joined with the host verdicts.

Defined results: a null text is an empty one (no words, fails the base rules); a null host is a host of its own; repeated
rows count once each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.runtime import sized_join, stored

#: The six ASCII white space characters that part words.
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def covered_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, from the hashes of all windows in order.

    Sorting (hash, position) puts equal windows next to each other; the positions of those, sorted again, give the
    union of their spans from the gaps between neighbours.
    """

    def positions(s: Column) -> Column:
        def same(j: Column, k: Column) -> Column:
            return F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))

        twin = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(twin, lambda j: F.get(s, j)["p"]))

    def union(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return let(pairs, lambda s: let(positions(s), union))


def repeated_words(words: Column) -> Column:
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered_words(h)))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(found)


def measures(docs: DataFrame, doc: str = "doc_id", text: str = "text", host: Column | None = None) -> DataFrame:
    """One narrow row per document: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words_of(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    return docs.select(
        F.col(doc).alias("doc_id"),
        (host if host is not None else F.col("source")).cast("string").alias("host"),
        of_words.alias("w"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "host", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_verdicts(failures: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), host_bad, from rows of host and base_failed.

    The prior beta(a, b) comes from the hosts by moments: its mean is the overall rate, its weight a + b the one that
    gives the spread of the hosts' rates (at least 1, at most a million documents).
    """
    hosts = stored(
        failures.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")),
        "hosts",
    )
    r = F.col("n_failed") / F.col("n_docs")
    row = hosts.agg(
        F.sum("n_failed").alias("f"), F.sum("n_docs").alias("n"), F.sum(F.col("n_docs") * r * r).alias("rr"), F.count("*").alias("k"), F.sum(1 / F.col("n_docs")).alias("inv")
    ).first()
    n = float(row["n"] or 0)
    mean = (row["f"] or 0) / n if n else 0.0
    spread = max((row["rr"] or 0.0) / n - mean * mean, 0.0) if n else 0.0
    noise = mean * (1 - mean) * row["k"] / n if n else 0.0
    between = spread - noise
    weight = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if between > 1e-12 else 1e6
    a, b = mean * weight, (1 - mean) * weight
    rate = (F.col("n_failed") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate > max_rate).alias("host_bad"))


def quality_rules(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    host: Column | None = None,
    max_host_rate: float = 0.5,
) -> DataFrame:
    """Measures, base_failed, host_rate and kept for each document.

    A document is kept if it passes the base rules and its host's shrunk failure rate is at most max_host_rate.
    """
    rows = stored(measures(docs, doc, text, host).withColumn("base_failed", base_failed()), "quality")
    hosts = stored(host_verdicts(rows, max_host_rate).select(F.coalesce("host", F.lit("")).alias("_host"), F.col("host").isNull().alias("_none"), F.col("rate").alias("host_rate"), "host_bad"), "verdicts")
    keyed = rows.withColumn("_host", F.coalesce("host", F.lit(""))).withColumn("_none", F.col("host").isNull())
    out = sized_join(keyed, hosts, ["_host", "_none"], "left")
    return out.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", (~F.col("base_failed") & ~F.col("host_bad")).alias("kept")
    )
