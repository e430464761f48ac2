"""Recall channels by exact identity, and their union with provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolk.functions import text as X
from kinfolk.functions.scores import identity_score
from kinfolk.runtime import sized_join, stored


def exact_fingerprint(docs: DataFrame, is_query: Column) -> DataFrame:
    """Documents of another source and the same language with equal text; one per query and source, the smallest.

    Texts are told apart by their SHA-256. Copies are counted as one row per source before anything is joined, so a text
    with many copies brings as many rows to a query as it has sources; no text is shuffled.
    """
    rows = docs.select("doc_id", "source", F.lower("lang").alias("lang"), F.sha2("text", 256).alias("fp")).filter("fp is not null and lang is not null and source is not null")
    rows = stored(rows, "fingerprints")
    firsts = stored(rows.groupBy("fp", "lang", "source").agg(F.min("doc_id").alias("c_id")), "first_copies")
    q = rows.filter(is_query).select(F.col("doc_id").alias("q_id"), F.col("source").alias("q_source"), "lang", "fp")
    return q.join(firsts, ["fp", "lang"]).filter(F.col("q_source") != F.col("source")).select("q_id", "source", "c_id")


def name_matches(docs: DataFrame, is_query: Column, name: Column, shortest: int = 5, most: int | None = None) -> DataFrame:
    """Documents of other sources in the language with the query's name: q_id, c_id, c_copies.

    A row per source: c_id is the smallest of its c_copies documents with the name, so a frequent name has as many rows as
    sources and needs no cap. Where most is given, more documents than that for one query are an error, not a shorter list.
    """
    named = docs.select("doc_id", "source", "lang", name.alias("name"))
    same = stored(named.filter(F.length("name") >= shortest).groupBy("name", "lang", "source").agg(F.min("doc_id").alias("c_id"), F.count("*").alias("c_copies")), "names")
    q = stored(named.filter(is_query), "asked").select(F.col("doc_id").alias("q_id"), F.col("source").alias("q_source"), "lang", "name")
    met = q.join(same, ["name", "lang"]).filter(F.col("q_source") != F.col("source"))
    if most is not None:
        n = F.sum("c_copies").over(W.partitionBy("q_id"))
        met = met.withColumn("c_id", F.when(n > most, F.raise_error(F.lit("too many documents share a name"))).otherwise(F.col("c_id")).cast("long"))
    return met.select("q_id", "c_id", "c_copies")


def file_identity(docs: DataFrame, is_query: Column, least_lines: int = 5) -> DataFrame:
    """Per query: candidates with an equal normal, raw or source hash in other sources, and how many of them are verified.

    The disjunction is three equi-joins in union, not a nested loop. Only equal raw or source hashes verify a candidate.
    Files of fewer than least_lines normal lines take no part. Equal files of a source are counted, not paired.
    """
    hashed = docs.filter(F.size(X.norm_lines(F.col("text"))) >= least_lines)
    hashed = hashed.select("doc_id", "source", X.norm_hash(F.col("text")).alias("norm"), X.raw_hash(F.col("text")).alias("raw"), X.source_hash(F.col("text")).alias("src"))
    hashed = stored(hashed.filter("source is not null"), "hashed")
    equal = stored(hashed.groupBy("norm", "raw", "src", "source").agg(F.count("*").alias("n")), "equal")
    c = equal.select(*(F.col(k).alias(f"c_{k}") for k in equal.columns))
    asked = stored(hashed.filter(is_query).select("doc_id", *equal.columns[:4]), "asked")
    kinds = asked.select(*equal.columns[:4]).distinct()
    verified = (F.col("raw") == F.col("c_raw")) | F.coalesce(F.col("src") == F.col("c_src"), F.lit(False))
    met = [kinds.join(c, F.col(k) == F.col(f"c_{k}")).filter(F.col("source") != F.col("c_source")) for k in ("norm", "raw", "src")]
    pairs = reduce(DataFrame.union, met).distinct().groupBy(*equal.columns[:4]).agg(F.sum("c_n").alias("n_candidates"), F.sum(F.when(verified, F.col("c_n")).otherwise(0)).alias("n_verified"))
    keys = [asked[k].eqNullSafe(pairs[k]) for k in equal.columns[:4]]
    return asked.join(pairs, reduce(lambda x, y: x & y, keys)).select(asked["doc_id"].alias("q_id"), "n_candidates", "n_verified", (F.col("n_candidates") - F.col("n_verified")).alias("n_rejected"))


def breadth(docs: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, how many sources hold its normal hash, and whether that makes it common.

    The counts are stored before they meet the rows again, so both sides of that join have their own exchange and the rows
    of a frequent hash can be split.
    """
    hashed = docs.select("doc_id", "source", X.norm_hash(F.col("text")).alias("norm"))
    wide = stored(hashed.groupBy("norm", "source").agg(F.lit(1).alias("one")).groupBy("norm").agg(F.count("source").alias("breadth")), "breadth")
    return sized_join(hashed, wide, "norm", "inner").select("doc_id", "breadth", (F.col("breadth") >= least).alias("is_common"))


def recall_union(channels: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of channels (q_id, c_id, score) in order: the first channel to bring a pair gives its score and source,
    the later ones only set flags."""
    frames = [df.select("q_id", "c_id", F.col("score").cast("double").alias("score"), F.lit(k).alias("k"), F.lit(name).alias("source")) for k, (name, df) in enumerate(channels)]
    flags = [F.bool_or(F.col("source") == name).alias(f"{name}_match") for name, _ in channels]
    all_ = reduce(DataFrame.unionByName, frames)
    return all_.groupBy("q_id", "c_id").agg(F.min_by("source", "k").alias("recall_source"), F.min_by("score", "k").alias("score"), *flags)


def funnel(union: DataFrame, channels: list[str]) -> DataFrame:
    """Per channel: pairs it brought first, and pairs it also found."""
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), (F.col("recall_source") == c).alias("first"), F.col(f"{c}_match").alias("found")) for c in channels)))
    return union.select(rows.alias("x")).groupBy("x.channel").agg(F.count_if("x.first").alias("n_first"), F.count_if("x.found").alias("n_found"))


def identity_neighbors(seeds: DataFrame, docs: DataFrame, recalled: DataFrame, domain: list[str], most: int = 10_000, least: float = 0.62, behaves: float = 0.25) -> DataFrame:
    """q_id, c_id, identity of the documents in the domains of a query's seeds that are like the query by name, parameters,
    behavior and control, and that no channel recalled.

    seeds, recalled: q_id, c_id; docs: doc_id, the columns of the domain, name (parts), params, behavior, control. A document
    of another name must share behaves of its behavior. How many documents a query's domains hold is known from their
    sizes before any pair is made; more than most is an error, not a shorter list.
    """
    sizes = docs.groupBy(*domain).agg(F.count("*").alias("_n"))
    places = docs.select(F.col("doc_id").alias("c_id"), *domain)
    domains = stored(seeds.select("q_id", "c_id").join(places, "c_id").select("q_id", *domain).distinct(), "domains")
    held = domains.join(stored(sizes, "domain_sizes"), domain).groupBy("q_id").agg(F.sum("_n").alias("_n"))
    worst = held.agg(F.max("_n")).first()[0]
    if worst is not None and worst > most:
        raise ValueError(f"the domains of a query hold {worst} documents, more than {most}")
    parts = ["name", "params", "behavior", "control"]
    side = lambda p: docs.select(F.col("doc_id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in parts), *(domain if p == "c" else []))
    met = domains.join(side("c"), domain).filter(F.col("q_id") != F.col("c_id")).join(side("q"), "q_id")
    behavior = X.jaccard(F.col("q_behavior"), F.col("c_behavior"))
    same = F.col("q_name") == F.col("c_name")
    score = identity_score(same, X.jaccard(F.col("q_name"), F.col("c_name")), F.col("q_params") - F.col("c_params"), behavior, X.jaccard(F.col("q_control"), F.col("c_control")))
    fits = met.filter(same | (behavior >= behaves)).select("q_id", "c_id", score.alias("identity")).filter(F.col("identity") >= least)
    return stored(fits.distinct(), "identity").join(recalled.select("q_id", "c_id").distinct(), ["q_id", "c_id"], "left_anti")
