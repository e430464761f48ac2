"""Token weights, weighted fingerprints and their neighbor lookups by bands.

The portable hash of a token is the first 15 hex digits of its md5 (60 bits), which other engines can compute as well.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.functions.scores import hamming, length_ratio_ok
from kinfolk.functions.text import words
from kinfolk.runtime import sized_join, stored

BITS = 60
BANDS = 4


def portable_hash(token: Column) -> Column:
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 15), 16, 10).cast("long")


def document_tokens(docs: DataFrame) -> DataFrame:
    """doc_id and each distinct lower-case word of a document."""
    return docs.select("doc_id", F.explode(F.array_distinct(words(F.lower("text")))).alias("token"))


def token_idf(tokens: DataFrame, n: int) -> DataFrame:
    """token, df and weight ln(n / df); ln n (1 if n is at most 1) is the weight of unknown tokens."""
    return tokens.groupBy("token").agg(F.count("*").alias("df")).withColumn("weight", F.log(F.lit(float(n)) / F.col("df")))


def weighted_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, token, h, weight: each document's distinct words with their portable hashes and weights in thousandths.

    A frequent word is a hot key of this join, so both sides are stored first: a small vocabulary is broadcast, and where it
    is too large for that AQE can split the word.
    """
    tokens = stored(document_tokens(docs), "tokens")
    weight = F.round(F.col("weight") * 1000).cast("long").alias("weight")
    known = token_idf(tokens, docs.count()).select("token", weight, portable_hash(F.col("token")).alias("h"))
    return sized_join(tokens, stored(known, "idf"), "token", "inner").select("doc_id", "token", "h", "weight")


def weighted_fingerprints(weighted: DataFrame) -> DataFrame:
    """doc_id, fp, n_tokens and weak_bits (the least confident bit of each band) from doc_id, token or its portable hash h, and
    weight (whole numbers).

    A bit is set if the weights of the tokens that have it outweigh the others; weights of 0 or less are skipped.
    """
    width = BITS // BANDS
    if "h" not in weighted.columns:
        weighted = weighted.withColumn("h", portable_hash(F.col("token")))

    def run(batches):
        shift = np.arange(BITS, dtype=np.int64)
        for b in batches:
            n = pc.list_value_length(b.column("e")).to_numpy()
            e = b.column("e").flatten()
            h, w = (e.field(k).to_numpy(zero_copy_only=False) for k in ("h", "weight"))
            sums = np.zeros((len(n), BITS), np.int64)
            ends = np.cumsum(n)
            for at in range(0, len(n), 64):  # so many documents at once
                lo, hi = ends[at] - n[at], ends[min(at + 64, len(n)) - 1]
                votes = np.where((h[lo:hi, None] >> shift) & 1, w[lo:hi, None], -w[lo:hi, None])
                sums[at : at + 64] = np.add.reduceat(votes, ends[at : at + 64] - n[at : at + 64] - lo, axis=0)
            fp = ((sums > 0).astype(np.int64) << shift).sum(1)
            weak = np.abs(sums).reshape(len(n), BANDS, width).argmin(2) + np.arange(BANDS) * width
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp), pa.array(n.astype(np.int64)), pa.array(list(weak.astype(np.int32)), pa.list_(pa.int32()))], ["doc_id", "fp", "n_tokens", "weak_bits"])

    votes = weighted.filter("weight > 0").groupBy("doc_id").agg(F.collect_list(F.struct("h", "weight")).alias("e"))  # a document's words
    return votes.mapInArrow(run, "doc_id long, fp long, n_tokens long, weak_bits array<int>")


def band(fp: Column, k: int, width: int = BITS // BANDS) -> Column:
    return F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def bands(fps: DataFrame) -> DataFrame:
    """fps with a row per band: k and value."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), band(F.col("fp"), k).alias("value")) for k in range(BANDS))))
    return fps.withColumn("x", rows).select(*fps.columns, "x.k", "x.value")


def neighbors(queries: DataFrame, fps: DataFrame, distance: int = 15, flips: int = 3) -> DataFrame:
    """q_id, doc_id, distance of fingerprints within distance bits of the queries', of one language and like size.

    Two within (flips + 1) * BANDS - 1 bits differ in at most flips bits of some band, so probing every band with up to
    flips bits turned finds all. Only queries are probed; the index side has BANDS rows a fingerprint.
    """
    if distance > (flips + 1) * BANDS - 1:
        raise ValueError("this many flips do not reach that distance")
    width = BITS // BANDS
    masks = [sum(1 << b for b in c) for r in range(flips + 1) for c in combinations(range(width), r)]
    probes = bands(queries.select(F.col("doc_id").alias("q_id"), "fp", F.col("n_tokens").alias("q_tokens"), F.col("lang").alias("q_lang")))
    probes = probes.withColumn("value", F.explode(F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: F.col("value").bitwiseXOR(m)))).withColumnRenamed("fp", "q_fp")
    met = probes.join(bands(fps), ["k", "value"])
    near = (hamming(F.col("q_fp"), F.col("fp")) <= distance) & length_ratio_ok(F.col("q_tokens"), F.col("n_tokens")) & (F.col("q_lang") == F.col("lang")) & (F.col("q_id") != F.col("doc_id"))
    return met.filter(near).select("q_id", "doc_id", hamming(F.col("q_fp"), F.col("fp")).alias("distance")).distinct()


def band_pool(queries: DataFrame, fps: DataFrame) -> DataFrame:
    """q_id and doc_id of fingerprints that share a band with a query, or would with its least confident bit turned."""
    q = bands(queries.select(F.col("doc_id").alias("q_id"), "fp", "weak_bits"))
    turned = F.col("value").bitwiseXOR(F.expr(f"shiftleft(1L, element_at(weak_bits, k + 1) - k * {BITS // BANDS})"))
    probes = q.select("q_id", "k", F.explode(F.array("value", turned)).alias("value"))
    return probes.join(bands(fps.select("doc_id", "fp")), ["k", "value"]).filter("q_id != doc_id").select("q_id", "doc_id").distinct()
