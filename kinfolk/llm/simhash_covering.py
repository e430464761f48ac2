"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit of a fingerprint gets a non-zero vector of radius + 1 bits; table v keeps the bits whose vector has an odd
number of ones in common with v. Any radius or fewer differing bits leave some v != 0 orthogonal to all their vectors, so
in table v the pair agrees on every kept bit: no pair within the radius is lost.

Tables hold distinct fingerprints, each under its smallest document. A bucket of up to SMALL_BUCKET of them is compared
pair by pair; a larger one links its members through their meeting points (a fingerprint with up to half the radius of
its free bits flipped): two within the radius share one, so linking each to the smallest at every point keeps all
components and makes rows in proportion to the members.

Defined results: null and empty texts have fingerprint zero and link like any other; a null doc_id takes part, but never
names a component unless all ids in it are null; repeated rows share their component; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.llm.words import pieces, utf8
from kinfolk.operators.components import connected_components
from kinfolk.runtime import sized_join, stored

SEED = 42
BITS = 64
SMALL_BUCKET = 64
#: The bits of each value of a byte, lowest first.
_BITS_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANE = np.arange(8) * 256


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 of each n-word shingle of a text in lower case; the whole sequence if it has fewer words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    starts = starts.tolist()
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (x - 1 for x in starts[n:]))), np.uint64, len(words) - n + 1)


def fingerprint(text: bytes, n: int) -> int:
    """Bit k is 1 if it is set in over half the shingle hashes."""
    h = shingle_hashes(text, n)
    if not len(h):
        return 0
    lanes = np.bincount((h.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANE).ravel(), minlength=2048).reshape(8, 256)
    ones = (lanes @ _BITS_OF).ravel() * 2 > len(h)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every document."""

    def run(batches):
        for b in pieces(batches):
            fps = np.array([fingerprint(t, n) for t in utf8(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2^(radius + 1) - 1 masks of a covering family, as signed longs."""
    size = 1 << (radius + 1)
    vectors = [1 + k % (size - 1) for k in range(bits)]
    found = [sum(1 << k for k in range(bits) if (vectors[k] & v).bit_count() % 2) for v in range(1, size)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def meeting_points(fp: Column, mask: int, radius: int) -> Column:
    """fp with up to radius / 2 of the bits outside a mask flipped."""
    free = [k for k in range(BITS) if not (mask >> k) & 1]
    flips = [sum(1 << k for k in c) for r in range(radius // 2 + 1) for c in combinations(free, r)]
    return F.transform(F.array(*(F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long") for x in flips)), lambda x: fp.bitwiseXOR(x))


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of node ids with the components of the graph that joins fingerprints within the radius.

    nodes: id, fp, one row per distinct fingerprint.
    """
    if radius % 2:
        raise ValueError("the radius must be even: meeting points lie half-way")
    family = masks(radius)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(family)))
    keyed = nodes.select("id", "fp", F.explode(tables).alias("x")).select("id", "fp", "x.t", "x.key")
    full = stored(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = stored(sized_join(keyed, full, ["t", "key"], "inner"), "members")
    small = members.filter(F.col("n") <= SMALL_BUCKET)
    other = small.select("t", "key", F.col("id").alias("id2"), F.col("fp").alias("fp2"))
    near = (F.col("id") < F.col("id2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
    pairs = small.join(other, ["t", "key"]).filter(near).select(F.col("id").alias("a"), F.col("id2").alias("b"))
    large = members.filter(F.col("n") > SMALL_BUCKET)
    if large.isEmpty():
        return pairs.distinct()
    points = F.coalesce(*(F.when(F.col("t") == t, meeting_points(F.col("fp"), m, radius)) for t, m in enumerate(family)))
    met = stored(large.select("id", F.explode(points).alias("point")).distinct(), "points")
    first = met.groupBy("point").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return pairs.union(met.join(first, "point").filter("id > a").select("a", F.col("id").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = 2, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every document."""
    rows = stored(fingerprints(docs, n, doc, text), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    # fingerprints are the nodes, so that rows without a doc_id link others as well
    joined = connected_components(links(nodes.select(F.col("fp").alias("id"), "fp"), radius))
    linked = nodes.join(joined.select(F.col("node").alias("fp"), "component"), "fp", "left")
    linked = stored(linked.select("fp", "id", F.coalesce("component", "fp").alias("component")), "linked")
    least = stored(linked.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    named = stored(sized_join(linked, least, "component", "inner").select("fp", "component_id"), "components")
    return sized_join(rows, named, "fp", "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
