"""Approximate nearest neighbours by a hash-prefix forest.

A tree is a sorted array of long hash strings (signs of random projections). A query goes down every tree to its longest
prefix matches, then up through all trees at the same time, one bit a step, until the ranges it has opened hold ENTRIES
times the rows together. A row gets a vote for every range that holds it, which is the length of its common prefix with the
query added up over the trees. The rows with the most votes, a share of all with everything that ties with the last of
them, are the candidates; they are scored exactly.

The forest is cut into shards of bounded size by a hash of the id, each with its own trees, so a shard's index is one row
of bounded size. Queries are packed in blocks of bounded size as well; every block meets every shard through an equi-join
on the shard's number, and only the best k of a block's queries leave a shard. The candidates wanted are a share of the
shard at every size, as recall at a fixed number would fall as shards fill.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an
id; only vectors of one length are compared; rows with the query's id are not its candidates; of repeated query rows one
is used; distances that tie go to the smaller id; an empty table gives an empty result; extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolk.runtime import stored

TREES = 64
#: Bits of a hash string.
BITS = 32
SHARD = 8192
BLOCK = 512
#: Entries of the opened ranges, times the shard's rows, at which the ascent ends.
ENTRIES = 8
#: Candidates, as a share of a shard's rows.
SHARE = 0.35
SEED = 7


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def projections(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, TREES * BITS)).astype(np.float32)


def hash_strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """rows x TREES hash strings as numbers, the first bit highest."""
    bits = (x @ planes > 0).reshape(len(x), TREES, BITS)
    return np.packbits(bits, axis=2).view(">u4")[:, :, 0].astype(np.uint32)


def _pack(ids: np.ndarray, x: np.ndarray) -> dict:
    return {"ids": ids.astype("<i8").tobytes(), "vectors": x.astype("<f8").tobytes()}


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def packed(rows: DataFrame, with_trees: bool) -> DataFrame:
    """A row per (dim, part) with its ids and vectors, and the sorted arrays of its trees."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, part = (k.as_py() for k in key)
        ids, x = table.column("id").to_numpy(), _matrix(table)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        row = {"dim": dim, "part": part} | _pack(ids, x)
        if with_trees:
            strings = hash_strings(x.astype(np.float32), projections(dim)).T
            by = np.argsort(strings, axis=1, kind="stable")
            row |= {"entries": by.astype("<i4").tobytes(), "strings": np.take_along_axis(strings, by, axis=1).astype("<u4").tobytes()}
        return pa.Table.from_pylist([row], schema=schema)

    fields = [("dim", pa.int32()), ("part", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())] + ([("entries", pa.binary()), ("strings", pa.binary())] if with_trees else [])
    schema = pa.schema(fields)
    ddl = "dim int, part long, ids binary, vectors binary" + (", entries binary, strings binary" if with_trees else "")
    return rows.groupBy("dim", "part").applyInArrow(run, ddl)


def votes(strings: np.ndarray, entries: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """queries x rows: how many ranges a query opened hold the row. strings, entries: trees x rows, sorted by tree."""
    (trees, rows), n = strings.shape, len(queries)
    a, b = (np.zeros((BITS + 1, trees, n), np.int32) for _ in range(2))
    end = np.zeros(n, np.int64)  # the level where a query's ascent ends
    for bits in range(BITS, 0, -1):
        mask = np.uint32(((1 << bits) - 1) << (BITS - bits))
        for t in range(trees):
            least = queries[:, t] & mask
            a[bits, t] = np.searchsorted(strings[t], least, side="left")
            b[bits, t] = np.searchsorted(strings[t], least | ~mask, side="right")
        enough = (b[bits] - a[bits]).sum(0, dtype=np.int64) >= ENTRIES * rows
        end[enough & (end == 0)] = bits
        if (end > 0).all():
            break
    end = np.maximum(end, 1)
    out = np.empty((n, rows), np.int32)
    base = np.arange(trees) * rows
    flat, sizes = entries.ravel(), b - a
    for i in range(n):  # only the entries of the ranges this query opened are read
        first, size = (base + a[end[i] :, :, i]).ravel(), sizes[end[i] :, :, i].ravel()
        some = size > 0
        first, size = first[some], size[some]
        places = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[i] = np.bincount(flat[places], minlength=rows)
    return out


def candidates(strings: np.ndarray, entries: np.ndarray, queries: np.ndarray, least: int, share: float) -> np.ndarray:
    """queries x rows: whether a row is scored. At least `least` rows are, if there are as many."""
    v = votes(strings, entries, queries)
    wanted = min(v.shape[1], max(least, int(np.ceil(share * v.shape[1]))))
    return v >= np.partition(v, -wanted, axis=1)[:, -wanted][:, None]


def _search(k: int, share: float):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                ids, x = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vectors"], "<f8").reshape(-1, dim)
                entries, strings = np.frombuffer(r["entries"], "<i4").reshape(TREES, -1), np.frombuffer(r["strings"], "<u4").reshape(TREES, -1)
                asked, q = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_vectors"], "<f8").reshape(-1, dim)
                hit = candidates(strings, entries, hash_strings(q.astype(np.float32), projections(dim)), k + 1, share)
                out: list[tuple] = []
                for i in range(len(asked)):
                    at = np.flatnonzero(hit[i] & (ids != asked[i]))
                    d = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
                    if len(at) > k:
                        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                        at, d = at[near], d[near]
                    best = np.lexsort((ids[at], d))[:k]
                    out += zip([int(asked[i])] * len(best), ids[at[best]].tolist(), d[best].tolist(), strict=True)
                columns = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest candidates found for each query.

    rows, queries: id long, v array of float or double.
    """

    def parts(df: DataFrame, size: int) -> tuple[DataFrame, int]:
        fine = stored(df.filter(F.col("id").isNotNull() & usable(F.col("v"))).select("id", "v", F.size("v").alias("dim")), "vectors")
        n = max(1, -(-fine.count() // size))
        return fine.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n)).cast("long")), n

    data, shards = parts(rows, shard)
    asked, _ = parts(queries.dropDuplicates(["id"]), block)
    index = stored(packed(data, True), "forest")
    blocks = packed(asked, False).select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("part"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    found = index.join(blocks, ["dim", "part"]).mapInArrow(_search(k, share), "query_id long, vec_id long, score double")
    order = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", order.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
