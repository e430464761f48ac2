"""Exact vector search in blocks: top k by cosine, within pools, with filters, and arg-max against a subset.

Rows and queries are packed in blocks of bounded size. Every query block meets the row blocks of its pool, one matrix
product each, and only each query's best k of a block leave it: query blocks are copied once per row block of their pool
and joined on pool and block number, so the blocks of one pool are spread over the tasks.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolk.functions.scores import cosine
from kinfolk.runtime import sized_join, stored

ROWS = 4096
QUERIES = 512


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(n, -1)
    norms = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norms == 0, 1.0, norms)


_PACKED = pa.schema([("pool", pa.string()), ("part", pa.int64()), ("ids", pa.binary()), ("groups", pa.list_(pa.string())), ("unit", pa.binary())])


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    unit = _matrix(table.column("v"), table.num_rows)
    row = {"pool": key[0].as_py(), "part": key[1].as_py(), "ids": table.column("id").to_numpy().astype("<i8").tobytes(), "groups": table.column("grp").to_pylist(), "unit": unit.astype("<f8").tobytes()}
    return pa.Table.from_pylist([row], schema=_PACKED)


def _packed(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of about size rows of each pool, and the number of blocks of each pool."""
    rows = stored(rows.filter("id is not null and v is not null").select("pool", "id", "grp", "v"), "vectors")
    blocks = stored(rows.groupBy("pool").agg(F.ceil(F.count("*") / size).cast("long").alias("blocks")), "blocks")
    dealt = sized_join(rows, blocks, "pool", "inner").withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("long"))
    packed = dealt.select("pool", "part", "id", "grp", "v").groupBy("pool", "part").applyInArrow(_pack, "pool string, part long, ids binary, groups array<string>, unit binary")
    return packed, blocks


def _product(k: int, other_group: bool):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, asked = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                x, q = np.frombuffer(r["unit"], "<f8").reshape(len(ids), -1), np.frombuffer(r["q_unit"], "<f8").reshape(len(asked), -1)
                sim = q @ x.T
                drop = asked[:, None] == ids[None, :]
                if other_group:
                    drop |= np.array(r["q_groups"], object)[:, None] == np.array(r["groups"], object)[None, :]
                sim[drop] = -np.inf
                out = []
                for i in range(len(asked)):
                    s = sim[i]
                    at = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                    at = at[np.isfinite(s[at])]
                    at = at[np.lexsort((ids[at], -s[at]))][:k]
                    out += zip([int(asked[i])] * len(at), ids[at].tolist(), s[at].tolist(), strict=True)
                a, b, c = list(zip(*out, strict=True)) or ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["q_id", "id", "score"])

    return run


def topk(queries: DataFrame, rows: DataFrame, k: int, pool: Column | None = None, other_group: bool = False) -> DataFrame:
    """q_id, id, score (cosine), rank of the k nearest rows of each query.

    queries, rows: id long, grp string, v array. pool: an expression over either side; only rows of the query's pool count.
    other_group: only rows of another group count. The filter comes before the ranking, so k rows survive if there are k.
    """
    pool = F.coalesce(pool.cast("string"), F.lit("")) if pool is not None else F.lit("")
    r, blocks = _packed(rows.withColumn("pool", pool), ROWS)
    q, _ = _packed(queries.withColumn("pool", pool), QUERIES)
    q = q.select("pool", F.col("ids").alias("q_ids"), F.col("groups").alias("q_groups"), F.col("unit").alias("q_unit"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part")
    dealt = q.join(blocks, "pool").select("pool", every, "q_ids", "q_groups", "q_unit")
    met = r.join(dealt, ["pool", "part"]).mapInArrow(_product(k, other_group), "q_id long, id long, score double")
    rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k)


def topk_of_pairs(pairs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """q_id, id, score (cosine), rank of the k nearest of each query among its given candidates. pairs: q_id, id; rows: id, v.
    Candidates and queries without a vector take no part."""
    v = lambda name, key: rows.filter("v is not null").select(F.col("id").alias(key), F.col("v").alias(name))
    met = pairs.select("q_id", "id").distinct().join(v("_q", "q_id"), "q_id").join(v("_c", "id"), "id")
    rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), "id"))
    return met.select("q_id", "id", cosine(F.col("_q"), F.col("_c")).alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k)


def similarity_bins(pairs: DataFrame, edges: tuple[float, ...] = (0.9, 0.8, 0.7)) -> DataFrame:
    """Pairs by similarity: a row per bin, named by its lower edge."""
    name = F.lit(None).cast("double")
    for e in sorted(edges):
        name = F.when(F.col("score") > e, F.lit(e)).otherwise(name)
    return pairs.withColumn("bin", name).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def top_groups(pairs: DataFrame, group: str, least: float = 0.7, keep: int = 5) -> DataFrame:
    """group, n, best: the groups with the most pairs of at least that similarity, ties by name."""
    by = pairs.filter(F.col("score") >= least).groupBy(group).agg(F.count("*").alias("n"), F.round(F.max("score"), 5).alias("best"))
    return by.orderBy(F.desc("n"), group).limit(keep)


def mean_pool(windows: DataFrame) -> DataFrame:
    """Mean vector of each id's windows (id, v)."""
    parts = windows.select("id", F.posexplode("v").alias("i", "x")).groupBy("id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


def hashed_vectors(docs: DataFrame, dim: int = 64) -> DataFrame:
    """A deterministic stand-in for an embedding model: signed counts of hashed words, id and v of each text."""
    from kinfolk.functions.text import words

    h = F.transform(words(F.lower("text")), lambda w: F.xxhash64(w))
    slot = lambda x: F.pmod(x, F.lit(dim))
    counts = docs.select("doc_id", F.explode(F.array_distinct(h)).alias("h")).groupBy("doc_id", slot(F.col("h")).alias("i")).agg(F.sum(F.when(F.col("h") > 0, 1.0).otherwise(-1.0)).alias("x"))
    found = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    return found.select(F.col("doc_id").alias("id"), F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("v"))
