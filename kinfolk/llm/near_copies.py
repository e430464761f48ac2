"""Near copies by SimHash with covering locality-sensitive hashing, verified by the exact Jaccard similarity of five-word
shingle sets.

A text's fingerprint is a SimHash of its shingle set: a bit is 1 if it is set in over half of the shingles' hashes; the
least shingle breaks ties. At a similarity of 0.8 a bit differs with odds of 0.15, so the 64 bits and two differing ones
of operator 3 are too few: here a fingerprint has parts of 7 groups of bits, and each part has the covering family of
simhash_covering.masks for RADIUS differing bits, that is 7 tables that keep 4 of the 7 groups. How many bits a group has
follows from the number of rows, so that unlike texts rarely meet however many there are, and how many parts there are
(PARTS) from the odds that a part finds a pair at 0.8: all parts together miss 1 in 4000 of them, and fewer above. What is
found is exact: pairs that meet and are near by SimHash are verified on their shingle sets. Rows and classes are told
apart by 128 bits.

Texts with equal shingle sets are a class and treated once, under the smallest row. A row goes if a smaller row (by doc_id,
null last, then by a hash of the row) has at least the similarity asked for, so no two rows at or above it stay. Tables
are sorted by key once; buckets of up to SMALL_BUCKET classes and CLOSE near pairs a class are compared pair by pair. In
larger ones, a few leaders (the smallest of each deal) first take out what is like them; the rest of a bucket then meets
its smaller members, each pair in the first bucket that both share only. Pairs that cannot be alike are not made: a
shingle that no other text of large buckets has is not shared, so the shingles left bound the similarity of every pair,
exactly. What remains is in proportion to a family's size times the number of its texts that no leader takes out and that
have few shingles of their own.

Defined results: null and texts without words are one class; texts of fewer than n words are one shingle; of rows equal
in doc_id and text one stays; rows that share a doc_id, or have none, are judged each on its own text.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.llm.simhash_covering import masks
from kinfolk.llm.substring_doubling import window_hashes
from kinfolk.llm.words import lists, pieces, utf8, word_hashes
from kinfolk.runtime import scratch, sized_join, stored

RADIUS = 2
#: Groups of bits in a part, as many as the tables of a covering family.
GROUPS = (1 << (RADIUS + 1)) - 1
#: By bits of a group: parts of a fingerprint, and of one of at most SHORT shingles, where a bit differs with odds of 0.19 at 0.8.
PARTS = {3: (12, 20), 4: (22, 42), 5: (41, 91), 6: (75, 199)}
SHORT = 5
#: Rows that share a key by chance, at most, up to 2^29 rows.
BY_CHANCE = 32
#: A word of a fingerprint is a part and the bits after it, WORD in all. Words of near texts differ in at most NEAR_WORD bits.
WORD, NEAR_WORD = 63, 14
SMALL_BUCKET, CLOSE = 128, 2
#: Leaders of a large bucket, round by round.
LEADERS = (1, 4)
#: Pairs that one copy of a shingle set meets in a task's key.
PAIRS_A_KEY = 256

_RNG = np.random.default_rng(42)
_ODD = _RNG.integers(0, 1 << 63, 160, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, 160, np.uint64)
#: The bits of each value of a byte, one in each byte of a long.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def near_bits(bits: Column | int, least: float) -> Column | float:
    """How many of so many SimHash bits texts of the similarity differ in, at most: five deviations above the mean."""
    odds = np.arccos(2 * least / (1 + least)) / np.pi
    # at most SHORT shingles: 3 of 16 at 0.8
    odds = max(odds, (1 - least) * 15 / 16)
    return bits * float(odds) + 5 * (odds * (1 - odds)) ** 0.5 * (F.sqrt(bits) if isinstance(bits, Column) else bits**0.5)


def group_bits(rows: int) -> int:
    """Bits of a group so that at most BY_CHANCE of the rows share a key of a table by chance."""
    return next((g for g in PARTS if rows <= BY_CHANCE << (RADIUS + 2) * g), max(PARTS))


def row_key(doc: Column, text: Column) -> Column:
    """128 bits of a row: what one verdict depends on must not be shared by chance, however many rows there are."""
    none = lambda c: F.when(c.isNull(), "0").otherwise("1")
    parts = (none(doc), F.coalesce(doc.cast("string"), F.lit("")), F.lit("|"), none(text), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [t.lower().split() for t in texts]
    h, bounds = word_hashes(words)
    (full,) = window_hashes(h, [n])
    out = []
    for w, a, b in zip(words, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(full[a : b - n + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(w))] if w else [], np.uint64))
    return out


def simhash_bits(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """The SimHash of each sorted set (none of them empty), a row of bits a set."""
    h = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    # a byte counts up to 255 shingles
    runs = -(-sizes // 255)
    first = np.cumsum(runs) - runs
    cuts = np.repeat(starts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    h = h ^ (h >> np.uint64(32))
    out = []
    for k in range(-(-bits // 64)):
        x = h * _ODD[k] + _ADD[k]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        each = x.astype("<u8").view(np.uint8).reshape(-1, 8)
        some = np.add.reduceat(_SPREAD[each], cuts, axis=0).view(np.uint8)
        ones = 2 * np.add.reduceat(some, first, axis=0, dtype=np.int64)
        least = np.unpackbits(each[starts], axis=1, bitorder="little") > 0
        out.append((ones > sizes[:, None]) | ((ones == sizes[:, None]) & least))
    return np.concatenate(out, axis=1)[:, :bits]


def simhash_words(sets: list[np.ndarray], g: int, parts: int) -> np.ndarray:
    """A row per set and a column per part: the part's bits, and above them those that follow."""
    bits = simhash_bits(sets, (parts - 1) * GROUPS * g + WORD)
    at = np.arange(parts)[:, None] * (GROUPS * g) + np.arange(WORD)
    return bits[:, at] @ (np.int64(1) << np.arange(WORD, dtype=np.int64))


def _survey(n: int, g: int):
    def run(batches):
        for b in pieces(batches):
            sets = shingle_sets(utf8(b.column("text")), n)
            size = np.array([len(s) for s in sets], np.int64)
            cls = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
            words: list = [[]] * len(sets)
            for which, parts in zip((size > SHORT, (size > 0) & (size <= SHORT)), PARTS[g], strict=True):
                some = np.flatnonzero(which)
                for k, w in zip(some, simhash_words([sets[k] for k in some], g, parts) if len(some) else ()):
                    words[k] = w
            yield pa.RecordBatch.from_arrays([b.column("rk"), b.column("doc_id"), cls, pa.array(size), pa.array(words, pa.list_(pa.int64()))], ["rk", "doc_id", "cls", "size", "words"])

    return run, "rk binary, doc_id long, cls binary, size long, words array<long>"


def _sets(n: int):
    def run(batches):
        for b in pieces(batches):
            sets = shingle_sets(utf8(b.column("text")), n)
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), lists(flat, np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets), pa.int64())], ["id", "s"])

    return run, "id long, s array<long>"


def tables(prints: DataFrame, g: int) -> DataFrame:
    """key (table and the bits it keeps), word, id and size of every fingerprint in every table."""
    words = prints.select("id", "size", F.posexplode("words").alias("part", "word"))
    keys = (F.shiftleft((F.col("part") * GROUPS + v).cast("long"), GROUPS * g).bitwiseOR(F.col("word").bitwiseAND(F.lit(m).cast("long"))) for v, m in enumerate(masks(RADIUS, GROUPS * g)))
    return words.select("id", "size", "word", F.explode(F.array(*keys)).alias("key"))


def _meet(g: int, small: int, close: int):
    """Of rows sorted by key and id: near pairs of small buckets, each once a part; the keys of the other buckets."""
    family = masks(RADIUS, GROUPS * g)

    def met(key: np.ndarray, word: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        hot = sizes > small
        run = np.repeat(np.arange(len(starts)), sizes)
        later = np.where(hot[run], 0, (starts + sizes)[run] - np.arange(len(key)) - 1)
        a = np.repeat(np.arange(len(key)), later)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
        x = word[a] ^ word[b]
        near = np.bitwise_count(x) <= NEAR_WORD
        a, b, x = a[near], b[near], x[near]
        table = (key[a] >> (GROUPS * g)) % GROUPS
        fresh = np.ones(len(a), bool)
        for v, m in enumerate(family):
            fresh &= (table <= v) | (x & m != 0)
        a, b = a[fresh], b[fresh]
        hot |= np.bincount(run[a], minlength=len(starts)) > close * sizes
        cold = ~hot[run[a]]
        a, b, keys = ids[a[cold]], ids[b[cold]], key[starts[hot]]
        none, pair = np.zeros(len(keys), np.int64), np.zeros(len(a), np.int64)
        no, yes = np.ones(len(keys), bool), np.zeros(len(a), bool)
        columns = [pa.array(np.concatenate(c), mask=np.concatenate(m)) for c, m in (((a, none), (yes, no)), ((b, none), (yes, no)), ((pair, keys), (~yes, ~no)))]
        return pa.RecordBatch.from_arrays(columns, ["small", "big", "hot"])

    def run(batches):
        held = [np.empty(0, np.int64)] * 3
        for batch in chain(batches, [None]):
            if batch is None:
                at = len(held[0])
            else:
                held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "word", "id"))]
                at = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if at:
                yield met(*(h[:at] for h in held))
            # of a large bucket no more than shows it to be one
            held = [h[at : at + small + 1] for h in held]

    return run, "small long, big long, hot long"


def _close(pairs: DataFrame, prints: DataFrame, g: int, least: float) -> DataFrame:
    """The pairs (small, big) whose fingerprints differ in few bits and whose sizes allow the similarity."""
    low = F.lit((1 << GROUPS * g) - 1).cast("long")
    words = prints.select("id", "words", "size")
    met = pairs.join(words.toDF("small", "w1", "n1"), "small").join(words.toDF("big", "w2", "n2"), "big")
    off = F.aggregate(F.zip_with("w1", "w2", lambda x, y: F.coalesce(F.bit_count(x.bitwiseXOR(y).bitwiseAND(low)), F.lit(0))), F.lit(0), lambda s, x: s + x)
    size = F.least("n1", "n2") >= F.lit(least) * F.greatest("n1", "n2")
    return met.filter(size & (off <= near_bits(GROUPS * g * F.least(F.size("w1"), F.size("w2")), least))).select("small", "big")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The big ids of the pairs (small, big) whose sets have the similarity."""
    often = stored(pairs.groupBy("small").agg(F.ceil(F.count("*") / PAIRS_A_KEY).cast("int").alias("parts")), "parts")
    dealt = sized_join(pairs, often, "small", "inner").withColumn("part", F.pmod(F.xxhash64("big"), "parts").cast("int"))
    held = sets.join(often.withColumnRenamed("small", "id"), "id").select(F.col("id").alias("small"), F.col("s").alias("s1"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = dealt.join(sets.select(F.col("id").alias("big"), F.col("s").alias("s2")), "big").join(held, ["small", "part"])
    both = F.size(F.array_intersect("s1", "s2"))
    return met.filter(both >= F.lit(least) * (F.size("s1") + F.size("s2") - both)).select(F.col("big").alias("id")).distinct()


def _ordered(x: str, y: str, least: float) -> Column:
    """x is smaller than y, and the shingles that each shares with any other text allow the similarity."""
    both = F.least(F.col(f"{x}.shared"), F.col(f"{y}.shared"))
    return (F.col(x) < F.col(y)) & (both >= F.lit(least) * (F.col(f"{x}.size") + F.col(f"{y}.size") - both))


def _pairs(met: DataFrame, x: str, y: str) -> DataFrame:
    return met.select(F.col(f"{x}.id").alias("small"), F.col(f"{y}.id").alias("big")).distinct()


def _own(sets: DataFrame) -> DataFrame:
    """id and own: how many shingles of each set (id, s) no other set has."""
    once = sets.select("id", F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.first("id").alias("id"))
    return once.filter("n = 1").groupBy("id").agg(F.count("*").alias("own"))


def _large(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """key, m (with shared) and keys (all of its large buckets) of the members of large buckets that can be like another."""
    docs = stored(members.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys")), "large_ids")  # as many keys as tables at most
    own = stored(_own(sized_join(sets, docs.select("id"), "id", "left_semi")), "own")
    docs = stored(sized_join(docs, own, "id", "left"), "large_ids")
    shared = F.col("size") - F.coalesce("own", F.lit(0))
    rows = sized_join(members, docs, "id", "inner").select("key", F.struct("id", "size", shared.alias("shared")).alias("m"), "keys")
    return stored(rows.filter(F.col("m.shared") >= F.lit(least) * F.col("m.size")), "large")


def going_members(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ids that have a smaller like one in a large bucket. members: key, id, size, once each."""
    large = _large(members, sets, least)
    gone = stored(members.select("id").limit(0), "gone")
    rest = large
    for k in LEADERS:
        heads = stored(rest.groupBy("key", F.pmod(F.xxhash64("m.id", F.lit(k)), F.lit(k)).alias("deal")).agg(F.min("m").alias("l")).select("key", "l"), "leaders")
        met = sized_join(rest, heads, "key", "inner").filter(_ordered("l", "m", least))
        gone = stored(gone.union(_alike(stored(_pairs(met, "l", "m"), "pairs"), sets, least)).distinct(), "gone")
        left = rest.withColumn("id", F.col("m.id"))
        rest = stored(sized_join(left, gone, "id", "left_anti").select("key", "m", "keys"), "rest")
    others = large.select("key", F.col("m").alias("l"), F.col("keys").alias("l_keys"))
    first = F.array_min(F.array_intersect("keys", "l_keys")) == F.col("key")
    met = rest.join(others, "key").filter(_ordered("l", "m", least) & first)
    return stored(gone.union(_alike(stored(_pairs(met, "l", "m"), "pairs"), sets, least)).distinct(), "gone")


def without_near_copies(docs: DataFrame, n: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs (doc_id, text and others) that have no smaller row of the given similarity."""
    keyed = docs.withColumn("_rk", row_key(F.col("doc_id"), F.col("text")))
    # only the rows whose fate is not the usual one outlive this: the result needs them and docs alone
    with scratch(docs.sparkSession):
        g = group_bits(docs.count())
        run, ddl = _survey(n, g)
        source = keyed.select(F.col("_rk").alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        rows = stored(source.mapInArrow(run, ddl), "survey")
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk")
        classes = rows.groupBy("cls").agg(F.min(order).alias("m"), F.first("size").alias("size"))
        # ids in the order of the classes' smallest rows
        classes = stored(classes.orderBy("m").select("cls", F.col("m.rk").alias("rk"), "size", F.monotonically_increasing_id().alias("id")), "classes")

        prints = stored(sized_join(rows.select("rk", "words"), classes.select("rk", "id", "size"), "rk", "inner").dropDuplicates(["id"]).select("id", "size", "words"), "prints")
        found, made = _meet(g, SMALL_BUCKET, CLOSE)
        met = stored(tables(prints, g).select("key", "word", "id").repartition("key").sortWithinPartitions("key", "id").mapInArrow(found, made), "met")
        pairs = stored(met.filter("hot is null").select("small", "big").distinct(), "met_pairs")
        hot = stored(met.filter("hot is not null").select(F.col("hot").alias("key")), "buckets")

        def sets_of(ids: DataFrame) -> DataFrame:
            asked = stored(classes.select("rk", "id").join(ids.distinct(), "id"), "asked")
            make, made = _sets(n)
            texts = sized_join(source.select("rk", "text"), asked, "rk", "inner").dropDuplicates(["id"])
            return stored(texts.select("id", "text").mapInArrow(make, made), "sets")

        gone = stored(classes.select("id").limit(0), "gone")
        if not hot.isEmpty():
            members = stored(sized_join(tables(prints, g).select("key", "id", "size"), hot, "key", "inner"), "members")
            gone = going_members(members, sets_of(members.select("id")), least)
        pairs = sized_join(pairs, gone.withColumnRenamed("id", "big"), "big", "left_anti")
        pairs = stored(_close(pairs, prints, g, least), "pairs")
        sets = sets_of(pairs.select(F.col("small").alias("id")).union(pairs.select("big")))
        gone = stored(gone.union(_alike(pairs, sets, least)).distinct(), "gone")

        judged = sized_join(classes, gone.withColumn("_gone", F.lit(True)), "id", "left")
        judged = stored(judged.select("cls", F.col("rk").alias("id"), F.coalesce("_gone", F.lit(False)).alias("goes")), "judged")
        stays = ~F.col("goes") & (F.col("rk") == F.col("id"))
        fate = sized_join(rows.select("rk", "cls"), judged, "cls", "inner").groupBy("rk").agg(F.bool_or(stays).alias("stays"), F.count("*").alias("n"))
        changed = stored(fate.filter(~F.col("stays") | (F.col("n") > 1)).select(F.col("rk").alias("_rk"), "stays"), "changed", outlives=True)
    whole = sized_join(keyed, changed.select("_rk"), "_rk", "left_anti")
    repeated = changed.filter("stays").select("_rk")
    if not repeated.isEmpty():
        whole = whole.union(sized_join(keyed, repeated, "_rk", "left_semi").dropDuplicates(["_rk"]))
    return whole.select(*docs.columns)
