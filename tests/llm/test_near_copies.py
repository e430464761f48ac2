"""The near-dedup stage of the pipeline against brute force over five-word shingle sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinfolk.llm import near_copies


def rows():
    rng = random.Random(11)
    vocab = [f"w{k}x" for k in range(600)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = [" ".join(prose(120)) for _ in range(30)]
    for edits in (1, 2, 3, 4, 5):
        for k in range(20):
            words = texts[k].split()
            for at in rng.sample(range(120), edits):
                words[at] = "changed"
            texts.append(" ".join(words))
    base = prose(200)
    for k in range(60):
        texts.append(" ".join([*base[:170], *prose(rng.choice((1, 4, 30)))]))
    texts += [None, "", " ", "one two", "One  two", "one two three", texts[0].upper()]
    out = [(k, t) for k, t in enumerate(texts)]
    # a repeated doc_id of which one text is a copy, rows equal in all, and rows without an id
    out += [(500, texts[3]), (500, " ".join(prose(90))), (29, texts[29]), (None, texts[5]), (None, " ".join(prose(80))), (None, None)]
    rng.shuffle(out)
    return out


def shingles(text):
    w = (text or "").encode().lower().split()  # as in operator 3, only ASCII letters have a lower case
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize("small", [16, 2])
def test_near_copies(spark, monkeypatch, small):
    monkeypatch.setattr(near_copies, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_copies, "PAIRS_A_KEY", 7)
    data = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(t) for _, t in data]
    named = [k for k, r in enumerate(data) if r[0] is not None and r[0] != 500]
    df = spark.createDataFrame([(d, t, "en", "s", 3) for d, t in rows()], "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.simhash_dedup(spark, df, "")
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    want = [data[k] for k in named if not any(alike(sets[j], sets[k]) for j in range(k))]
    assert sorted(r for r in got if r[0] is not None and r[0] != 500) == sorted(want)
    assert [r[1] for r in got if r[0] == 500] == [t for d, t in data if d == 500 and not alike(shingles(t), shingles(data[3][1]))]
    assert sorted(len(r[1].split()) for r in got if r[0] is None) == [80]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies.without_near_copies(empty).count() == 0


def test_the_fingerprint_is_a_simhash():
    """Bits by plain counting over the hashes of all shingles, across the runs of 255; ties by the least shingle."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, k, np.uint64)) for k in (1, 2, 4, 255, 256, 700)]
    got = near_copies.simhash_bits(sets, 130)
    one = {int(h): near_copies.simhash_bits([np.array([h])], 130)[0] for s in sets for h in s}
    for s, row in zip(sets, got):
        ones = sum(one[int(h)].astype(int) for h in s)
        assert row.tolist() == [bool(c * 2 > len(s) or (c * 2 == len(s) and one[int(s[0])][k])) for k, c in enumerate(ones)]
    assert all(0.4 < np.mean([one[h][k] for h in one]) < 0.6 for k in range(130))


@pytest.mark.parametrize("g", [3, 4, 5])
def test_tables_find_pairs_at_the_least_similarity(g):
    """Pairs of a similarity of exactly 0.8: at most 1 in 500 is missed by the tables and the two bounds on SimHash bits."""
    rng = np.random.default_rng(g)
    for size, common in ((90, 80), (9, 8), (5, 4)):
        a = [np.unique(rng.integers(0, 1 << 63, size, np.uint64)) for _ in range(1500)]
        b = [np.sort(rng.permutation(s)[:common]) for s in a]
        if size > 5:
            b = [np.unique(np.append(s, rng.integers(0, 1 << 63, size - common, np.uint64))) for s in b]
        parts = near_copies.PARTS[g][size <= near_copies.SHORT]
        x = near_copies.simhash_words(a, g, parts) ^ near_copies.simhash_words(b, g, parts)
        met = np.zeros(x.shape, bool)
        for m in near_copies.masks(near_copies.RADIUS, near_copies.GROUPS * g):
            met |= x & m == 0
        bits = near_copies.GROUPS * g
        near = np.bitwise_count(x & ((1 << bits) - 1)).sum(axis=1) <= near_copies.near_bits(bits * parts, 0.8)
        assert ((met & (np.bitwise_count(x) <= near_copies.NEAR_WORD)).any(axis=1) & near).mean() >= 0.998


def test_candidates_come_from_simhash(spark, monkeypatch):
    """Without the SimHash tables no near copy meets; with them all do."""
    words = [f"w{k}" for k in range(100)]
    data = [(k, " ".join([*words[:99], f"end{k}"])) for k in range(6)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()] == [0]
    original = near_copies.tables
    unlike = F.transform("words", lambda w: F.xxhash64("id", w).bitwiseAND(F.lit((1 << 62) - 1)))
    monkeypatch.setattr(near_copies, "tables", lambda prints, g: original(prints.withColumn("words", unlike), g))
    assert corpus_pipeline.simhash_dedup(spark, df, "").count() == 6


@pytest.mark.parametrize("close", [2, 0])
def test_families_in_small_and_large_buckets(spark, monkeypatch, close):
    """Buckets with many near pairs go to the leaders, and nothing is lost on the way."""
    monkeypatch.setattr(near_copies, "CLOSE", close)
    data = [(d, t) for d, t in rows() if d is not None and d not in (29, 500)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    sets = {d: shingles(t) for d, t in data}
    want = [d for d in sets if not any(j < d and alike(sets[j], sets[d]) for j in sets)]
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()) == sorted(want)
