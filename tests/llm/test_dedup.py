"""SimHash near-dedup and substring dedup against brute force, with every odd case in one small table."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from kinfolk.llm import simhash_covering, substring_doubling

SCHEMA = "doc_id long, text string, source string, fp string, rid string, sha string, tkey string, h0 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(3)
    vocab = [f"w{k}é" for k in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long, shared = prose(6000), prose(70)
    texts = [None, "", "  \n\t ", "one", "One two", long, long, long.upper(), prose(300)]
    texts += [f"{prose(40)}\n{shared}\n{prose(30)}" for _ in range(6)]
    texts += [texts[9]] * 3 + ["same word " * 200] * 2 + [prose(49), prose(50), texts[8] + " end", shared, "\x0b".join(shared.split())]
    near = prose(400).split()
    for k in range(30):
        near[k * 7] = "x"
        texts.append(" ".join(near))
    out = [(k, t) for k, t in enumerate(texts)]
    out += [(8, texts[8]), (3, "other text of one id"), (None, shared), (None, None)]
    return [(i, t, "s", "a", "b", "c", "d", "e") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def brute_windows(data, window):
    first = {}
    for d, t in data:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in data:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,start", [(50, 13), (50, 25), (7, 3)])
def test_substring_dedup(docs, window, start):
    data = [(r[0], r[1]) for r in rows()]
    out = substring_doubling.remove_repeats(docs, window, start)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()), key=str)
    assert got == brute_windows(data, window)


def test_cut_text(docs):
    out = substring_doubling.remove_repeats(docs, keep_text=True).filter("left_text is not null").collect()
    assert out
    for r in out:
        assert hashlib.sha256(" ".join(WORD.findall(r.left_text)).encode()).hexdigest() == r.kept_sha256


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, radius):
    parent = {k: k for k in range(len(items))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i] ^ items[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(k) for k in range(len(items))]


@pytest.mark.parametrize("small", [64, 1])
def test_simhash(docs, monkeypatch, small):
    monkeypatch.setattr(simhash_covering, "SMALL_BUCKET", small)
    data = [(r[0], r[1]) for r in rows() if r[0] is not None]
    fps = [brute_fingerprint(t) for _, t in data]
    groups = brute_components(fps, 2)
    least = {}
    for (d, _), g in zip(data, groups):
        least[g] = min(least.get(g, d), d)
    want = sorted((d, f"{f:016x}", least[g]) for (d, _), f, g in zip(data, fps, groups))
    out = simhash_covering.near_duplicates(docs).filter("doc_id is not null")
    got = sorted((r.doc_id, r.f, r.component_id) for r in out.select("doc_id", simhash_covering.hex_fingerprint(F.col("fp")).alias("f"), "component_id").collect())
    assert got == want


def test_masks_cover_every_pair_of_bits():
    for radius in (1, 2, 3):
        family = [m & (1 << 64) - 1 for m in simhash_covering.masks(radius)]
        rng = random.Random(radius)
        for _ in range(500):
            bits = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & bits == 0 for m in family)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_covering.near_duplicates(empty).count() == 0
    assert substring_doubling.remove_repeats(empty).count() == 0


def test_rows_without_an_id_link_others(spark):
    fps = {0: 0b0, 3: 0b11, 15: 0b1111}
    rows = spark.createDataFrame([(1, fps[0]), (None, fps[3]), (2, fps[15]), (None, 15 << 40)], "doc_id long, fp long")
    original = simhash_covering.fingerprints
    try:
        simhash_covering.fingerprints = lambda docs, *a: docs
        out = {(r.doc_id, r.fp): r.component_id for r in simhash_covering.near_duplicates(rows).collect()}
    finally:
        simhash_covering.fingerprints = original
    assert out == {(1, 0): 1, (None, 3): 1, (2, 15): 1, (None, 15 << 40): None}


def test_two_hashes_of_windows_are_independent():
    words = [[b"a", b"b", b"c"], [b"d"]]
    first, bounds = substring_doubling.word_hashes(words)
    second, _ = substring_doubling.word_hashes(words, seed=1)
    assert bounds.tolist() == [0, 3, 4] and (first != second).all()
    assert substring_doubling._extend(50, 13)[1] == "rid long, doc_id long, pos array<int>, h array<long>, g array<int>, text string"
