"""Substring dedup by level-wise doubling: windows repeated at one length alone are extended to twice that length.

Levels for windows of 50 words: 13, 25, 50 (each at most twice the one before). A window's hash comes from the hashes of
two windows of the length before, so all lengths cost a few array operations. The first levels need not look at every
window: of the 25-word windows inside any 50-word window, the one whose 13-word start has the smallest hash is its
anchor. Equal 50-word windows have equal anchors, so anchors that occur once, at 13 or at 25 words, cannot be in a
repeated 50-word window; about 2 in 27 windows are anchors. Only the 50-word windows around the anchors that survive are
made at the last level.

Documents with equal word sequences are treated once: all words of the later ones go, as their every window starts in the
first. Texts are shuffled only to meet their surviving anchors, and once more where words go.

Defined results: a null text has no words; a document of fewer words than a window keeps all; rows with a null doc_id
keep their text and remove nothing; rows with one doc_id are one document as far as "smaller doc_id" goes, each judged on
its own text; an empty table gives an empty result; extra columns are ignored. Shorter windows are told apart by 64-bit hashes, which
only choose candidates; windows of the last level, which decide, by 96 bits of two independent ones.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolk.llm.words import lists, pieces, utf8, word_hashes
from kinfolk.runtime import scratch, stored

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def levels(window: int, start: int) -> list[int]:
    """Lengths from about start to window, each at most twice the one before."""
    out = [window]
    while out[-1] > start:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def doubled(h: np.ndarray, have: int, want: int) -> np.ndarray:
    """Hashes of the windows of want words from those of have words; have <= want <= 2 * have."""
    step = want - have
    if not step:
        return h
    x = h[:-step] * _A + h[step:]
    x ^= x >> np.uint64(31)
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def window_hashes(h: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """For each length, a hash per window start, as many as there are words (zeros where no window fits)."""
    out, now, have = [], h, 1
    for length in lengths:
        while have < length and len(now):
            want = min(length, 2 * have)
            now, have = doubled(now, have, want) if len(now) > want - have else now[:0], want
        full = np.zeros(len(h), np.uint64)
        full[: len(now)] = now
        out.append(full)
    return out


def _slide(v: np.ndarray, width: int, op, back: bool = False) -> np.ndarray:
    """op over v[i : i + width] (back: v[i - width + 1 : i + 1]); values beyond the ends are left out."""
    out, have = v.copy(), 1
    while have < width:
        step = min(have, width - have)
        old = out.copy()
        if back:
            op(old[step:], old[:-step], out=out[step:])
        else:
            op(old[:-step], old[step:], out=out[:-step])
        have += step
    return out


def anchors(first: np.ndarray, starts_window: np.ndarray, width: int) -> np.ndarray:
    """Which positions hold the smallest value of first among the width positions from some window start on."""
    if len(first) < width:
        return np.zeros(len(first), bool)
    least = np.where(starts_window, _slide(first, width, np.minimum), np.uint64(0))
    return starts_window_any(starts_window, width) & (first == _slide(least, width, np.maximum, back=True))


def starts_window_any(starts_window: np.ndarray, width: int) -> np.ndarray:
    return _slide(starts_window, width, np.logical_or, back=True)


def _fits(bounds: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n word positions start a window that ends inside its text."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(n) + window <= ends


def _survey(window: int, start: int):
    lengths = levels(window, start)
    inner = lengths[:-1]
    width = window - inner[-1] + 1

    def run(batches):
        for b in pieces(batches):
            words = [t.split() for t in utf8(b.column("text"))]
            sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            h, bounds = word_hashes(words)
            n = len(words)
            counts = np.diff(bounds)
            hashed = window_hashes(h, inner)
            at = np.flatnonzero(anchors(hashed[0], _fits(bounds, len(h), window), width)) if len(h) >= window else np.empty(0, np.int64)
            row = np.searchsorted(bounds, at, side="right") - 1
            columns = [b.column("rid"), b.column("doc_id"), b.column("tkey"), pa.array(counts, pa.int64()), pa.array(sha)]
            columns += [lists((at - bounds[row]).astype(np.int32), row, n, pa.int32())]
            columns += [lists(x[at].view(np.int64), row, n, pa.int64()) for x in hashed]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "tkey", "n_words", "sha", "pos", *(f"h{k}" for k in range(len(inner)))])

    ddl = "rid long, doc_id long, tkey long, n_words long, sha string, pos array<int>, " + ", ".join(f"h{k} array<long>" for k in range(len(inner)))
    return run, ddl, inner, width


def _extend(window: int, start: int):
    """The last level: the windows around surviving anchors, with the text for the words that go."""
    width = window - levels(window, start)[-2] + 1

    def run(batches):
        for b in pieces(batches):
            words = [t.split() for t in utf8(b.column("text"))]
            h, bounds = word_hashes(words)
            (full,) = window_hashes(h, [window])
            (other,) = window_hashes(word_hashes(words, seed=1)[0], [window])
            fits = _fits(bounds, len(h), window)
            near = np.zeros(len(h), bool)
            marks = b.column("pos")
            rows = np.repeat(np.arange(len(words)), np.diff(marks.offsets.to_numpy()))
            near[bounds[rows] + marks.flatten().to_numpy()] = True
            at = np.flatnonzero(_slide(near, width, np.logical_or) & fits)
            row = np.searchsorted(bounds, at, side="right") - 1
            columns = [b.column("rid"), b.column("doc_id"), lists((at - bounds[row]).astype(np.int32), row, len(words), pa.int32()), lists(full[at].view(np.int64), row, len(words), pa.int64()), lists((other[at] >> np.uint64(32)).astype(np.uint32).view(np.int32), row, len(words), pa.int32()), b.column("text")]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "pos", "h", "g", "text"])

    return run, "rid long, doc_id long, pos array<int>, h array<long>, g array<int>, text string"


def _cut(window: int, keep_text: bool):
    """Removed words and what is left, from texts and the starts of the windows that go."""

    def run(batches):
        for b in pieces(batches):
            removed, sha, left = [], [], []
            for text, starts in zip(utf8(b.column("text")), b.column("starts").to_pylist(), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, starts, 1)
                np.add.at(gone, np.asarray(starts) + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest())
                left.append(without(text, gone).decode("utf-8") if keep_text else None)
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())], ["rid", "n_removed", "kept_sha256", "left_text"])

    return run, "rid long, n_removed long, kept_sha256 string, left_text string"


def without(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words that are gone and the white space after each."""
    out, at = [], 0
    for k, m in enumerate(re.finditer(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)):
        if not k:
            out.append(text[: m.start()])
        if not gone[k]:
            out.append(m[0])
        at = m.end()
    return b"".join(out) if at else text


def _repeated(candidates: DataFrame, key: str) -> DataFrame:
    """The candidates whose key occurs twice or more."""
    often = stored(candidates.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key), "often")
    return candidates.join(often, key, "left_semi")


def remove_repeats(docs: DataFrame, window: int = 50, start: int = 13, keep_text: bool = False, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tkey, n_words, n_removed, kept_sha256 (and left_text: null where the text stays or wholly goes) of every document.

    A word goes if a window of words over it also starts in a document with a smaller doc_id.
    """
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tkey"))
    run, ddl, inner, _ = _survey(window, start)
    survey = stored(source.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(run, ddl), "survey")
    long_ones = survey.filter((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    first = stored(long_ones.groupBy("sha").agg(F.min(F.struct("doc_id", "rid")).alias("first")).select("sha", F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("first_rid")), "first")

    with scratch(docs.sparkSession):
        hashes = [f"h{k}" for k in range(len(inner))]
        sole = long_ones.select("rid", F.arrays_zip("pos", *hashes).alias("z")).join(first.select(F.col("first_rid").alias("rid")), "rid", "left_semi")
        found = sole.select("rid", F.explode("z").alias("x")).select("rid", "x.*")
        for key in hashes:
            found = stored(_repeated(found, key).drop(key), "level")
        marks = found.groupBy("rid").agg(F.sort_array(F.collect_list("pos")).alias("pos"))
        keys = survey.select("rid", "doc_id", "tkey").join(marks, "rid")
        extend, extended = _extend(window, start)
        tried = stored(keys.join(source, ["doc_id", "tkey"]).dropDuplicates(["rid"]).select("rid", "doc_id", "pos", "text").mapInArrow(extend, extended), "windows")

        windows = tried.select("rid", "doc_id", F.explode(F.arrays_zip("pos", "h", "g")).alias("x")).select("rid", "doc_id", "x.pos", "x.h", "x.g")
        owners = stored(windows.groupBy("h", "g").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").drop("last"), "owners")
        # written first, so that a hot window's rows stand alone in their exchange and can be split
        hits = stored(windows.join(owners, ["h", "g"]).filter("doc_id > owner").select("rid", "pos"), "hits")
        going = hits.groupBy("rid").agg(F.collect_list("pos").alias("starts"))
        cut, cut_ddl = _cut(window, keep_text)
        cuts = stored(tried.select("rid", "text").join(going, "rid").mapInArrow(cut, cut_ddl).withColumnRenamed("rid", "first_rid"), "cuts", outlives=True)

    cut_of = first.join(cuts, "first_rid", "left").select("sha", "first_id", "n_removed", "kept_sha256", "left_text")
    rows = survey.select("doc_id", "tkey", "n_words", "sha").join(cut_of, "sha", "left")
    copy = (F.col("n_words") >= window) & (F.col("doc_id") > F.col("first_id"))
    own = (F.col("n_words") >= window) & (F.col("doc_id") == F.col("first_id")) & F.col("n_removed").isNotNull()
    return rows.select(
        "doc_id",
        "tkey",
        "n_words",
        F.when(copy, F.col("n_words")).when(own, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(own, F.col("kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(own, F.col("left_text")).alias("left_text"),
    )
