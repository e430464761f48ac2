"""Quality classifier by Bradley-Terry pairwise ranking.

A document has a score linear in its features; of a document marked good and one marked bad, the good one is preferred
with the logistic probability of the difference of their scores. So the model is a logistic loss on feature differences,
without intercept, and learns an order rather than a boundary. The boundary is set afterwards at a quantile of the scores
of all training rows: the share of them that is marked bad.

Features are counts and shares over the whole text by built-in functions; one narrow row per document is written, and
labels, fitting and scoring work on these. The fit takes a bounded sample of distinct texts (SAMPLE of each label, by
hash of the text) and PARTNERS preferences of each; the quantile takes every training row, from a histogram whose number
of bins is fixed by BIN and FARTHEST.

Defined results: a null text is an empty one; empty texts have features (all zero) and a score; a document without doc_id
is scored, is not held out and has no label; equal label rows of a document count once, contradicting ones both; labels
other than 0 and 1 are ignored; without training rows of both labels every score is 0.5; an empty table gives no row;
extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.llm.quality_hosts import let, words_of
from kinfolk.runtime import stored

#: Distinct texts of each label that the fit takes at most, and the preferences of each of them.
SAMPLE, PARTNERS = 20_000, 20
#: Where the score says good.
GOOD = 0.7
RIDGE, ROUNDS = 1e-3, 30
#: Standard deviations beyond which a feature counts no more.
FAR = 6.0
#: Histogram of raw scores: width of a bin, and where the outermost bins begin.
BIN, FARTHEST = 1 / 64, 64.0

FEATURES = ["log_words", "distinct_words", "distinct_pairs", "upper", "symbols", "digits", "repeated_lines", "word_length", "bare_words", "short_words", "log_lines"]


@dataclass(frozen=True)
class Model:
    """Centre and spread of each feature, weights of the feature and of its square, and the raw score that counts as GOOD."""

    centre: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    squares: tuple[float, ...]
    cutoff: float = 0.0


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _without(text: Column, pattern: str) -> Column:
    """How many code points a pattern of runs matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(text: Column) -> Column:
    """The FEATURES of a text that is not null, as a struct of doubles."""

    def of_words(w: Column) -> Column:
        n = F.size(w)
        pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))
        distinct_pairs = F.when(n > 1, F.size(F.array_distinct(pairs)) / (n - 1)).otherwise(0.0)
        bare = F.size(F.filter(w, lambda x: ~x.rlike(r"[\p{L}\p{N}]")))
        short = F.size(F.filter(w, lambda x: F.length(x) <= 3))
        values = {
            "log_words": F.log1p(n),
            "distinct_words": _share(F.size(F.array_distinct(w)), n),
            "distinct_pairs": distinct_pairs,
            "word_length": _share(F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)), n),
            "bare_words": _share(bare, n),
            "short_words": _share(short, n),
        }
        return F.struct(*(v.cast("double").alias(k) for k, v in values.items()))

    def of_lines(x: Column) -> Column:
        return F.struct(F.log1p(F.size(x)).alias("log_lines"), _share(F.size(x) - F.size(F.array_distinct(x)), F.size(x)).cast("double").alias("repeated_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x) != "")
    chars = F.length(text)
    found = F.struct(let(words_of(text), of_words).alias("w"), let(lines, of_lines).alias("l"))

    def all_of(x: Column) -> Column:
        values = {
            "upper": _share(_without(text, r"\p{Lu}+"), chars),
            "symbols": _share(_without(text, r"[^\p{L}\p{N}\s]+"), chars),
            "digits": _share(_without(text, r"\p{N}+"), chars),
        }
        of = {name: values[name] if name in values else x["l"][name] if name in ("log_lines", "repeated_lines") else x["w"][name] for name in FEATURES}
        return F.struct(*(of[name].cast("double").alias(name) for name in FEATURES))

    return let(found, all_of)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, h (a hash of the text), x (its features); a stored table."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    left = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return stored(rows.select("doc_id", F.coalesce(left, F.lit(False)).alias("held_out"), F.xxhash64("text").alias("h"), features(F.col("text")).alias("x")), "features")


def training_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """quality, h, x of the labelled rows that are not held out; labels: doc_id, quality."""
    said = labels.filter("doc_id is not null and quality in (0, 1)").select("doc_id", "quality").distinct()
    return rows.filter("not held_out").join(said, "doc_id").select("quality", "h", "x")


def standard(values: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Features in standard deviations from the centre, and their squares."""
    z = np.clip((values - centre) / spread, -FAR, FAR)
    return np.hstack([z, z * z])


def preferences(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Feature differences of preference pairs: every row of the longer side meets PARTNERS rows of the other, dealt in
    turn, so every row takes part and none more than its even share."""
    n = max(len(good), len(bad))
    i, k = np.divmod(np.arange(n * PARTNERS), PARTNERS)
    long, short = i % n, (i + k * (n // PARTNERS + 1)) % min(len(good), len(bad))
    return good[long] - bad[short] if len(good) == n else good[short] - bad[long]


def fit(differences: np.ndarray) -> np.ndarray:
    """The weights of least logistic loss with a ridge, by Newton's method."""
    m, d = differences.shape
    w = np.zeros(d)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(differences @ w, -60, 60)))
        slope = differences.T @ (1 - p) - RIDGE * m * w
        bend = (differences * (p * (1 - p))[:, None]).T @ differences + RIDGE * m * np.eye(d)
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def raw_score(x: Column, model: Model) -> Column:
    """The linear score of a document."""
    total = F.lit(0.0)
    for name, c, s, w, q in zip(FEATURES, model.centre, model.spread, model.weights, model.squares):
        z = F.greatest(F.least((x[name] - c) / s, F.lit(FAR)), F.lit(-FAR))
        total = total + z * w + z * z * q
    return total


def quantile_cutoff(scored: DataFrame) -> float:
    """Of all training rows (quality, raw), the raw score below which as many lie as are marked bad."""
    at = F.floor(F.greatest(F.least("raw", F.lit(FARTHEST)), F.lit(-FARTHEST)) / BIN)
    bins = scored.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("quality")).alias("bad"))
    table = sorted((r["at"], r["n"], r["bad"]) for r in bins.collect())  # at most 2 * FARTHEST / BIN + 1 rows
    bad = sum(r[2] for r in table)
    ends = np.cumsum([r[1] for r in table])
    k = int(np.searchsorted(ends, bad))  # the bin in which the quantile lies
    before = int(ends[k] - table[k][1])
    return (table[k][0] + (bad - before) / table[k][1]) * BIN


def learn(rows: DataFrame) -> Model | None:
    """The model of training rows (quality, h, x); None without rows of both labels."""
    sides = []
    for quality in (1, 0):
        texts = rows.filter(F.col("quality") == quality).groupBy("h").agg(F.min("x").alias("x"))
        sides.append(np.array([list(r["x"]) for r in texts.orderBy("h").limit(SAMPLE).collect()]).reshape(-1, len(FEATURES)))
    good, bad = sides
    if not len(good) or not len(bad):
        return None
    everything = np.vstack(sides)
    centre, spread = everything.mean(axis=0), everything.std(axis=0)
    spread[spread < 1e-9] = 1.0
    w = fit(preferences(standard(good, centre, spread), standard(bad, centre, spread)))
    d = len(FEATURES)
    numbers = [tuple(float(v) for v in part) for part in (centre, spread, w[:d], w[d:])]
    model = Model(*numbers)
    return Model(*numbers, cutoff=quantile_cutoff(rows.select("quality", raw_score(F.col("x"), model).alias("raw"))))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents: doc_id, text. labels: doc_id, quality."""
    rows = described(docs)
    model = learn(training_rows(rows, labels))
    score = F.lit(0.5)
    if model is not None:
        odds = raw_score(F.col("x"), model) - model.cutoff + math.log(GOOD / (1 - GOOD))
        score = 1 / (1 + F.exp(-odds))
    return rows.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
