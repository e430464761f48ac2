"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores labels spans of mixed texts.

The model is learned from all training rows in one pass: counts of letter trigrams (hashed to BUCKETS) and of scripts for
each language, summed by task before they are shuffled. Its size is languages x BUCKETS, whatever the corpus; only that
table reaches the driver. A word's score in a language is the sum of its trigrams' log probabilities; languages that do
not use a script of the word are out for that word. The best labelling pays SWITCH for every change of language between
neighbouring words; it is found for all texts of a piece at once, word position by word position.

Defined results: a null text or one without a letter is "und" with score 0 and no span; a text whose scripts no language
uses falls to the most frequent language; ties go to the first language in code-point order; rows without a language,
a text or an id are not learned from; with nothing learned every text is "und"; repeated rows are labelled alike; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kinfolk.llm.words import pieces

BUCKETS = 1 << 16
#: Log-probability units; about the evidence of two clear words.
SWITCH = 12.0
#: A language uses a script if at least this share of its letters are in it.
SCRIPT_SHARE = 0.005
OUT = -1e4
PIECE = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
#: First and last code point of the main ranges of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x2D00, 0x2D2F)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and the number of its script (0: other)."""
    letter = np.zeros(0x110000, bool)
    letter[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True
    script = np.zeros(0x110000, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return letter, script


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, a newline after each, and where each text starts (and the end)."""
    low = [t.lower() for t in texts]
    bounds = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in low], out=bounds[1:])
    return np.frombuffer("".join(t + "\n" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def _trigrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram around each letter (BUCKETS where there is no letter), and the letters."""
    letter = _tables()[0][points]
    c = np.where(letter, points, 0).astype(np.uint32)
    h = c * np.uint32(0x9E3779B1)
    h[1:] += c[:-1] * np.uint32(0x85EBCA77)
    h[:-1] += c[1:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    h >>= np.uint32(16)
    return np.where(letter, h, BUCKETS).astype(np.int32), letter


def held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Languages that a model may have: its table, languages times BUCKETS counts, comes to the driver and goes to every task.
MOST_LANGUAGES = 256


def learn(rows: DataFrame) -> dict:
    """The model from rows of lang and text; more than MOST_LANGUAGES languages are an error."""

    def count(batches):
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for b in pieces(batches, limit=PIECE):
            points, bounds = _points([t or "" for t in b.column("text").to_pylist()])
            tri, letter = _trigrams(points)
            kind = _tables()[1][points]
            names, number = np.unique(b.column("lang").to_pylist(), return_inverse=True)
            langs = np.repeat(number, np.diff(bounds))
            n = np.bincount(langs * (BUCKETS + 1) + tri, minlength=len(names) * (BUCKETS + 1)).reshape(len(names), -1)
            s = np.bincount(langs[letter] * 256 + kind[letter], minlength=len(names) * 256).reshape(len(names), -1)
            for k, name in enumerate(names.tolist()):
                grams[name] = grams.get(name, 0) + n[k, :BUCKETS]
                scripts[name] = scripts.get(name, 0) + s[k]
        for name in grams:
            for part, values in (("gram", grams[name]), ("script", scripts[name])):
                at = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array([part] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(values[at], pa.int64())], ["lang", "part", "bucket", "n"])

    some = [r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(some) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the column lang holds something else")
    counts = rows.select("lang", "text").mapInArrow(count, "lang string, part string, bucket int, n long")
    found = counts.groupBy("lang", "part", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    places = {x: k for k, x in enumerate(langs)}
    number = np.array([places[x] for x in found.column("lang").to_pylist()], np.int64)
    part = np.array([x == "gram" for x in found.column("part").to_pylist()], bool)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    grams = np.zeros((len(langs), BUCKETS))
    scripts = np.zeros((len(langs), 256))
    grams[number[part], bucket[part]] = n[part]
    scripts[number[~part], bucket[~part]] = n[~part]
    total = grams.sum(1, keepdims=True)
    logp = np.zeros((len(langs), BUCKETS + 1), np.float32)
    if langs:
        logp[:, :BUCKETS] = np.log((grams + 0.1) / (total + 0.1 * BUCKETS))
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
    prior = np.log((total[:, 0] + 1) / (total.sum() + len(langs))) if langs else np.zeros(0)
    return {"langs": langs, "logp": logp, "uses": uses, "prior": prior}


def word_scores(points: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the words, their scores by language and their numbers of letters."""
    space = (points == 32) | ((points >= 9) & (points <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    tri, letter = _trigrams(points)
    sums = np.zeros(len(points) + 1)
    scores = np.empty((len(starts), len(model["langs"])))
    for k in range(len(model["langs"])):
        np.cumsum(model["logp"][k][tri], dtype=np.float64, out=sums[1:])
        scores[:, k] = sums[ends] - sums[starts]
    count = np.concatenate(([0], np.cumsum(letter)))
    letters = count[ends] - count[starts]
    kind = _tables()[1][points]
    for s in np.unique(kind[letter]).tolist():
        if not model["uses"][:, s].all():
            has = np.concatenate(([0], np.cumsum(letter & (kind == s))))
            inside = has[ends] > has[starts]
            scores[np.ix_(inside, ~model["uses"][:, s])] += OUT
    none = (scores <= OUT / 2).all(1)
    scores[none] = 0.0
    return starts, scores, letters


def best_labels(scores: np.ndarray, first: np.ndarray, counts: np.ndarray, switch: float, prior: np.ndarray) -> np.ndarray:
    """The best language of every word, for texts whose words start at first in scores; all texts step together."""
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    longest = int(counts[0]) if len(counts) else 0
    stays = np.ones(scores.shape, bool)
    top = np.zeros(len(scores), np.int32)
    labels = np.zeros(len(scores), np.int32)
    live = np.searchsorted(-counts, -np.arange(1, longest + 1), side="right")
    v = None
    for t in range(longest):
        n = live[t]
        at = first[:n] + t
        if t:
            v = v[:n]
            best = v.max(1) - switch
            keep = v >= best[:, None]
            stays[at] = keep
            v = np.where(keep, v, best[:, None]) + scores[at]
        else:
            v = scores[at] + prior
        top[at] = v.argmax(1)
    state = np.zeros(len(counts), np.int32)
    for t in range(longest - 1, -1, -1):
        n = live[t]
        ends = live[t + 1] if t + 1 < longest else 0
        at = first[:n] + t
        state[ends:n] = top[at[ends:n]]
        labels[at] = state[:n]
        moved = ~stays[at, state[:n]]
        if t and moved.any():
            state[:n][moved] = top[at[moved] - 1]
    return labels


def label(texts: list[str | None], model: dict, switch: float = SWITCH) -> tuple[list[str], np.ndarray, tuple[np.ndarray, ...]]:
    """Languages and scores of some texts, and their spans as arrays: text, start word, words, number of the language."""
    langs = model["langs"]
    texts = [t or "" for t in texts]
    n = len(texts)
    lettered = np.array([_LETTER.search(t) is not None for t in texts], bool)
    if not langs:
        return ["und"] * n, np.zeros(n), tuple(np.empty(0, np.int64) for _ in range(4))
    points, bounds = _points(texts)
    starts, scores, letters = word_scores(points, model)
    first = np.searchsorted(starts, bounds)
    counts = np.diff(first)
    labels = best_labels(scores, first[:-1], counts, switch, model["prior"])
    row = np.repeat(np.arange(n), counts)
    by = np.bincount(row * len(langs) + labels, weights=letters, minlength=n * len(langs)).reshape(n, -1)
    total = by.sum(1)
    known = lettered & (total > 0)
    score = np.where(known, by.max(1) / np.maximum(total, 1), 0.0)
    named = ["und" if not k else langs[p] for k, p in zip(known, by.argmax(1), strict=True)]
    change = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    length = np.diff(change, append=len(labels))
    shown = known[row[change]]
    change, length = change[shown], length[shown]
    return named, score, (row[change], change - first[row[change]], length, labels[change])


_SPAN = pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())])


def _label(model: dict, switch: float):
    names = pa.array(model["langs"], pa.string())

    def run(batches):
        for b in pieces(batches, limit=PIECE):
            named, score, (row, start, length, lang) = label(b.column("text").to_pylist(), model, switch)
            values = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(length, pa.int32()), names.take(pa.array(lang, pa.int64()))], fields=list(_SPAN))
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(named) + 1)), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(named, pa.string()), pa.array(score), spans], ["doc_id", "held_out", "lang_pred", "score", "spans"])

    return run


def annotate(docs: DataFrame, model: dict, lang_as: str, score_as: str, switch: float = SWITCH) -> DataFrame:
    """docs with two more columns: the language of its column text, and the score."""

    def run(batches):
        for b in pieces(batches, limit=PIECE):
            named, score, _ = label(b.column("text").to_pylist(), model, switch)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(named, pa.string()), pa.array(score)], [*b.schema.names, lang_as, score_as])

    schema = StructType([*docs.schema.fields, StructField(lang_as, StringType()), StructField(score_as, DoubleType())])
    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: dict, switch: float = SWITCH) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the letters in words of that language), spans (start word, n_words, lang)."""
    ddl = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start:int,n_words:int,lang:string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_label(model, switch), ddl)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of docs that are not held out, then label all of them."""
    return predict(docs, learn(training_rows(docs)))
