"""Segment verification: pairs of middling evidence are judged again by their segments, matched one to one.

Only the best candidate contents of each query are verified; other pairs keep their tier and say so. A content (language
and code) is cut into segments once, whatever number of pairs it is in, and two contents are matched once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.functions.scores import retier, segment_rescore
from kinfolk.functions.text import words
from kinfolk.operators import code_rows
from kinfolk.operators.align import assign
from kinfolk.operators.matching import bounded, list_rows
from kinfolk.operators.selection import select_contents
from kinfolk.runtime import sized_join, stored

#: Tiers that are verified, contents of each query, and the similarity above which segments match.
ELIGIBLE, CONTENTS, LEAST = ("review", "weak"), 2, 0.85
#: Distinct tokens that are multiplied at once.
VOCABULARY = 4096


def cosines(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Cosine of the token counts of each segment of a with each of b: flat token hashes and where each segment ends."""
    vocabulary, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    sides = []
    for x, ends in ((codes[: len(a)], a_ends), (codes[len(a) :], b_ends)):
        segment = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        cells, n = np.unique(segment * np.int64(len(vocabulary)) + x, return_counts=True)
        sides.append((*np.divmod(cells, max(len(vocabulary), 1)), n.astype(np.float64)))
    gain = np.zeros((len(a_ends), len(b_ends)))
    norms = [np.sqrt(np.bincount(s, n * n, minlength=len(ends))) for (s, _, n), ends in zip(sides, (a_ends, b_ends))]
    for lo in range(0, len(vocabulary), VOCABULARY):
        blocks = []
        for (s, t, n), ends in zip(sides, (a_ends, b_ends)):
            here = (t >= lo) & (t < lo + VOCABULARY)
            dense = np.zeros((len(ends), min(VOCABULARY, len(vocabulary) - lo)))
            dense[s[here], t[here] - lo] = n[here]
            blocks.append(dense)
        gain += blocks[0] @ blocks[1].T
    return gain / np.maximum(norms[0], 1e-300)[:, None] / np.maximum(norms[1], 1e-300)[None, :]


def segment_tokens(contents: DataFrame) -> DataFrame:
    """content, tokens (hashes of all segments' lower-case words, in order) and ends (where each segment ends in them)."""
    parts = code_rows.segments(contents.select("content", "lang", "code", F.lit(1).alias("start_line")))
    parts = parts.select("content", "seg_start", F.transform(words(F.lower("segment")), lambda w: F.xxhash64(w)).alias("t"))
    listed = parts.groupBy("content").agg(F.array_sort(F.collect_list(F.struct("seg_start", "t"))).alias("s"))
    ends = F.transform(F.sequence(F.lit(1), F.size("s")), lambda k: F.aggregate(F.slice("s", 1, k), F.lit(0).cast("long"), lambda n, x: n + F.size(x["t"])))
    return listed.select("content", F.flatten(F.transform("s", lambda x: x["t"])).alias("tokens"), ends.alias("ends"))


def matched_segments(pairs: DataFrame, least: float = LEAST) -> DataFrame:
    """q_content, c_content, seg_hits (one-to-one pairs of the assignment of largest total that are above least), q_total,
    c_total, whole_sim (cosine of both contents as one segment) from q_content, c_content, q_tokens, q_ends, c_tokens,
    c_ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            hits, totals, whole = [], [], []
            for q, q_ends, c, c_ends in zip(*(list_rows(b.column(x)) for x in ("q_tokens", "q_ends", "c_tokens", "c_ends")), strict=True):
                gain = cosines(q, q_ends, c, c_ends)
                hits.append(sum(gain[i, j] > least for i, j in assign(gain)) if gain.size else 0)
                totals.append((len(q_ends), len(c_ends)))
                whole.append(float(cosines(q, np.array([len(q)]), c, np.array([len(c)]))[0, 0]))
            columns = [pa.array(x, pa.int64()) for x in (hits, [t[0] for t in totals], [t[1] for t in totals])]
            names = ["q_content", "c_content", "seg_hits", "q_total", "c_total", "whole_sim"]
            yield pa.RecordBatch.from_arrays([b.column("q_content"), b.column("c_content"), *columns, pa.array(whole, pa.float64())], names)

    return pairs.mapInArrow(run, "q_content string, c_content string, seg_hits long, q_total long, c_total long, whole_sim double")


def content_id(lang: Column, code: Column) -> Column:
    """A hash of language and code: what is cut and matched once."""
    return F.sha2(F.concat_ws("\n", F.lower(F.coalesce(lang, F.lit(""))), F.coalesce(code, F.lit(""))), 256)


def selected_pairs(pairs: DataFrame, sources: DataFrame, contents: int = CONTENTS) -> DataFrame:
    """The eligible pairs with q_content, c_content, content_rank and state (selected or deferred_secondary)."""
    ids = sources.select("id", content_id(F.col("lang"), F.col("code")).alias("content"))
    side = lambda p: ids.select(F.col("id").alias(f"{p}_id"), F.col("content").alias(f"{p}_content"))
    rows = pairs.filter(F.col("tier").isin(*ELIGIBLE)).join(side("q"), "q_id").join(side("c"), "c_id")
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rank = F.struct(F.coalesce("fingerprint", F.lit(False)), *(number(c) for c in ("line_sim", "matched", "identity", "vector_sim")))
    return select_contents(rows, "q_id", "c_content", rank, "c_id", contents)


def matched_contents(wanted: DataFrame, sources: DataFrame, least: float = LEAST) -> DataFrame:
    """What matched_segments gives for the q_content, c_content of wanted, each pair of contents once, stored."""
    needed = stored(wanted.select(F.explode(F.array("q_content", "c_content")).alias("content")).distinct(), "needed")
    bodies = sized_join(sources.select(content_id(F.col("lang"), F.col("code")).alias("content"), F.lower(F.coalesce("lang", F.lit(""))).alias("lang"), F.coalesce("code", F.lit("")).alias("code")), needed, "content", "left_semi")
    cut = stored(segment_tokens(bodies.dropDuplicates(["content"])), "segments")
    side = lambda p: cut.select(*(F.col(c).alias(f"{p}_{c}") for c in cut.columns))
    met = wanted.select("q_content", "c_content").distinct().join(side("q"), "q_content").join(side("c"), "c_content")
    return stored(matched_segments(met, least), "matched_segments")


def rescored(out: DataFrame) -> DataFrame:
    """Rows with q_cover, c_cover, score and tier, from tier_before, state, line_sim, vector_sim and the numbers of
    matched_segments (see verify_segments)."""
    cover = lambda p: F.col("seg_hits") / F.greatest(F.col(f"{p}_total"), F.lit(1))
    out = out.withColumn("q_cover", F.when(F.col("state") == "selected", cover("q"))).withColumn("c_cover", F.when(F.col("state") == "selected", cover("c")))
    line, vector = F.coalesce("line_sim", F.lit(0.0)), F.coalesce("vector_sim", "whole_sim", F.lit(0.0))
    score = F.bround(segment_rescore(F.col("q_cover"), F.col("c_cover"), line, vector), 4)
    out = out.withColumn("score", F.when(F.col("state") == "selected", score))
    after = retier(F.col("tier_before"), F.col("score"), F.least("q_cover", "c_cover"), line)
    return out.withColumn("tier", F.when(F.col("state") == "selected", after).otherwise(F.col("tier_before")))


def best_contents(rows: Callable[[DataFrame | None], DataFrame], contents: DataFrame, keep: int = CONTENTS) -> DataFrame:
    """q_id, chosen: the keep best contents of each query, as selected_pairs ranks them, where pairs of one query and content
    have the same evidence (as those found by lines do). Stored.

    rows makes the eligible pairs anew (q_id, c_id, c_content, line_sim, hits), with the columns it is given by q_id;
    contents: id, content. Each pass takes the next content of every query, of kinds of pairs instead of pairs.
    """
    chosen = None
    for _ in range(keep):
        left = rows(chosen)
        left = left if chosen is None else left.filter(F.col("chosen").isNull() | ~F.array_contains("chosen", F.col("c_content")))
        kinds = left.groupBy("q_id", "line_sim", "hits").agg(F.min("c_id").alias("c_id"))
        best = stored(kinds.groupBy("q_id").agg((-F.max(F.struct("line_sim", "hits", (-F.col("c_id")).alias("n")))["n"]).alias("id")), "best_contents")
        found = best.join(contents, "id").select("q_id", F.array("content").alias("next"))
        chosen = found.select("q_id", F.col("next").alias("chosen")) if chosen is None else chosen.join(found, "q_id", "left").select("q_id", F.concat("chosen", F.coalesce("next", F.array().cast("array<string>"))).alias("chosen"))
        chosen = stored(chosen, "chosen")
    return chosen


def verify_segments(pairs: DataFrame, sources: DataFrame, contents: int = CONTENTS, least: float = LEAST) -> DataFrame:
    """pairs with state, seg_hits, q_cover, c_cover, score, tier_before and the tier that follows.

    pairs: q_id, c_id, tier, fingerprint, line_sim, matched, identity, vector_sim; sources: id (unique), lang, code. state
    is selected, deferred_secondary (a query's further contents), or null for pairs that are not eligible; only selected
    pairs have the numbers and may change their tier. Null evidence counts as none; where vector_sim is null, the cosine of
    the two contents' words stands for it.
    """
    chosen = stored(selected_pairs(pairs, sources, contents).select("q_id", "c_id", "q_content", "c_content", "state"), "chosen")
    wanted = chosen.filter("state = 'selected'")
    found = matched_contents(wanted, sources, least)
    judged = chosen.join(found, ["q_content", "c_content"], "left").drop("q_content", "c_content")
    return rescored(pairs.withColumnRenamed("tier", "tier_before").join(judged, ["q_id", "c_id"], "left"))


def summary(verified: DataFrame) -> DataFrame:
    """One row: eligible, verified, deferred, upgraded (weak to review) and dismissed pairs."""
    is_ = lambda c, x: F.coalesce(F.col(c) == x, F.lit(False))
    return verified.agg(
        F.count_if(F.col("state").isNotNull()).alias("eligible"),
        F.count_if(is_("state", "selected")).alias("verified"),
        F.count_if(is_("state", "deferred_secondary")).alias("deferred"),
        F.count_if(is_("tier_before", "weak") & is_("tier", "review")).alias("upgraded"),
        F.count_if(is_("tier_before", "review") & is_("tier", "dismissed")).alias("dismissed"),
    )
