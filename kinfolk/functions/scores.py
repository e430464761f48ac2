"""Scores and verdict ladders as Column expressions. Every threshold is a parameter with its usual value as default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identity_score(exact_name: Column, name: Column, params_gap: Column, behavior: Column, control: Column) -> Column:
    """0.45 name + 0.20 signature + 0.25 behavior + 0.10 control; an unknown parameter gap counts as one half."""
    by_name = F.when(exact_name, 1.0).otherwise(name)
    signature = F.coalesce(1.0 / (1.0 + F.abs(params_gap)), F.lit(0.5))
    raw = 0.45 * by_name + 0.20 * signature + 0.25 * behavior + 0.10 * control
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def identity_rescued(score: Column, line: Column, matched: Column, least: float = 0.62, line_least: float = 0.15, lines: int = 3) -> Column:
    return (score >= least) & (line >= line_least) & (matched >= lines)


def tier(line: Column, confirmed: float = 0.95, review: float = 0.7, weak: float = 0.5) -> Column:
    return F.when(line > confirmed, "confirmed").when(line >= review, "review").when(line >= weak, "weak")


def rescued_tier(base: Column, fingerprint: Column, structural: Column, identity: Column) -> Column:
    """The tier, or what the strongest other evidence admits; null drops the pair."""
    return F.coalesce(base, F.when(fingerprint, "review").when(structural, "weak").when(identity, "weak"))


def vector_gate(score: Column, *flags: Column, least: float = 0.7) -> Column:
    passed = F.coalesce(score > least, F.lit(False))
    for f in flags:
        passed = passed | F.coalesce(f, F.lit(False))
    return passed


def length_ratio_ok(a: Column, b: Column, least: float = 0.45) -> Column:
    return F.least(a, b) >= least * F.greatest(a, b)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def structural_score(distance: Column, bits: int = 64) -> Column:
    return F.bround(1 - distance / bits, 6)


def segment_rescore(q_cover: Column, c_cover: Column, line: Column, vector: Column) -> Column:
    raw = 0.4 * F.least(q_cover, c_cover) + 0.3 * line + 0.3 * vector
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def retier(old: Column, score: Column, cover: Column, line: Column) -> Column:
    return F.when((old == "weak") & (score > 0.75), "review").when((old == "review") & (cover < 0.3) & (line < 0.2), "dismissed").otherwise(old)


def baseline_derived(same: Column, q_sim: Column, c_sim: Column, both: float = 0.75, single: float = 0.9) -> Column:
    """Both sides near one baseline, or the query very near any."""
    return F.coalesce((same & (q_sim > both) & (c_sim > both)) | (q_sim > single), F.lit(False))


def incremental(sim: Column, lines: Column, base_sim: Column, base_lines: Column, more: float = 0.10, more_lines: int = 3) -> Column:
    return (sim >= base_sim + more) & (lines >= base_lines + more_lines)


def substantive_baseline(fingerprint: Column, sim: Column, lines: Column) -> Column:
    return fingerprint | ((sim >= 0.5) & (lines >= 3))


def pairing_score(identity: Column, line: Column, exact_name: Column) -> Column:
    return 0.45 * identity + 0.35 * line + 0.20 * exact_name.cast("double")


def clone_kind(exact_lines: Column, renamed_lines: Column, kinds: Column | None = None) -> Column:
    """exact, near_dup (up to 0.15 of the matched lines differ in names) or similar. Without matched lines, by the kinds of
    the matched spans if they are given."""
    total = exact_lines + renamed_lines
    by_lines = F.when(renamed_lines == 0, "exact").when(renamed_lines / total <= 0.15, "near_dup").otherwise("similar")
    none = F.lit("similar")
    if kinds is not None:
        has = lambda k: F.coalesce(F.array_contains(kinds, k), F.lit(False))
        none = F.when(has("renamed"), "near_dup").when(has("exact"), "exact").otherwise("similar")
    return F.when(total > 0, by_lines).otherwise(none)


def review_priority(sim: Column, module: Column, lines: Column, kind: Column) -> Column:
    return 100 * (0.45 * sim + 0.25 * module + 0.2 * F.least(F.lit(1.0), lines / 80) + 0.1 * kind)


def cluster_priority(mean: Column, module: Column, loc: Column, repos: Column) -> Column:
    spread = F.least(F.lit(18), F.greatest(F.lit(0), repos - 2) * 2)
    return 100 * (0.5 * mean + 0.3 * module + 0.2 * F.least(F.lit(1.0), loc / 300)) - spread


def priority_level(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def classifier_score(path_hits: Column, symbol_hits: Column, call_hits: Column) -> Column:
    """Hits in a path weigh 7 (up to 11), symbols 10 (up to 13), calls 2 (up to 8)."""
    return F.least(F.lit(11), 7 * path_hits) + F.least(F.lit(13), 10 * symbol_hits) + F.least(F.lit(8), 2 * call_hits)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; a zero vector counts as length one."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = lambda x: F.when(dot(x, x) == 0, 1.0).otherwise(F.sqrt(dot(x, x)))
    return dot(a, b) / (norm(a) * norm(b))
