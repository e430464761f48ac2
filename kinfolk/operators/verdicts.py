"""Verdicts on pairs: rule tables over evidence columns, fall-backs between them, and what a reviewed queue gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Least evidence of each rule, by column. Any rule of a table that holds in full is enough.
OVERRIDE = [{"line_sim": 0.85, "cover": 0.75, "matched": 8}, {"line_sim": 0.70, "cover": 0.85, "matched": 10}]
HUMAN = [{"fingerprint": 1}, {"line_sim": 0.60, "matched": 10}, {"line_sim": 0.35, "matched": 15, "identity": 0.80}]
SECONDARY = [{"fingerprint": 1}, {"literals": 1, "line_sim": 0.55, "matched": 8, "cover": 0.50}]
SECONDARY_COUNTERPART = [{"line_sim": 0.85, "matched": 8, "cover": 0.60}, {"line_sim": 0.65, "matched": 12, "cover": 0.60}]
SECONDARY_OTHER = [{"segment_cover": 1e-9, "line_sim": 0.70, "matched": 12, "cover": 0.60, "identity": 0.80}]
COUNTERPARTS = ("exact_counterpart", "same_name_code_clone")


def holds(rules: list[dict[str, float]]) -> Column:
    """Whether one of the rules holds: every column it names has at least its value (null is 0, true is 1)."""
    each = (reduce(lambda a, b: a & b, (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) >= v for c, v in rule.items())) for rule in rules)
    return reduce(lambda a, b: a | b, each)


def contested(pairs: DataFrame) -> DataFrame:
    """pairs with overrides and needs_human: whether code evidence stands against a negative review at all.

    pairs: tier, relation, agrees (whether both sides do the same work), line_sim, cover, matched, identity, fingerprint.
    """
    open_ = F.col("tier").isin("review", "weak") & F.coalesce("agrees", F.lit(False)) & F.col("relation").isin(*COUNTERPARTS)
    return pairs.withColumn("overrides", F.coalesce(open_ & holds(OVERRIDE), F.lit(False))).withColumn("needs_human", F.coalesce(open_ & holds(HUMAN), F.lit(False)))


def strong_secondary() -> Column:
    """Whether a deferred candidate has evidence of its own that is worth a review."""
    counterpart = F.coalesce(F.col("relation").isin(*COUNTERPARTS), F.lit(False))
    return holds(SECONDARY) | (counterpart & holds(SECONDARY_COUNTERPART)) | (~counterpart & holds(SECONDARY_OTHER))


def secondary_fallback(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Of each query whose selected pair was cleared, the best deferred pair with strong evidence: q_id, c_id.

    queue: q_id, c_id, state, review_score and the evidence columns; verdicts: q_id, c_id, verdict.
    """
    chosen = queue.filter("state = 'selected'").select("q_id", "c_id").join(verdicts, ["q_id", "c_id"], "left")
    cleared = chosen.groupBy("q_id").agg(F.bool_and(F.coalesce(F.col("verdict") == "cleared", F.lit(False))).alias("c")).filter("c").select("q_id")
    left = queue.filter("state = 'deferred_secondary'").filter(strong_secondary()).join(cleared, "q_id", "left_semi")
    return left.groupBy("q_id").agg(F.max(F.struct("review_score", (-F.col("c_id")).alias("n"))).alias("b")).select("q_id", (-F.col("b.n")).alias("c_id"))


def line_similarity(*known: Column, hits: Column, q_lines: Column, c_lines: Column) -> Column:
    """The first similarity that is known, else that of the matched lines."""
    return F.coalesce(*known, F.try_divide(hits, F.greatest(q_lines, c_lines)), F.lit(0.0))


def match_cover(matched: Column, q_lines: Column, c_lines: Column) -> Column:
    """Matched lines over the lines of the shorter side, at most 1."""
    return F.least(F.lit(1.0), matched / F.greatest(F.least(q_lines, c_lines), F.lit(1)))


def effective_lines(matched: Column, line_sim: Column, q_lines: Column) -> Column:
    """Similar lines of the query's side: the matched ones, else its share of similarity, never more than it has."""
    return F.least(q_lines, F.coalesce(F.when(matched > 0, matched), F.round(line_sim * q_lines))).cast("long")


def most_similar(rows: DataFrame, strong: Column, reviewed: Column) -> DataFrame:
    """The strong rows if there is any, else the reviewed ones."""
    marked = rows.withColumn("_s", F.coalesce(strong, F.lit(False))).withColumn("_r", F.coalesce(reviewed, F.lit(False)))
    any_ = marked.agg(F.coalesce(F.bool_or("_s"), F.lit(False)).alias("_any"))  # one row
    return marked.join(F.broadcast(any_)).filter(F.when(F.col("_any"), F.col("_s")).otherwise(F.col("_r"))).drop("_s", "_r", "_any")


def exclusive_counts(rows: DataFrame, key: str, classes: list[str]) -> DataFrame:
    """key and, for each class in order, the functions that no class before it has. rows: key, q_id, cls."""
    flags = rows.groupBy(key, "q_id").agg(*(F.bool_or(F.col("cls") == c).alias(c) for c in classes))
    left = {c: reduce(lambda a, b: a & b, [F.col(c), *(~F.col(x) for x in classes[:k])]) for k, c in enumerate(classes)}
    return flags.groupBy(key).agg(*(F.count_if(x).alias(c) for c, x in left.items()))


def best_source(pairs: DataFrame, flag: Column, name: str) -> DataFrame:
    """Functions with a marked pair: q_id, name's sources in order, the best of them and its similarity."""
    marked = pairs.filter(F.coalesce(flag, F.lit(False)))
    best = marked.groupBy("q_id", "c_source").agg(F.max("line_sim").alias("s"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("n"), "c_source")))  # a row per source
    out = best.groupBy("q_id").agg(ordered.alias("o"))
    return out.select("q_id", F.transform("o", lambda x: x["c_source"]).alias(name), F.col("o")[0]["c_source"].alias("best"), (-F.col("o")[0]["n"]).alias("similarity"))


def history_metrics(confirmed: DataFrame, review: DataFrame, files: DataFrame) -> DataFrame:
    """Per source of any of the three: confirmed functions, lines and modules, reviewed functions that are not confirmed
    there, exactly equal files; ranked by them in this order, then by name.

    confirmed, review: q_id, c_source, hits, module; files: path, c_source.
    """
    one = confirmed.groupBy("c_source").agg(F.count_distinct("q_id").alias("functions"), F.sum("hits").alias("lines"), F.count_distinct("module").alias("modules"))
    two = review.join(confirmed.select("q_id", "c_source").distinct(), ["q_id", "c_source"], "left_anti").groupBy("c_source").agg(F.count_distinct("q_id").alias("reviewed"))
    three = files.groupBy("c_source").agg(F.count_distinct("path").alias("equal_files"))
    names = ["functions", "lines", "modules", "reviewed", "equal_files"]
    out = one.join(two, "c_source", "full_outer").join(three, "c_source", "full_outer").fillna(0, names)
    order = W.orderBy(*(F.desc(c) for c in names), "c_source")  # one row per source
    return out.withColumn("rank", F.row_number().over(order))


def in_fixed_order(rows: DataFrame, column: str, order: list[str], *then: Column) -> DataFrame:
    """Rows sorted by a fixed enumeration of a column (others last), then by more keys."""
    place = F.create_map(*(F.lit(x) for pair in ((v, k) for k, v in enumerate(order)) for x in pair))[F.col(column)]
    return rows.orderBy(F.coalesce(place, F.lit(len(order))), *then)


def partial_match(matched: Column, q_lines: Column, c_lines: Column, least: int = 5, cover: float = 0.35) -> Column:
    """Whether enough lines match, and enough of the shorter side, for a part that was taken over and extended."""
    shorter = F.least(q_lines, c_lines)
    return F.coalesce((matched >= least) & (shorter > 0) & (matched / shorter >= cover), F.lit(False))


#: Fixed value: a line similarity from which a candidate is reported on its own.
REPORTED = 0.5


def reportable(rescued: Column) -> Column:
    """Whether any evidence of a candidate is worth a report (tier, line_sim, fingerprint, literals, has_segments, partial)."""
    evidence = [F.col("tier") == "confirmed", F.col("line_sim") >= REPORTED, F.col("fingerprint"), F.col("literals") > 0, F.col("has_segments"), F.col("partial"), rescued]
    return reduce(lambda a, b: a | b, (F.coalesce(e, F.lit(False)) for e in evidence))


def by_priority(findings: DataFrame, severities: list[str], groups: list[tuple[Column, int]], other: int) -> DataFrame:
    """Findings by severity, then by the place of the first group that takes them, then the most confident first.

    groups: conditions in order of precedence with their places, which may differ from it.
    """
    place = F.lit(other)
    for condition, at in reversed(groups):
        place = F.when(condition, at).otherwise(place)
    severity = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, severities)), F.col("severity")), F.lit(0)), F.lit(len(severities) + 1))
    return findings.orderBy(severity, place, F.desc("confidence"), "id")
