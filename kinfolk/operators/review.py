"""Review queues: admission by code evidence, keyword subsystems, kernel votes, ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolk.operators.verdicts import COUNTERPARTS, holds


def identity_relation(exact_name: Column, identity: Column, line: Column, rescue: float = 0.62, compatible: float = 0.72, clone: float = 0.70) -> Column:
    """What a pair's names, identity and lines say together."""
    same = F.when(identity >= rescue, "exact_counterpart").when(line >= clone, "same_name_code_clone").otherwise("same_name_only")
    other = F.when(identity >= compatible, "compatible_renamed").when(line >= clone, "code_clone_renamed").otherwise("family_neighbor")
    return F.when(exact_name, same).otherwise(other)


#: Relations that code evidence alone does not carry to a review.
NOT_REVIEWED = ("family_neighbor", "same_name_only", "nonsemantic_stub")


#: The names of the grounds on which a pair is reviewed, and the least evidence of each, by column.
GROUNDS = [
    ("normalized_fingerprint_with_code_support", [{"fingerprint": 1, "matched": 6, "line_sim": 0.35}, {"fingerprint": 1, "matched": 6, "segment_cover": 0.40}, {"fingerprint": 1, "matched": 6, "identity": 0.7}]),
    ("strong_bilateral_line_similarity", [{"line_sim": 0.6, "matched": 6}]),
    ("multi_signal_code_similarity", [{"line_sim": 0.45, "matched": 8, "cover": 0.5, **more} for more in ({"segment_cover": 0.5}, {"identity": 0.7}, {"literals": 2}, {"fingerprint": 1})]),
    ("identity_supported_large_partial_match", [{"counterpart": 1, "line_sim": 0.35, "matched": 15, "cover": 0.40, "identity": 0.80}]),
    ("supported_substantive_partial_match", [{"line_sim": 0.40, "matched": 12, "cover": 0.55, "segment_cover": 0.50, "identity": 0.75}]),
]
#: The fewest matched lines that any ground asks for.
LEAST_MATCHED = min(rule["matched"] for _, rules in GROUNDS for rule in rules)
#: Weights of the review score; literals count up to 3 and matched lines up to 20.
SCORE = {"line_sim": 0.50, "segment_cover": 0.18, "cover": 0.14, "identity": 0.10, "matched_part": 0.05, "literal_part": 0.03, "fingerprint": 0.05}


def admission(pairs: DataFrame, least_lines: int = 10) -> DataFrame:
    """pairs with basis, the first ground that holds, and review_score; both null for pairs that need no review.

    pairs: tier, relation, excluded, q_lines, c_lines, matched, line_sim, segment_cover, identity, literals, fingerprint.
    """
    fewer = F.least("q_lines", "c_lines")
    part = lambda c, most: F.least(F.lit(1.0), F.col(c) / most)
    rows = pairs.withColumn("cover", F.least(F.lit(1.0), F.col("matched") / F.greatest(fewer, F.lit(1)))).withColumn("counterpart", F.col("relation").isin(*COUNTERPARTS))
    rows = rows.withColumn("matched_part", part("matched", 20)).withColumn("literal_part", part("literals", 3))
    open_ = F.col("tier").isin("review", "weak") & ~F.col("excluded") & ~F.col("relation").isin(*NOT_REVIEWED) & (fewer >= least_lines)
    basis = F.coalesce(*(F.when(open_ & holds(rules), name) for name, rules in GROUNDS))
    total = sum((F.col(c).cast("double") * w for c, w in SCORE.items()), F.lit(0.0))
    out = rows.withColumn("basis", basis).withColumn("review_score", F.when(F.col("basis").isNotNull(), F.bround(F.least(F.lit(1.0), total), 4)))
    return out.drop("cover", "counterpart", "matched_part", "literal_part")


def review_queue(pairs: DataFrame, margin: float = 0.03, keep: int = 1) -> DataFrame:
    """pairs with queue state: of each query's contents the keep best within margin of the best, or with a fingerprint, are
    selected; other admitted pairs are deferred_secondary. A content counts by its best pair."""
    admitted = pairs.filter("basis is not null")
    return admitted.join(_content_states(admitted, margin, keep), ["q_id", "content"])


def _content_states(admitted: DataFrame, margin: float, keep: int) -> DataFrame:
    best = admitted.groupBy("q_id", "content").agg(F.max("review_score").alias("s"), F.bool_or("fingerprint").alias("f"))
    top = F.max("s").over(W.partitionBy("q_id"))
    ranked = best.withColumn("near", F.col("f") | (F.col("s") >= top - margin)).withColumn("r", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("s"), "content")))
    state = F.when(F.col("near") & (F.col("r") <= keep), "selected").otherwise("deferred_secondary")
    return ranked.select("q_id", "content", state.alias("state"))


def content_states(pairs: DataFrame, margin: float = 0.03, keep: int = 1) -> DataFrame:
    """q_id, states: the states that review_queue gives the contents of a query, as a map, to be met by pairs that are made
    again."""
    ranked = _content_states(pairs.filter("basis is not null"), margin, keep).filter("content is not null")
    return ranked.groupBy("q_id").agg(F.map_from_entries(F.collect_list(F.struct("content", "state"))).alias("states"))


def by_content_states(pairs: DataFrame) -> DataFrame:
    """The admitted pairs with state as of review_queue, from their query's states."""
    return pairs.filter("basis is not null").withColumn("state", F.col("states")[F.col("content")]).filter("state is not null").drop("states")


def finalize_deferred(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Deferred pairs of a query whose selected pair was confirmed become supplemental, those of a cleared one dismissed."""
    ruled = queue.join(verdicts.select("q_id", "c_id", "verdict"), ["q_id", "c_id"], "left")
    confirmed = F.coalesce(F.bool_or((F.col("state") == "selected") & (F.col("verdict") == "confirmed")).over(W.partitionBy("q_id")), F.lit(False))
    return ruled.withColumn("outcome", F.when(F.col("state") == "selected", F.col("verdict")).when(confirmed, "supplemental_source").otherwise("dismissed"))


#: Rows that a dimension may have which is put into an expression.
MOST_KEYWORDS = 2000


def subsystems(files: DataFrame, keywords: DataFrame, least: int = 2) -> DataFrame:
    """path, subsystem, hits, is_primary: distinct keywords of a subsystem in a file's text, at least least of them.

    keywords: subsystem, keyword: a dimension that becomes part of the expression, so more than MOST_KEYWORDS rows are an error.
    """
    if len(keywords.limit(MOST_KEYWORDS + 1).collect()) > MOST_KEYWORDS:
        raise ValueError(f"more than {MOST_KEYWORDS} keywords")
    sets = keywords.groupBy("subsystem").agg(F.collect_set(F.lower("keyword")).alias("words")).collect()
    low = F.lower(F.coalesce("text", F.lit("")))
    scores = F.array(*(F.struct(F.lit(r.subsystem).alias("subsystem"), sum((F.contains(low, F.lit(w)).cast("int") for w in sorted(r.words)), F.lit(0)).alias("hits")) for r in sorted(sets)))
    rows = files.select("path", F.filter(scores, lambda s: s["hits"] >= least).alias("s"))
    most = F.array_max(F.transform("s", lambda x: x["hits"]))
    return rows.select("path", most.alias("m"), F.explode("s").alias("x")).select("path", "x.subsystem", "x.hits", (F.col("x.hits") == F.col("m")).alias("is_primary"))


def kernel_type(files: DataFrame, micro: list[str], mono: list[str], repo: str = "repo") -> DataFrame:
    """repo, kind: microkernel from three signs on, else monolithic from two or without any sign, else unknown."""
    signs = lambda ws: sum((F.contains("text", F.lit(w)).cast("int") for w in ws), F.lit(0))
    votes = files.groupBy(repo).agg(F.sum(signs(micro)).alias("micro"), F.sum(signs(mono)).alias("mono"))
    return votes.select(repo, F.when(F.col("micro") >= 3, "microkernel").when((F.col("mono") >= 2) | (F.col("micro") == 0), "monolithic").otherwise("unknown").alias("kind"))


def languages(files: DataFrame, repo: str = "repo") -> DataFrame:
    """repo, lang, loc (lines with text) and rank, the most lines first."""
    loc = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")) != ""))
    by = files.groupBy(repo, "lang").agg(F.sum(loc).alias("loc"))
    return by.withColumn("rank", F.row_number().over(W.partitionBy(repo).orderBy(F.desc("loc"), "lang")))


def disambiguate(candidates: DataFrame, key: str, score: str) -> DataFrame:
    """The best candidates of each key, and whether they tie."""
    rank = F.rank().over(W.partitionBy(key).orderBy(F.desc(score)))
    best = candidates.withColumn("_r", rank).filter("_r = 1").drop("_r")
    return best.withColumn("tied", F.count("*").over(W.partitionBy(key)) > 1)


def library_reuse(pairs: DataFrame) -> DataFrame:
    """Per library: functions, pairs and distinct sources whose side has the same library. pairs: q_id, q_library, c_library, c_source."""
    return pairs.filter("q_library is not null").groupBy(F.col("q_library").alias("library")).agg(F.count_distinct("q_id").alias("functions"), F.count("*").alias("pairs"), F.count_distinct(F.when(F.col("q_library") == F.col("c_library"), F.col("c_source"))).alias("sources"))


def top_candidates(pairs: DataFrame, score: str, keep: int = 4) -> DataFrame:
    """q_id and its keep best candidates in order."""
    ranked = pairs.withColumn("_r", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc(score), "c_id"))).filter(F.col("_r") <= keep)
    return ranked.groupBy("q_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "c_id", score))), lambda x: F.struct(x["c_id"].alias("c_id"), x[score].alias(score))).alias("candidates"))
