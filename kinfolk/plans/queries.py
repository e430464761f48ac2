"""The library's registered queries: each applies an operator to whole driver tables.

documents stands for functions (source for the repository, lang for the language, text for the code), embeddings for the
vector store (label for the module), events for commits, orders and customer for the job catalog. Search queries ask with
the rows whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolk.functions import scores as S
from kinfolk.functions import text as X
from kinfolk.operators import align, contracts, fingerprints, history, lines, recall, rollup, search, selection, vectors
from kinfolk.runtime import sized_join, stored

#: Fixed dimension of the classifier: module, keywords.
RULES = {"core": ("the", "der", "les", "los"), "link": ("and", "und", "et", "y"), "place": ("in", "on", "en", "dans")}
CONTROL = ("and", "or", "of", "in", "to", "que", "und", "et", "de")
PATTERNS = {"amount": r"[0-9]{3}", "email": r"[a-z0-9.]+@[a-z0-9.]+", "symbol": r"[#$%&]{3}"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(column: str = "doc_id"):
    return F.col(column) % 50 == 0


def exact_fingerprint(spark, sf_dir):
    return recall.exact_fingerprint(table(spark, sf_dir, "documents"), asked())


def file_identity_or(spark, sf_dir):
    return recall.file_identity(table(spark, sf_dir, "documents"), asked())


def common_file_breadth(spark, sf_dir):
    return recall.breadth(table(spark, sf_dir, "documents"))


def first_line():
    return F.coalesce(F.get(X.line_array(F.col("text")), F.lit(0)), F.lit(""))


def name_recall(spark, sf_dir):
    return recall.name_matches(table(spark, sf_dir, "documents"), asked(), first_line())


def rare_string_hits(spark, sf_dir):
    return lines.rare_line_hits(table(spark, sf_dir, "documents"), asked())


def pair_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = recall.exact_fingerprint(docs, asked()).select("q_id", "c_id", F.lit(1.0).alias("score"))
    return lines.pair_upsert(known, lines.rare_line_hits(docs, asked()))


def token_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return fingerprints.token_idf(fingerprints.document_tokens(docs), docs.count()).withColumn("weight", F.round("weight", 6))


def shingles_4(spark, sf_dir):
    runs = X.shingles(X.words(F.lower("text")))
    found = table(spark, sf_dir, "documents").select("doc_id", runs.alias("s"))
    return found.select("doc_id", F.size("s").alias("n_shingles"), F.size(F.array_distinct("s")).alias("n_distinct"))


def fingerprinted(spark, sf_dir) -> DataFrame:
    return stored(fingerprints.weighted_fingerprints(fingerprints.weighted_tokens(table(spark, sf_dir, "documents"))), "fps")


def simhash_fingerprint(spark, sf_dir):
    return fingerprinted(spark, sf_dir).select("doc_id", "fp", "n_tokens")


def simhash_neighbors_15(spark, sf_dir):
    fps = fingerprinted(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return fingerprints.neighbors(fps.filter(asked()), fps.select("doc_id", "fp", "n_tokens", "lang"))


def relaxed_band_pool(spark, sf_dir):
    fps = fingerprinted(spark, sf_dir)
    return fingerprints.band_pool(fps.filter(asked()), fps).groupBy("q_id").agg(F.count("*").alias("n_pool"))


def vector_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("grp"), F.col("embedding").alias("v"), "label")


def vector_topk_filtered(spark, sf_dir):
    rows = vector_rows(spark, sf_dir)
    return vectors.topk(rows.filter(asked("id")), rows, 20, other_group=True).select("q_id", "id", F.round("score", 5).alias("score"), "rank")


def pool_topk(spark, sf_dir):
    rows = vector_rows(spark, sf_dir)
    return vectors.topk(rows.filter(asked("id")), rows, 5, pool=F.col("label")).select("q_id", "id", F.round("score", 5).alias("score"), "rank")


def baseline_argmax(spark, sf_dir):
    rows = vector_rows(spark, sf_dir)
    best = vectors.topk(rows.filter("label <> 0"), rows.filter("label = 0"), 1)
    return best.select("q_id", F.col("id").alias("baseline_id"), F.round("score", 5).alias("score"), (F.col("score") > 0.35).alias("derived"))


def similarity_bins(spark, sf_dir):
    rows = vector_rows(spark, sf_dir)
    return vectors.similarity_bins(vectors.topk(rows.filter(asked("id")), rows, 20), (0.45, 0.4, 0.35, 0.3))


def channels(spark, sf_dir) -> DataFrame:
    """Three channels; the vector of a number is taken for the document of that number (see evidence_queries.six_channels)."""
    docs = table(spark, sf_dir, "documents")
    rows = vector_rows(spark, sf_dir)
    near = vectors.topk(rows.filter(asked("id")), rows, 5).select("q_id", F.col("id").alias("c_id"), F.round("score", 5).alias("score"))
    exact = recall.exact_fingerprint(docs, asked()).select("q_id", "c_id", F.lit(1.0).alias("score"))
    named = recall.name_matches(docs, asked(), first_line()).select("q_id", "c_id", F.lit(0.0).alias("score"))
    return recall.recall_union([("vector", near), ("fingerprint", exact), ("name", named)])


def recall_union_provenance(spark, sf_dir):
    return channels(spark, sf_dir)


def retrieval_funnel(spark, sf_dir):
    return recall.funnel(channels(spark, sf_dir), ["vector", "fingerprint", "name"])


def identity_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    w = X.words(F.lower("text"))
    sides = docs.select("doc_id", X.name_tokens(first_line()).alias("name"), F.regexp_count(first_line(), F.lit(",")).alias("params"), F.array_distinct(F.filter(w, lambda x: F.length(x) >= 8)).alias("behavior"), F.array_intersect(w, F.array(*map(F.lit, CONTROL))).alias("control"))
    pairs = lines.line_links(docs, F.lit(True)).select("q_id", "c_id")
    side = lambda p: sides.select(*(F.col(c).alias(f"{p}_{'id' if c == 'doc_id' else c}") for c in sides.columns))
    met = pairs.join(side("q"), "q_id").join(side("c"), "c_id")
    score = S.identity_score(F.col("q_name") == F.col("c_name"), X.jaccard(F.col("q_name"), F.col("c_name")), F.col("q_params") - F.col("c_params"), X.jaccard(F.col("q_behavior"), F.col("c_behavior")), X.jaccard(F.col("q_control"), F.col("c_control")))
    return met.select("q_id", "c_id", F.round(score, 4).alias("identity"))


def links_of(spark, sf_dir) -> lines.Links:
    """Links of all documents, whose pairs can be made more than once."""
    return lines.document_links(table(spark, sf_dir, "documents"), F.lit(True))


def tiered(p: DataFrame) -> DataFrame:
    """Pairs with tiers; the q side's language is its module."""
    return p.withColumnRenamed("q_lang", "module").withColumn("tier", S.tier(F.col("line_sim")))


def pairs_of(spark, sf_dir) -> DataFrame:
    return tiered(links_of(spark, sf_dir).pairs())


def module_rows(spark, sf_dir, *more: Column) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("q_id"), F.col("lang").alias("module"), *more)


def tier_counts(spark, sf_dir):
    return pairs_of(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), F.sum("c_copies").alias("n_documents"))


def line_alignment_tiers(spark, sf_dir):
    out = align.verified_pairs(table(spark, sf_dir, "documents"), F.lit(True), CONTROL)
    return out.withColumn("line_sim", F.round("line_sim", 6))


def segment_assignment(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 10).cast("long").alias("g"), "vec_id", "embedding")
    parts = rows.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("segments"))  # ten rows a group
    pairs = parts.select(F.col("g").alias("q_id"), F.col("segments").alias("q_segments")).join(parts.select((F.col("g") - 1).alias("q_id"), F.col("g").alias("c_id"), F.col("segments").alias("c_segments")), "q_id")
    return align.match_segments(pairs, 0.15)


def segment_selection(spark, sf_dir):
    links = links_of(spark, sf_dir)
    ranks = stored(selection.content_ranks(links.pairs(), "q_id", "c_source", ["line_sim", "hits"], "c_id"), "content_ranks")
    out = selection.by_content_ranks(links.pairs(ranks), "c_source")
    return out.select("q_id", "c_id", "content_rank", "state")


def dominated_suppression(spark, sf_dir):
    links = links_of(spark, sf_dir)
    best = stored(links.pairs().groupBy("q_id").agg(F.max("line_sim").alias("best")), "best")
    p = tiered(links.pairs(best)).withColumn("identity", F.col("line_sim"))
    return p.select("q_id", "c_id", selection.dominated(F.col("best"), strong=0.5).alias("dominated"))


def widespread_annotation(spark, sf_dir):
    p = pairs_of(spark, sf_dir).withColumn("score", F.col("line_sim"))
    return selection.widespread(p, least=5)


def baseline_propagation(spark, sf_dir):
    bench = stored(table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(X.line_array(F.col("text")))).alias("line")).distinct(), "bench")
    known = sized_join(lines.line_table(table(spark, sf_dir, "documents")), bench, "line", "left_semi").select(F.col("doc_id").alias("c_id")).distinct().withColumn("b", F.lit(True))
    links, known = links_of(spark, sf_dir), stored(known, "known")
    flags = links.pairs(c_more=known).groupBy("q_id").agg(F.bool_or(F.coalesce("b", F.lit(False))).alias("baseline"))
    return links.pairs(stored(flags, "baseline_flags")).select("q_id", "c_id", "baseline")


def categories_of(spark, sf_dir) -> DataFrame:
    p = pairs_of(spark, sf_dir).select("q_id", F.col("tier").alias("category"))
    return module_rows(spark, sf_dir).join(p, "q_id", "left").select("q_id", "module", F.coalesce("category", F.lit("none")).alias("category"))


def submodule_rollup(spark, sf_dir):
    spine = table(spark, sf_dir, "documents").select(F.col("lang").alias("module")).distinct()
    return rollup.submodule_stats(categories_of(spark, sf_dir), spine, ["confirmed", "review", "weak", "none"])


def undetected(spark, sf_dir):
    """Documents without a link."""
    found = pairs_of(spark, sf_dir).select("q_id")
    return module_rows(spark, sf_dir, F.length("text").cast("long").alias("size")).join(found, "q_id", "left_anti").select("q_id", "size")


def source_metrics_rank(spark, sf_dir):
    return rollup.rank_sources(rollup.source_metrics(pairs_of(spark, sf_dir).filter("q_source <> c_source")))


def closest_source(spark, sf_dir):
    return source_metrics_rank(spark, sf_dir).filter("rank = 1")


REASONS = ["internal", "cross_language", "thin"]


def exclusive_exclusions(spark, sf_dir):
    p = pairs_of(spark, sf_dir)
    same, other, thin = F.col("q_source") == F.col("c_source"), F.col("module") != F.col("c_lang"), F.col("hits") < 2
    reasons = F.array(*(F.struct(F.lit(r).alias("reason"), x.alias("on")) for r, x in zip(REASONS, (same, other, thin))))
    # kinds of pairs of a document, not its pairs
    kinds = stored(p.select("q_id", reasons.alias("reasons"), ((F.col("q_source") != F.col("c_source")) & (F.col("module") == F.col("c_lang")) & ~thin).alias("ok")).distinct(), "kinds")
    rows = kinds.select("q_id", F.explode("reasons").alias("x")).filter("x.on").select("q_id", "x.reason")
    return rollup.exclusion_totals(rows, REASONS, kinds.filter("ok"))


def overview_reconcile(spark, sf_dir):
    p = pairs_of(spark, sf_dir)
    ok = (F.col("q_source") != F.col("c_source")) & (F.col("module") == F.col("c_lang")) & (F.col("hits") >= 2)
    by = p.groupBy("q_id").agg(F.when(F.bool_or(ok), "similar").otherwise("excluded").alias("cls"))
    return rollup.overview(module_rows(spark, sf_dir).join(by, "q_id", "left").select("q_id", F.coalesce("cls", F.lit("none")).alias("cls")))


def file_line_coverage(spark, sf_dir):
    return lines.line_coverage(table(spark, sf_dir, "documents")).withColumn("coverage", F.round("coverage", 6))


def cluster_priority(spark, sf_dir):
    out = rollup.clusters(pairs_of(spark, sf_dir))
    return out.withColumn("mean_sim", F.round("mean_sim", 6)).withColumn("priority", F.round("priority", 4))


def module_classifier(spark, sf_dir):
    rules = spark.createDataFrame([(m, k, w) for k, (m, ws) in enumerate(RULES.items()) for w in ws], "module string, ordinal int, keyword string")
    docs = table(spark, sf_dir, "documents")
    w = X.words(F.lower("text"))
    heads = F.transform(X.line_array(F.lower("text")), lambda x: F.split(x, " ")[0])
    return rollup.classify(docs, rules, F.col("source"), heads, w)


def regex_evidence_scan(spark, sf_dir):
    return search.evidence(table(spark, sf_dir, "documents"), PATTERNS)


def html_visible_text(spark, sf_dir):
    t = X.visible_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t.cast("binary")).alias("text_md5"), F.length(t).alias("n_chars"))


def url_identity(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.url_identity(F.col("url")).alias("identity")).withColumn("storage_key", X.storage_key(F.col("identity")))


def full_text_search(spark, sf_dir):
    return search.search_all(search.postings(table(spark, sf_dir, "documents")), ["the", "and", "of"])


def call_chain(spark, sf_dir):
    """Which kinds of event each user reaches, in how few steps, from the first one."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    node = F.concat(F.col("event_type"), F.lit(":"), F.col("user_id").cast("string"))
    steps = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", node.alias("caller"))
    steps = stored(steps.withColumn("callee", F.lead("caller").over(order)).withColumn("k", F.row_number().over(order)), "steps")
    edges = stored(steps.filter("callee is not null").select("caller", "callee").distinct(), "edges")
    return search.reachable(edges, steps.filter("k = 1").select(F.col("caller").alias("node")))


def reference_full_outer(spark, sf_dir):
    """Names of every source against those of src0; reference_only names are in no other source."""
    docs = table(spark, sf_dir, "documents").select("source", first_line().alias("name"), "doc_id").filter(F.length("name") >= 5)
    q = docs.filter("source <> 'src0'").groupBy("source", "name").agg(F.min("doc_id").alias("q_id"))
    both = q.join(docs.filter("source = 'src0'").groupBy("name").agg(F.min("doc_id").alias("r_id")), "name", "full_outer")
    state = F.when(F.col("q_id").isNull(), "reference_only").when(F.col("r_id").isNull(), "current_only").otherwise("both")
    return both.select("source", "name", "q_id", "r_id", state.alias("state"))


def commits_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("grp"), F.when(F.col("event_type") != "error", F.col("value")).alias("size"))


def large_commit_threshold(spark, sf_dir):
    return history.large_changes(commits_of(spark, sf_dir), "grp", floor=100, factor=2).withColumn("threshold", F.round("threshold", 4))


def close_large_pairs(spark, sf_dir):
    return history.close_pairs(commits_of(spark, sf_dir).fillna(0.0, ["size"]), "grp", 24, 50).drop("gap_hours")


def stage_ranges(spark, sf_dir):
    seq = F.row_number().over(W.partitionBy("grp").orderBy("ts", "id")) - 1
    commits = stored(commits_of(spark, sf_dir).withColumn("seq", seq), "seq")
    stages = commits.filter("seq % 10 = 0").select("grp", (F.col("seq") / 10).cast("int").alias("stage"), F.col("seq").alias("start"))
    last = commits.groupBy("grp").agg(F.max("seq").alias("last"))
    return history.stage_totals(commits, history.stage_ranges(stages, "grp", last), "grp").withColumn("size", F.round("size", 2))


def coverage_audit(spark, sf_dir):
    wanted = spark.range(25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"))
    return contracts.coverage(wanted, table(spark, sf_dir, "documents"), "source")


def catalog_search(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    reports = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("body"))
    return search.catalog_search(items, ["c_name", "c_mktsegment"], "urgent", reports, "c_custkey").select("c_custkey", "c_name")


def catalog_jobs(spark, sf_dir):
    newest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_job"), F.count("*").alias("n_jobs"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(newest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.date_format("last_job", "yyyy-MM-dd").alias("last_day"), F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"))


def missing_reports(spark, sf_dir):
    """Customers without an order of each kind of status."""
    kinds = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("kind")).distinct()
    wanted = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit("F"), F.lit("O"))).alias("kind"))
    return wanted.join(kinds, ["c_custkey", "kind"], "left_anti")


def eval_recall_precision(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("cls"), (F.size(X.words(F.col("text"))) >= 100).alias("hit"))
    out = rollup.evaluation(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id"))
    return out.withColumn("recall", F.round("recall", 6)).withColumn("precision", F.round("precision", 6))


def module_distribution(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        exact_fingerprint, file_identity_or, common_file_breadth, name_recall, rare_string_hits, pair_upsert, token_idf, shingles_4,
        simhash_fingerprint, simhash_neighbors_15, relaxed_band_pool, vector_topk_filtered, pool_topk, baseline_argmax,
        similarity_bins, recall_union_provenance, retrieval_funnel, identity_score, tier_counts, line_alignment_tiers,
        segment_assignment, segment_selection, dominated_suppression, widespread_annotation, baseline_propagation,
        submodule_rollup, undetected, source_metrics_rank, closest_source, exclusive_exclusions, overview_reconcile,
        file_line_coverage, cluster_priority, module_classifier, regex_evidence_scan, html_visible_text, url_identity,
        full_text_search, call_chain, reference_full_outer, large_commit_threshold, close_large_pairs, stage_ranges,
        coverage_audit, catalog_search, catalog_jobs, missing_reports, eval_recall_precision, module_distribution,
    )
}
