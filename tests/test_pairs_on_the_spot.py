"""Pairs of documents are used where they meet: plans that write or shuffle a row per pair fail here."""

import pytest
from pyspark.sql import functions as F

from kinfolk.operators import baseline, lines, rollup, segment_verification
from kinfolk.plans import evidence_queries, queries, verdict_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def above_the_pairs(df):
    """The nodes of the plan from the top to the join that makes the pairs."""
    nodes = plan(df)
    at = [k for k, x in enumerate(nodes) if "Join" in x and "q_block" in x]
    assert at, nodes
    return nodes[: at[0]]


def pairs_are_shuffled(df):
    return any("Exchange" in x for x in above_the_pairs(df))


def reduced_first(df):
    """Whether hash aggregates make few rows of the pairs before the first exchange, and no sort comes before."""
    nodes = above_the_pairs(df)
    lowest = max(k for k, x in enumerate(nodes) if "Exchange" in x)
    return "HashAggregate" in nodes[lowest + 1] and not any("Sort" in x for x in nodes[lowest:])


@pytest.fixture
def folder(spark, tmp_path):
    """Documents that share one line with all others, in two sources, two languages and some copies."""
    rows = [(k, f"a line that all have\nown line number {k % 55}", f"src{k % 3}", "en" if k % 5 else "fr", 10) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a line that all have")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.fixture
def kept(monkeypatch):
    """Plans of what rollup stores."""
    out = {}
    monkeypatch.setattr(rollup, "stored", lambda df, label: (out.setdefault(label, df), lines.stored(df, label))[1])
    monkeypatch.setattr(queries, "stored", rollup.stored)
    return out


def test_links_in_blocks(spark, folder, monkeypatch):
    want = sorted(lines.line_links(spark.read.parquet(f"{folder}/documents.parquet"), F.lit(True)).collect())
    monkeypatch.setattr(lines, "BLOCK", 7)
    monkeypatch.setattr(lines, "MEETINGS", 100)
    links = lines.document_links(spark.read.parquet(f"{folder}/documents.parquet"), F.lit(True))
    assert links.parts >= 60 * 60 / 100 and sorted(links.pairs().collect()) == want and len(want) > 3000
    more = spark.createDataFrame([(k, str(k)) for k in range(0, 60, 2)], "id long, told string")
    got = links.pairs(more.select(F.col("id").alias("q_id"), F.col("told").alias("q_told")), more.select(F.col("id").alias("c_id"), F.col("told").alias("c_told"))).collect()
    assert len(got) == len(want) and all(r.q_told == (None if r.q_id % 2 else str(r.q_id)) and r.c_told == (None if r.c_id % 2 else str(r.c_id)) for r in got)
    assert not pairs_are_shuffled(links.pairs())


def test_source_metrics_reduce_pairs_first(spark, folder, kept):
    assert queries.source_metrics_rank(spark, folder).count() == 3
    assert reduced_first(kept["best_of_sources"])


def test_closest_source_reduces_pairs_first(spark, folder, kept):
    assert queries.closest_source(spark, folder).count() == 1
    assert reduced_first(kept["best_of_sources"])


def test_exclusions_reduce_pairs_first(spark, folder, kept):
    queries.exclusive_exclusions(spark, folder).collect()
    assert reduced_first(kept["kinds"]) and [k for k in kept if k in ("first_reasons", "included")] == ["first_reasons", "included"]


def test_segment_selection_shuffles_no_pairs(spark, folder, kept):
    assert not pairs_are_shuffled(queries.segment_selection(spark, folder)) and reduced_first(kept["content_ranks"])


def test_dominated_suppression_shuffles_no_pairs(spark, folder, kept):
    assert not pairs_are_shuffled(queries.dominated_suppression(spark, folder)) and reduced_first(kept["best"])


def test_baseline_propagation_shuffles_no_pairs(spark, folder, kept):
    out = queries.baseline_propagation(spark, folder)
    assert not pairs_are_shuffled(out) and reduced_first(kept["baseline_flags"]) and out.filter("baseline").count() == out.count()


def test_known_contents_shuffle_no_pairs(spark, folder):
    assert not pairs_are_shuffled(verdict_queries.known_contents(spark, folder))


def test_review_admission_shuffles_no_pairs(spark, folder, monkeypatch):
    kept = {}
    monkeypatch.setattr(verdict_queries, "stored", lambda df, label: (kept.setdefault(label, df), lines.stored(df, label))[1])
    assert not pairs_are_shuffled(verdict_queries.review_admission(spark, folder)) and reduced_first(kept["states"])


def general(spark, folder):
    """The same pairs through the operator for any pairs."""
    none = F.lit(None).cast("double")
    pairs = queries.pairs_of(spark, folder).select("q_id", "c_id", "tier", (F.col("line_sim") == 1).alias("fingerprint"), "line_sim", F.col("hits").alias("matched"), none.alias("identity"), none.alias("vector_sim"))
    sources = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("id"), F.lit("text").alias("lang"), F.col("text").alias("code"))
    return segment_verification.verify_segments(pairs, sources)


def test_segment_verification_shuffles_no_pairs(spark, folder):
    out = evidence_queries.segment_verification_rows(spark, folder)
    assert not pairs_are_shuffled(out)
    columns = ["q_id", "c_id", "state", "seg_hits", "q_total", "c_total", "tier_before", "tier", F.round("score", 4).alias("score")]
    got, want = (sorted(map(str, df.select(*columns).collect())) for df in (out, general(spark, folder)))
    assert got == want and len(got) > 3000


def test_segment_totals_shuffle_no_pairs(spark, folder):
    out = evidence_queries.segment_totals(spark, folder)
    want = segment_verification.summary(general(spark, folder)).select("eligible", "verified", "deferred")
    assert reduced_first(out) and out.collect() == want.collect()


def with_baselines(spark, folder):
    """The folder's documents and texts of twelve words that a baseline has whole, linked or not."""
    long = " ".join(f"word{k}" for k in range(14))
    rows = [(100, f"a line that all have\n{long}", "src1"), (101, f"a line that all have\n{long}", "src2"), (102, long, "src0"), (103, f"{long} and more", "src1"), (104, long, "src4"), (105, f"own start\n{long}", "src1"), (106, f"{long}\n{long}", "src5")]
    more = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(9).cast("long"))
    spark.read.parquet(f"{folder}/documents.parquet").unionByName(more).write.parquet(f"{folder}/more/documents.parquet")
    return f"{folder}/more"


def subtracted_pairs(spark, folder):
    """The same pairs through the operators for any pairs."""
    docs, base = spark.read.parquet(f"{folder}/documents.parquet"), F.col("source").isin("src0", "src1")
    covers = baseline.covered_queries(docs.filter(~base).select(F.col("doc_id").alias("q_id"), "text"), docs.filter(base).select(F.col("doc_id").alias("c_id"), "text"))
    p = queries.pairs_of(spark, folder).filter("q_source not in ('src0', 'src1')")
    p = p.select("q_id", "c_id", "tier", "line_sim", F.col("hits").alias("matched"), (F.col("line_sim") == 1).alias("fingerprint"), F.col("c_source").isin("src0", "src1").alias("is_baseline"))
    p = p.join(covers.withColumn("covers", F.lit(True)), ["q_id", "c_id"], "full_outer").fillna(False, ["covers"]).fillna(True, ["is_baseline"])
    return baseline.subtract_baselines(p)


def test_baseline_subtraction_shuffles_no_pairs(spark, folder):
    folder = with_baselines(spark, folder)
    out, want = evidence_queries.baseline_subtraction(spark, folder), subtracted_pairs(spark, folder)
    assert not pairs_are_shuffled(out)
    assert sorted(map(str, out.collect())) == sorted(map(str, want.select(*out.columns).collect()))
    assert {r.baseline_state for r in out.select("baseline_state").distinct().collect()} >= {"explains", "touches", "excluded", "none"}


def test_baseline_recheck_shuffles_no_pairs(spark, folder):
    folder = with_baselines(spark, folder)
    out, gone = evidence_queries.baseline_recheck(spark, folder), spark.read.parquet(f"{folder}/documents.parquet").filter("source = 'src1'").select(F.col("doc_id").alias("c_id"), F.lit(True).alias("gone"))
    rows = subtracted_pairs(spark, folder).join(gone, "c_id", "left").withColumn("covers", F.col("covers") & F.col("gone").isNull())
    assert not pairs_are_shuffled(out)
    assert sorted(map(str, out.collect())) == sorted(map(str, baseline.restore_unproven(rows).select(*out.columns).collect()))
