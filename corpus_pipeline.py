"""The corpus pipeline: language ID, near-dedup, substring dedup, mixing, and SentencePiece encoding of the mix.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and returns a DataFrame; all
but the last return the columns of documents. run() writes each stage's result as Parquet in the shared folder and reads
it again for the next.

Defined results, of all stages: a null text is an empty one (the first stage rejects both, as they have no letters); a null
source is a source of its own; rows without doc_id are judged by their text and are never the smaller row; repeated rows
are one after the second stage; ties go to the smaller doc_id, then by a hash of the row; an empty table gives an empty
result; columns beside those of documents are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolk.llm import language_viterbi, mix_pareto, near_copies, sentencepiece_nbest, substring_doubling
from kinfolk.runtime import scratch, sized_join, stored

#: A document is rejected if no language has this share of its letters, or it has no letters. Short documents with a licence
#: line or a quotation in another language stay.
MIN_LANGUAGE_SHARE = 0.3


#: The columns that stages look at; all others are carried along in one, so that no name of theirs can meet a stage's own.
OWN, CARRIED = ("doc_id", "text", "lang", "source", "n_chars"), "_carried"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carrying(stage: Stage) -> Stage:
    """The stage, with columns beside OWN set aside while it runs."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        more = [c for c in docs.columns if c not in OWN]
        if not more:
            return stage(spark, docs, sf_dir)
        packed = docs.select(*(c for c in docs.columns if c in OWN), F.struct(*(F.col(f"`{c}`") for c in more)).alias(CARRIED))
        out = stage(spark, packed, sf_dir)
        return out.select(*(F.col(c) if c in OWN else F.col(f"{CARRIED}.`{c}`") for c in docs.columns)) if CARRIED in out.columns else out

    return run_stage


@carrying
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letters, or a mixture without a main language. (operator 6)"""
    model = language_viterbi.learn(language_viterbi.training_rows(docs))
    named = language_viterbi.annotate(docs, model, "_pred", "_score")
    return named.filter((F.col("_pred") != "und") & (F.col("_score") >= MIN_LANGUAGE_SHARE)).select(*docs.columns)


@carrying
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows like a smaller row: SimHash of five-word shingles in covering tables, then an exact Jaccard similarity of
    0.8 or more. (operator 3, with a fingerprint and tables for that similarity)"""
    return near_copies.without_near_copies(docs)


@carrying
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the passages that also start in a document with a smaller doc_id; all documents stay. (operator 7)

    Only narrow keys meet the texts that stay as they are; the texts that change come from the operator.
    """
    with scratch(spark):
        cut = substring_doubling.remove_repeats(docs, keep_text=True).filter("n_removed > 0")
        cut = cut.select("doc_id", F.col("tkey").alias("_tkey"), F.coalesce("left_text", F.lit("")).alias("_left")).dropDuplicates(["doc_id", "_tkey"])
        cut = stored(cut, "cut", outlives=True)
        changes = stored(cut.select("doc_id", "_tkey"), "cut_keys", outlives=True)  # apart from the texts, so that its bytes show how narrow it is
    keyed = docs.withColumn("_tkey", F.xxhash64("text"))
    whole = sized_join(keyed, changes, ["doc_id", "_tkey"], "left_anti").select(*docs.columns)
    changed = keyed.drop("text").join(cut, ["doc_id", "_tkey"]).withColumnRenamed("_left", "text")
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(changed.select(*docs.columns))


@carrying
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample documents so that sources meet their target weights; a row per copy. (operator 4)"""
    with scratch(spark):
        plan = stored(mix_pareto.plan_mix(mix_pareto.sized(docs)), "plan", outlives=True)
    rk = mix_pareto.row_key(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text"))
    mixed = mix_pareto.apply_plan(docs, plan, rk, mix_pareto.size_of(F.col("text"))).filter("_mix.n_copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("_mix.n_copies")))
    return mixed.withColumn("_copy", copies).select(*docs.columns)


@carrying
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (best segmentation), score, others (the next best) of every copy, with the number of ids. (operator 2)"""
    return sentencepiece_nbest.encode(docs).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: Ranking values, fingerprints and lattices are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name, outlives=True)
    return STAGES[-1][1](spark, docs, sf_dir)
