"""The corpus pipeline: language ID, quality rules, one document of each group of similar ones, benchmark
decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of `docs`, and its decisions take effect at
once. All but the last return the columns that `docs` has. Rows share a decision if they share a doc_id; rows
without a doc_id are judged together with each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweir.llm import best_fit, decontaminate, language_id, ngram_join, perplexity
from feedweir.llm.common import few, materialize, table


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is not in `ids` (column doc_id); a null counts as an id."""
    gone = few(materialize(ids.select(F.col("doc_id").alias("_gone")).distinct(), "gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    records = docs.select("doc_id", "text", F.col("lang").alias("markup"), F.col("source").alias("host"))
    judged = language_id.identify(records, *language_id.train(docs))
    return _without(docs, judged.where(~F.col("kept")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, perplexity.judge(docs).where(~F.col("kept")))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays."""
    linked = ngram_join.similar_components(docs)
    return _without(docs, linked.where("doc_id <> component_id"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), near=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained models decide in the first two stages, so SQL can't express the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
