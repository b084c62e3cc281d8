"""A pipeline over ``documents``: five stages, each on all that the one before it kept.

Each stage is (name, function of (spark, docs, sf_dir)); all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, ftrl, near_dedup, packing, quality_rules
from palimpsest.llm.queries import TOKENIZER
from palimpsest.llm.runtime import dropped, free_name, marked, stored, tidy


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts go, as all under 20 words; very long ones are judged whole; repeated
    rows alike; an empty table stays empty; other columns pass."""
    crf = quality_rules.train_lines(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality_rules.filter_rules(docs, crf)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more. It learns from the labelled rows of the whole table: those that the
    rules rejected are examples too. Null and empty texts have a score of their own; very long ones are scored whole; a score of just 0.3
    stays; repeated rows are scored alike; an empty table stays empty; other columns pass."""
    return ftrl.filter_quality(docs, _table(spark, sf_dir, "labels"), source=_table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id. Of repeated rows (equal id and text) one
    stays, any; rows without an id all do. Null and empty texts are in no group; very long ones are compared whole; an empty table
    stays empty; other columns pass, whatever their names and types."""
    gone = stored(near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    # rows that neither concerns pass by as they are, so that their texts are not shuffled
    concerned = free_name(docs, "concerned")
    known = marked(docs, "doc_id", gone.unionByName(again).distinct(), concerned)
    rest = known.where(f"{concerned} and doc_id is not null").select(docs.columns).join(gone, "doc_id", "left_anti").select(docs.columns)
    return known.where(f"not {concerned} or doc_id is null").select(docs.columns).unionByName(rest.dropDuplicates(["doc_id", "text"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that they share with the benchmark; those with more than half of them shared go. Null and empty
    texts stay as they are; very long ones are scanned whole; repeated rows are treated alike; an empty table stays empty; other columns pass."""
    return decontamination.remove_overlaps(docs, _table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens: null and empty texts have one token, very long ones many
    pieces, repeated rows pieces each; an empty table gives none. Other columns are not read."""
    return packing.pack(docs, *TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the models' verdicts nor tokens; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the ``documents`` in ``sf_dir``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        # what a stage needed goes with the documents it began with, once its own are written
        before, docs = docs, tidy(lambda stage=stage, docs=docs, name=name: stored(stage(spark, docs, sf_dir), name))()
        if name != STAGES[0][0]:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
