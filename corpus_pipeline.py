"""Corpus pipeline: documents -> quality classifier -> quality rules -> near-duplicates -> packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; `run` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphselect.llm import common
from graphselect.llm.line_crf import apply_rules, fit_rules
from graphselect.llm.packing import pack_documents
from graphselect.llm.quality_knn import fit_quality, score_quality
from graphselect.llm.shingle_sets import one_of_each_close_copy


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it is fitted on labelled ones among docs."""
    model = fit_quality(docs, common.table(spark, sf_dir, "labels"))
    score, predicted = common.fresh_names(docs, "_score", "_predicted")
    return score_quality(docs, model, names=(score, predicted)).where(F.col(predicted) == 1).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are mostly content, and whose counts pass.

    The field is fitted on labelled rows of the whole table, since the stage
    before has taken most of the rejected ones away.
    """
    field = fit_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    prefix = "_rules_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return apply_rules(docs, field, prefix=prefix).where(F.col(prefix + "kept")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Near-duplicates are documents whose five-word shingles have a similarity of
    0.8 or more, and those that a chain of such pairs connects. The tiled
    comparison of SimHashes proposes most pairs, prefixes of the sets the rest.
    """
    return one_of_each_close_copy(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of up to 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("simhash_near_dedup", near_duplicates), ("packing", packing)]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; tables of stages that nothing reads any more are removed."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
