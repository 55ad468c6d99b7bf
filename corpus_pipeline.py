"""The corpus pipeline: classify, drop copies and near copies, mix, tokenise.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame.  ``run`` writes each result as Parquet in the shared
folder and hands the written table to the next stage.  All stages but the last
return the columns of ``documents``; each works on every row that the one
before it kept.  Empty tables pass through all stages.
"""

from __future__ import annotations

from claimwise.llm import exact_dedup, minhash_dedup, mixing, quality, sentencepiece_bpe
from claimwise.llm.common import read, written
from pyspark.sql import DataFrame, SparkSession


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the classifier rejects go."""
    return quality.keep_clean(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each near-duplicate group the smallest doc_id stays."""
    return minhash_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: a document is there as often as the mix takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: ids and the text decoded from them, by digest."""
    return sentencepiece_bpe.encode_documents(docs, sentencepiece_bpe.default_model())


STAGES = [("quality classifier", quality_filter), ("exact dedup", exact), ("MinHash near-dedup", near),
          ("mixing sources", mix), ("SentencePiece encoding", tokens)]

# Classifier and tokeniser are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
