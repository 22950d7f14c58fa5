"""From raw documents to packed training sequences, stage by stage.

Every stage reads what its predecessor wrote and works on all of it.  An empty table stays
empty through all stages; null texts count as empty, and a document without words is scored
like any other, is its own group of near copies, and is never taken by the mix.  Ids may be
null or stand in several rows; columns beside those of documents pass through up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from addrgraph.llm.common import read, written
from addrgraph.llm.dedup import drop_exact_copies
from addrgraph.llm.mixing import mixed_documents
from addrgraph.llm.packing import pack_documents
from addrgraph.llm.quality import held_out, score, train
from addrgraph.llm.shingles import keep_one_of_each_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more (all, if no label differs)."""
    labels = read(spark, sf_dir, "labels")
    return score(docs, train(docs, labels.where(~held_out(labels["doc_id"])))).where("score >= 0.5").select("doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the largest id, of rows that repeat it one."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles the one with the smallest id, null ids last; rows are
    told apart by id and text, so another text under a dropped document's id stays."""
    return keep_one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as far as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: Scores, links and draws have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
