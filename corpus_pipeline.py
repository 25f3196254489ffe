"""From documents to packed sequences: language, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs; all but the last return the columns of documents.  Tables without rows give tables without rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import common, langid, packing, quality, radix, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that a language can be told of; null texts and those without a letter go.

    Where no language can be learned, documents with a letter stay.
    """
    common.release(spark)
    model = langid.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # rows travel as one struct, so that no column of theirs meets a name of ours
    told = langid.predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return told.where(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base rule and the cutoffs chosen on the labelled ones among them."""
    common.release(spark)
    return quality.keep_good(docs, common.read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near duplicates (five-word shingles, Jaccard similarity 0.8 or more) the document with the least id."""
    common.release(spark)
    return simhash.keep_one(docs, similarity=0.8, shingle=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out each passage of 50 words or more that stands at an earlier place too; documents stay, with what is left of their texts."""
    common.release(spark)
    return radix.remove_from(docs, depth=50, words=True, keep_first=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: the pieces of all documents and their places."""
    common.release(spark)
    return packing.best_fit(docs.select("doc_id", "text"))


STAGES = [("language", language), ("quality", rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("packing", packed)]

#: Learned languages, exact binomial cutoffs, XXH64 fingerprints and token ids have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of ``documents``; what lies between two stages is dropped when the next is written."""
    docs, before = common.read(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        path = f"{common.shared_dir(spark)}/loomgrid-stage-{uuid.uuid4().hex}"
        out.write.parquet(path)
        common.drop_on_exit(spark, path)
        if before:
            common.drop(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
