"""A training corpus from documents: toxicity, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import ngram_join, packing, passages, quality, toxicity
from veilspan.llm._util import discard, fold, free_name, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject. It learns from the labels of three of four folds.

    Null and empty texts have a clean text's score, and null ids no label: they stay. Null labels count as none; without labels of both
    kinds all stay or, where all labels are 1, all go. Repeated rows are judged alike; an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    return docs.where(toxicity.score_column(model) < toxicity.THRESHOLD)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labels of two of three folds.

    Null and empty texts are judged as an empty text, null ids have no label. Null labels count as none; without a trusted document all
    stay. Repeated rows are judged alike; an empty table stays empty.
    """
    net = quality.train(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    return docs.where(quality.score_column(net) >= 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of similar ones; documents without words (null texts too) or without an id all stay.

    Rows that share an id are one document; of them equal texts stay once. An empty table stays empty.
    """
    groups = ngram_join.similar(docs.select("doc_id", "text"))
    gone, twice = free_name(docs, "_gone"), free_name(docs, "_twice")
    copies = groups.where((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias(gone)).distinct()
    # the ids that go grow with the documents: merged at every size, not broadcast while they are few
    kept = docs.join(copies.hint("shuffle_merge"), docs.doc_id == copies[gone], "left_anti")
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias(twice))
    if not shared.limit(1).count():
        return kept
    again = kept.join(shared, kept.doc_id == shared[twice], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(shared, kept.doc_id == shared[twice], "left_anti").unionByName(again)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the document of smallest doc_id that has them and leave the others, as far as that one keeps
    its own.

    A document that is a repeat as a whole goes. Rows without an id or text and empty texts stay; of rows that share an id one keeps its
    place and the others count as the last documents. An empty table stays empty.
    """
    return passages.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or piece of a long one, lies in sequences of the permitted lengths. Null and empty texts take one end mark.

    Repeated rows are packed row by row; an empty table gives an empty result.
    """
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("passages", cut_repeats), ("packing", pack)]

#: Trained classifiers and fuzzy alignment are not SQL; tests/llm/test_pipeline.py holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
        if i:
            discard(before)  # the last stage has written its result too
    return docs
