"""From raw documents to packed training sequences, in five stages.

Each stage gets the session, the documents that the stage before it kept, and the data folder, and
returns documents (the last one: pieces of documents in bins). ``run`` writes each stage's result as
Parquet to shared storage and hands the written table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import language, mixing, near_dedup, packing, quality
from brindle.llm.sizes import measured
from brindle.session import materialize, read_table, release, scratch

#: A language whose probability is below this counts as not recognized.
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognizable language.

    These are texts that are null, empty or without letters, and those whose best language scores less than
    ``LEAST_LANGUAGE_SCORE``; if no document has a language to learn from, all go. Rows are judged one by
    one, so repeated rows share their fate; a text of any length is read whole.
    """
    lang, score = language.language_of(F.col("text"), language.train(docs))
    return docs.filter((lang != "und") & (score >= LEAST_LANGUAGE_SCORE))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier predicts to be bad, at a score below 0.5.

    Null and empty texts are scored like others. If no trusted positive is left to learn from, all texts
    have 0.5 and stay. A null doc_id is never a label; rows are judged one by one.
    """
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return docs.filter(quality.quality_scorer(model)(F.col("text")) >= 0.5)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the least doc_id.

    Rows that repeat the doc_id and text of the one kept are dropped with it. A group without any
    doc_id keeps its rows, which nothing can tell apart.
    """
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples whole documents so that the sources have their target weights.

    A null source is a source of its own; a document without words is not in the mix; rows without a
    doc_id are told apart by their texts, and equal rows are taken alike; no documents give none.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences.

    A document's duplicate cluster is the component that the third stage found, which is the id of the one
    document that it kept of each, or without one a hash of the words. Repeats are cut and placed whole by
    whole; a document without words, of which the mix has none, would have a piece without a bin; a null
    source is a source of its own; no documents give no pieces.
    """
    sizes = measured(docs).withColumn("cluster", F.coalesce("doc_id", "cluster"))
    return packing.best_fit(materialize(sizes, "sizes"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("minhash_near_dedup", remove_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Language, quality and packing can't be stated in SQL; a test repeats the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as keep:
            done = keep(materialize(stage(spark, docs, sf_dir), name))
        release(docs)
        docs = done
    return docs
