"""The corpus pipeline: five stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthline.llm import decontaminate, jaccard, mixing, tokens, toxicity
from hearthline.llm._common import table, written

ORACLE_SQL = None  # a trained model decides in the first stage


# All stages take any columns beside doc_id, text and source, of whatever names, and leave them as they are; an empty table gives
# no rows. Texts are taken whole, however long.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go. Null and empty texts, null and repeated doc_ids are scored like all rows; equal
    texts fare alike."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays, and of rows equal in doc_id and text one. Texts without words are no
    copies of each other; rows with a null doc_id stay."""
    return jaccard.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go. Null and empty texts and null doc_ids stay; rows of one doc_id go together."""
    return decontaminate.without(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; what it takes 0 times goes. Null and empty texts have size 0, a null
    source is one of its own, and of equal rows as many are taken as fit."""
    return mixing.resample(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and file of each document in the token files. A null or empty text has the end id alone;
    null doc_ids come first, and equal ones are documents of their own."""
    return tokens.encode_to_files(docs)


STAGES = [("toxicity", drop_toxic), ("jaccard", drop_near_copies), ("decontaminate", drop_benchmark), ("mixing", mix_sources), ("tokens", to_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
