"""Corpus pipeline: toxicity, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes as Parquet and reads again for the next
stage. All but the last return the columns of documents (doc_id, text, lang, source, n_chars), whatever else the input has.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pipegrid.llm import exactdup, neardup, packing, pii, toxic
from pipegrid.llm.common import shared_folder, table
from pipegrid.session import ship

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.7) -> DataFrame:
    """Documents whose toxicity score is under least."""
    ship(spark)
    model = toxic.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxic.keep_clean(docs.select(*_COLUMNS), model, least)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates; rows without a doc_id stay."""
    ship(spark)
    found = neardup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rows = docs.select(*_COLUMNS)
    return rows.join(found, "doc_id", "left_semi").unionByName(rows.where("doc_id is null")).select(*_COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of a smaller doc_id has; characters cut in part go as a whole."""
    ship(spark)
    return exactdup.without_repeats(docs.select(*_COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind in angle brackets."""
    ship(spark)
    return pii.mask(docs.select(*_COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens, and their ids."""
    ship(spark)
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL has neither the tokenizer nor the trained models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir; every stage's rows go through Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
