"""The corpus pipeline: each stage takes what its predecessor kept; all but the last return the columns of documents.

Defined results: further columns, whatever their names, stay up to the last stage; an empty table
gives an empty result; long texts are worked on whole. The stages say what becomes of the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanwright.llm import langid, mixing, packing, secrets, simhash
from spanwright.llm.common import settle, table
from spanwright.llm.queries import repository, word_bpe


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language fits go: null and empty texts, those without letters, and those in an unknown script. A missing language is filled in, a given one stays; repeated rows stay."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, one row of it if it repeats; rows without a doc_id can't be told apart and stay."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are masked in place; every row stays, null texts as they are. A null source is an owner of its own."""
    return secrets.redact(docs, repository=repository())


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them; rows that share a doc_id, or have none, share a hash and are taken alike. Null is a source of its own."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 2048 tokens; each row is packed as often as it comes, a null text as its end token."""
    return packing.pack(docs, word_bpe())


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("secret scans", secret_scan), ("mixing to target weights", mixture), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, "stage")
    return docs


#: Shingle hashes, the language model and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
