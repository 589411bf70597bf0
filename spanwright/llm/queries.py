"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, fingerprints, langid, mixing, packing, quotes, secrets, simhash, urlrules, warc
from .common import table


def word_bpe() -> str:
    """Where the box keeps the public word-BPE tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of ``conversations``, sent as mail that quotes earlier ones (the table itself holds no quotes)."""
    return quotes.threads(quotes.as_mail(table(spark, sf_dir, "conversations")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op4_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.features(table(spark, sf_dir, "documents"))


def repository():
    """A source's documents of one language are taken for a repository, the source for its owner."""
    return F.concat_ws("/", F.col("source"), F.col("lang"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secrets(table(spark, sf_dir, "documents"), repository=repository()))


# The stated rules.
RULES = [urlrules.Rule("org", "/", False), urlrules.Rule("example.org", "/es/", True), urlrules.Rule("example.org", "/en/1", True), urlrules.Rule("com", "/fr/", False), urlrules.Rule("com", "/de/", True)]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from: pages that the stated rules decide, and of the others those that ``labels`` calls toxic or poor, or neither."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    return urlrules.judge(table(spark, sf_dir, "pages"), RULES, labels)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe())


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written, then fetched by its URL's key through directory and blocks."""
    pages = table(spark, sf_dir, "pages")
    folder, directory = warc.archive(pages)
    return warc.fetch(folder, directory, warc.keys(pages))


QUERIES = {
    "op1_crf_language_id": op1_crf_language_id,
    "op2_quote_threads": op2_quote_threads,
    "op3_mixing": op3_mixing,
    "op4_avi_media": op4_avi_media,
    "op5_secret_scan": op5_secret_scan,
    "op6_url_rules": op6_url_rules,
    "op7_packing": op7_packing,
    "op8_fingerprints": op8_fingerprints,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_warc_index": op10_warc_index,
}

ORACLE_SQL: dict[str, str] = {"op2_quote_threads": quotes.ORACLE, "op3_mixing": mixing.ORACLE, "op5_secret_scan": secrets.ORACLE, "op10_warc_index": warc.ORACLE}
