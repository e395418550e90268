"""The corpus pipeline: language, near-duplicates, repeated passages, mixture, token ids.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns
the columns of documents; the last returns the encoded corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, langid, mixing, queries, simhash, suffix_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language is one that the table's labels teach, well enough supported; the prediction fills a null label."""
    model = langid.fit(docs.where(~langid.held_out()))
    least, least_score = langid.bounds(docs.where(langid.held_out()), model)
    return langid.accepted(docs, model, least=least, least_score=least_score, lang_col="lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group."""
    return simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that occurred before, and their new lengths; a document of which nothing is left goes."""
    return suffix_dedup.without_repeats(docs).where("text is null or text <> ''").withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents left out or repeated so that the domains have the target shares of as many tokens."""
    return mixing.mix(docs, queries.quality_domains(spark, sf_dir), queries.QUALITY_TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and proof that they decode to its text."""
    ranks, pattern = queries.byte_ranks()
    decoded = byte_bpe.decode(byte_bpe.encode(docs, ranks, pattern), ranks, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("tokens", tokens)]
#: SQL can state neither the classifiers nor the encoder; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            folder = queries.shared_folder(spark, f"pipeline-{name}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
