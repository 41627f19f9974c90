"""From raw documents to token ids: five stages, each written as Parquet before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quaymaster.llm import byte_bpe, language_id, minhash, mixing, suffix_repeats
from quaymaster.llm.common import delete, temporary_tables, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAST_LANGUAGE_SCORE = 0.5
PASSAGE_WORDS = 50


def keep_recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; learned from those that name one.

    Texts that are null or have no letter go.
    """
    return language_id.recognised(docs, language_id.fit(docs), LEAST_LANGUAGE_SCORE)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group (five-word shingles, similarity 0.8), and of rows with the same words one."""
    return minhash.one_of_each_group(docs, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 400 bytes that start more than once in what is left; no document goes. ``n_chars`` follows the text.

    Passages of 50 words that several texts have, which may be shorter than that, stay only in the one with the smallest id.
    """
    shorter = suffix_repeats.without_repeats(docs, passage_words=PASSAGE_WORDS)
    length = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return shorter.select(*[length.alias(c) if c == "n_chars" else c for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix takes them, which may be not at all."""
    return mixing.mix(docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256), a row for every repetition."""
    path = public_tokenizers.path(VOCABULARY)
    decoded = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", keep_recognised),
    ("minhash_near_dedup", keep_one_of_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("byte_level_bpe", encode_and_decode),
]

# Naive Bayes, MinHash and BPE have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        # What a stage writes on its way goes when its result is written, and that when the next one's is.
        with temporary_tables(spark) as paths:
            docs = written(stage(spark, docs, sf_dir), name)
            made = paths.pop()
        if last:
            delete(spark, last)
        last = made
    return STAGES[-1][1](spark, docs, sf_dir)
