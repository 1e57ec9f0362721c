"""Training corpus from documents: language, near duplicates, repeated passages, mix, sequences.

Stages run in order; each reads what its predecessor wrote as Parquet and returns the
columns of documents, the last one the packed pieces.  Nulls, empty tables and further
columns are as the operators define them: a document without text or letters goes in the
first stage; a class of near duplicates keeps its least doc_id; a document of which an
earlier one holds every word goes; the mix repeats documents up to three times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import debruijn, language, minhash, mixing, packing
from logtide.llm.registry import tokenizer_path
from logtide.llm.scratch import written

#: Mean code length, in bits a byte, above which no learned language is spoken: bytes at random need about 8.
MOST_BITS = 6.0


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a learned language codes; the models learn from the labelled ones among them."""
    judged = language.identify(docs, language.train(docs))
    return judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("bits_per_byte") <= MOST_BITS)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least doc_id."""
    return minhash.one_of_each(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages of earlier ones; untouched texts stay byte by byte."""
    found = debruijn.without_repeats(docs)
    cut = F.col("n_removed") > 0
    columns = {"text": F.when(cut, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return found.where(~cut | (F.col("n_removed") < F.col("n_words"))).select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document may come up to three times."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 token ids, placed in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", known_language), ("near duplicates", one_of_each), ("repeated passages", without_passages), ("mix", mixed), ("pack", packed)]

#: Signatures, trained models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
