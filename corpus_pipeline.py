"""The corpus pipeline: documents to training tokens in five stages.

Each stage reads what its predecessor kept, written as Parquet in between, and returns
documents with all their columns; the last returns one row per document of the token
files it wrote.

1. language ID: documents without a recognised language go;
2. n-gram Jaccard join: of documents linked by near-equal text the one with the smallest
   doc_id stays;
3. benchmark decontamination: benchmark passages are cut out of the texts, and documents
   that are half benchmark or more go;
4. mixing: sources in the target weights, documents repeated up to three times, in part
   where a source's words end;
5. token output: ids in directly addressable segments, read back.

Null, empty and repeated rows, extra columns and empty tables are handled as the
operators' modules state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerflow.llm import dac_tokens, decontaminate, language_id, ngram_join, source_mix
from ledgerflow.llm.common import ship, stored, table


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the string-kernel classifier recognises."""
    ship(spark)
    return language_id.keep_known(docs, language_id.train(language_id.labelled(docs)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by near-equal shingle sets."""
    ship(spark)
    return ngram_join.keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    ship(spark)
    return decontaminate.remove_hits(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources in the target weights."""
    ship(spark)
    return source_mix.mix_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids on file: doc_id, start, n_tokens and ids_crc32 of each document."""
    ship(spark)
    return dac_tokens.token_output(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", known_languages),
    ("ngram_join", one_of_each),
    ("decontamination", without_benchmark),
    ("source_mix", mixed_sources),
    ("token_output", token_files),
]

#: The language model is fitted numerically, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
