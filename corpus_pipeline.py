"""The corpus pipeline: five stages of isohyet.llm, each on what its predecessor kept.

In every stage an empty table gives an empty one, a null id is an id like any other (the last in order), repeated rows are rows of their own unless the stage is about
repeats, very long texts are handled whole, and extra columns are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isohyet.llm.common import release, written
from isohyet.llm.entropy_mix import mixed_documents
from isohyet.llm.golay import one_of_each
from isohyet.llm.hd_langid import known_language
from isohyet.llm.line_chunks import deduplicated_lines
from isohyet.llm.slack_packing import slack_packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null, empty and letterless texts, and those that are like no learned language. Of languages that are equally near the first by code point
    counts; that decides nothing here."""
    return known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines, and runs of lines of over 50 words, that an earlier document has are cut out of the later ones (earlier: smaller id, then the text's hash). Null texts stay null, and a document
    that loses all its lines stays with an empty text; rows equal in id and text keep the same."""
    return deduplicated_lines(docs, run_words=50)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id, then the text's hash. Null and empty texts are one group; of repeated rows one stays."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; those without words not at all. Rows that share an id share its copies evenly, in the order of their texts' hashes."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. A null or empty text is one piece, the end id; equal lengths are placed in the order of their hashes."""
    return slack_packing(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("packing", packing)]

#: Neither rolling hashes, SimHash, tilted rates nor tokenizers can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
            release(before)
    return docs
