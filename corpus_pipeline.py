"""A training corpus from documents: quality rules, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of docs, with their decisions applied; the last returns the packed pieces. Further columns of docs pass through all
stages but the last, whatever their names. Empty tables give empty results at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.llm.common import stored
from siftworks.llm.decontaminate import without_contaminated
from siftworks.llm.lines import without_repeated_lines
from siftworks.llm.minhash import without_near_duplicates
from siftworks.llm.packing import pack_documents
from siftworks.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the proved cutoffs keep.

    Null, empty and short texts go, as they have fewer than 20 words. A null lang is a language of its own. A null
    doc_id has no label but is judged. Rows that repeat are judged alike, each once; a value at a cutoff stays. Very
    long texts are measured whole."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; n_chars follows the text.

    Of equal runs the one of smallest doc_id stays, in one document the first. Null texts stay null, empty ones empty,
    and rows with a null doc_id as they are. Rows that repeat doc_id and text are one document, each gets its result;
    with different texts they are documents of their own. A document that loses all its words goes."""
    kept = without_repeated_lines(docs)
    return kept.select(*[F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in kept.dtypes])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-duplicates (five words, similarity 0.8).

    Texts without words and rows with a null doc_id stay. Rows that share a doc_id are one document; of rows that repeat
    doc_id and text one stays."""
    return without_near_duplicates(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (similarity 0.8 or more to an item).

    Null and empty texts and items match nothing. Rows that share a doc_id go together; so do rows with a null doc_id."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048.

    A null or empty text is one piece of its closing id; longer texts are cut. Rows are packed each by itself, so a
    repeated or null doc_id gives pieces of its own. Other columns don't come out."""
    return pack_documents(docs, capacity=2048)


STAGES = [("quality", quality_rules), ("lines", line_dedup), ("near_duplicates", near_dedup), ("benchmark", decontaminate), ("packing", packing)]

#: The stages compare sets, fingerprint windows and pack bins, which SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
