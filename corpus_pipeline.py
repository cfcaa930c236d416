"""A corpus from raw documents: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``, also
those with names that a stage uses itself. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import frames, line_rules, minhash, mixing, packing, pii


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` as (text, own): its other columns in one, so that none clashes with what a stage makes."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("own"))


def _together(made: DataFrame, text: str, like: DataFrame) -> DataFrame:
    """The columns of ``like`` again, with ``text`` as its text and ``n_chars`` brought up to date."""

    def column(c: str) -> Column:
        if c == "text":
            return F.col(text).alias(c)
        return (F.length(text).cast(like.schema[c].dataType) if c == "n_chars" else F.col("own").getField(c)).alias(c)

    return made.select(*[column(c) for c in like.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bad lines are cut out; documents that are rejected go. Null and empty texts are rejected; repeated rows are judged each."""
    return _together(line_rules.clean_lines(_apart(docs)).where("kept"), "cleaned", docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; rows without words or id stay."""
    return minhash.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind. Null texts stay null; no row goes."""
    return _together(pii.redact(pii.find_pii(_apart(docs))), "text", docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn towards the target weights of sources, languages and topics; nulls there are a value of their own."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048; null and empty texts are one end token."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing_weights), ("packing", pack)]

#: Several stages (drawn minima, raked weights, a tokenizer) are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again by the next."""
    scratch = frames.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.write(docs)
    return docs
