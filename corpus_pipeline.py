"""The training-corpus pipeline: five stages over ``documents``, each written and read again.

toxicity -> SimHash near-dedup -> suffix-array dedup -> source mixing -> packing.  Every
stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and
returns a DataFrame; all but the last return the columns of ``documents``, with ``n_chars``
kept in step with ``text``.

Null, empty, long and repeated texts, null ids and sources, extra columns and empty tables
are handled as the docstring of each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import mixing, packing, simhash, suffix, toxicity
from canopy.llm.common import materialise, table


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; all of them if the labels give no evidence."""
    learn = toxicity.remainder(F.col("doc_id"), 5) != 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", learn)
    return docs.filter(~toxicity.toxic(toxicity.scorer(spark, model)(F.col("text").cast("string"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component, the one with the smallest id."""
    return simhash.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that documents with smaller ids have too."""
    return _counted(suffix.dedup_documents(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each document and pass over its source."""
    return _counted(mixing.mixed_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences of at most 2048 ids, a document in each, with their ids."""
    return packing.pack(docs, packing.public_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: A learned classifier, fingerprints and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
