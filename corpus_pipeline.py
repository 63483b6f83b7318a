"""Training-corpus pipeline: quality rules, line dedup, near duplicates, source mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and reads it back as the next stage's documents.
All stages but the last return the columns of ``documents``; more columns, of any
name, are carried along. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerleaf.llm import bpe, jaccard, lines, mixing, quality
from ledgerleaf.llm.common import stored
from ledgerleaf.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null or empty text has no words and goes; null ids and sources do not
    matter; repeated rows are judged alike.
    """
    return quality.keep_good(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines of any length; those left without a word go. ``n_chars`` follows the text.

    A null source is a site of its own; a line stays in the document with the
    smallest id (null last) and the smallest position; rows equal in id and text
    lose the same lines.
    """
    cleaned = lines.drop_boilerplate(docs, min_words=1).withColumn("n_chars", F.length("text").cast("long"))
    return cleaned.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with the smallest id.

    Null ids come last; of rows equal in id and text one stays; of an id with
    several similar texts, that with the smallest digest.
    """
    return jaccard.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A null source is a source of its own; ties of the draw go by a digest of id
    and text, so reruns agree.
    """
    return mixing.draw(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with its id and source; one row per row, nulls handed through."""
    return bpe.encode(docs, tokenizer_path(), keep=("doc_id", "source"))


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_boilerplate),
    ("near duplicates", drop_near_duplicates),
    ("source mix", mix_sources),
    ("encoding", encode),
]

#: Encoding cannot be expressed in SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: doc_id, source, n_tokens, ids of every document taken, as often as it is taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict = {}
