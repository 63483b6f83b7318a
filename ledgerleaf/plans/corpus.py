"""Turning documents into a searchable, stored corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerleaf.functions.vectors import Embedder, embed
from ledgerleaf.operators.bm25 import index_terms
from ledgerleaf.operators.chunking import chunk_text
from ledgerleaf.session import scratch_path


def spread(df: DataFrame) -> DataFrame:
    """Use every core on inputs with fewer splits than cores; larger inputs stay unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def build_corpus(
    docs: DataFrame, embedder: Embedder | None = None, max_chars: int = 600, overlap: int = 80
) -> DataFrame:
    """Documents with metadata -> chunks with vectors and word counts.

    ``docs`` has ``doc_id``, ``text`` and any metadata columns, which are kept.
    Everything is row-local: no shuffle from the source to the sink.
    """
    keep = tuple(c for c in docs.columns if c != "text")
    docs = spread(docs)
    chunks = chunk_text(docs, max_chars, overlap, keep=keep).withColumnRenamed("text", "content")
    chunks = chunks.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit(":c"), F.col("idx")))
    return embed(index_terms(chunks), embedder, text="content")


def store_corpus(corpus: DataFrame, path: str) -> DataFrame:
    """Write once, read many: a search reads only the columns its routes need."""
    corpus.write.mode("overwrite").parquet(path)
    return corpus.sparkSession.read.parquet(path)


_STORED: dict[tuple[str, str], str] = {}


def stored_once(spark: SparkSession, key: str, make) -> DataFrame:
    """The corpus under ``key``, written to the shared folder at first use in this application."""
    at = (spark.sparkContext.applicationId, key)
    if at not in _STORED:
        path = scratch_path(spark, "corpus")
        make().write.parquet(path)
        _STORED[at] = path
    return spark.read.parquet(_STORED[at])
