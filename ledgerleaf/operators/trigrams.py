"""Keyword search over messages by a stored index of trigrams.

Every message has a number; for each three characters in a row of the
lower-cased texts, the numbers of the messages that hold them are stored in
sorted blocks, in folders by a hash of the trigram. A search reads the blocks of
its few rarest trigrams, keeps the numbers that stand under all of them, reads
those messages and looks for the words themselves, so hits are those of a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerleaf.operators.history import keyword_search

FOLDERS, BLOCK_IDS = 64, 4096
#: Trigrams of a query that are looked up at most; the rarest.
RAREST = 4
#: So many numbers are pushed into the scan of the messages; more are joined.
PUSHED = 1000


class Trigrams(NamedTuple):
    messages: DataFrame  # the messages, with _no
    blocks: DataFrame  # folder, gram, nos
    counts: DataFrame  # gram, n


def grams_of(text: Column) -> Column:
    """Distinct trigrams of the lower-cased text; none for null or shorter texts."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(...))"), F.lit(1)))


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (gram, no) -> lists of numbers of one gram each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column("gram").dictionary_encode().indices.to_numpy()
        change = np.flatnonzero(np.diff(code)) + 1
        starts = np.concatenate([np.arange(a, b, BLOCK_IDS) for a, b in zip([0, *change], [*change, len(code)])])
        bounds = pa.array(np.append(starts, len(code)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("gram").take(pa.array(starts)), pa.ListArray.from_arrays(bounds, batch.column("_no"))], ["gram", "nos"])


def store_trigrams(messages: DataFrame, path: str, text: str = "content") -> Trigrams:
    """Writes ``messages`` (any columns) and the index of their texts under ``path`` and opens it."""
    spark = messages.sparkSession
    messages.withColumn("_no", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/messages")
    rows = spark.read.parquet(f"{path}/messages").select("_no", F.explode_outer(grams_of(F.col(text))).alias("gram")).where("gram IS NOT NULL")
    # Range partitions: a trigram that most messages hold is spread over tasks.
    ordered = rows.withColumn("folder", _folder(F.col("gram"))).repartitionByRange("folder", "gram", "_no").sortWithinPartitions("folder", "gram", "_no")
    blocks = ordered.select("gram", "_no").mapInArrow(_to_blocks, "gram string, nos array<long>").withColumn("folder", _folder(F.col("gram")))
    blocks.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/blocks")
    _read_blocks(spark, path).groupBy("gram").agg(F.sum(F.size("nos")).alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
    return open_trigrams(spark, path)


def _read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram string, nos array<long>, folder int").parquet(f"{path}/blocks")


def open_trigrams(spark: SparkSession, path: str) -> Trigrams:
    """An index that ``store_trigrams`` wrote."""
    return Trigrams(
        spark.read.parquet(f"{path}/messages"), _read_blocks(spark, path),
        spark.read.schema("gram string, n long").parquet(f"{path}/counts"),
    )


def candidates(index: Trigrams, query: str) -> DataFrame:
    """The messages that hold the rarest trigrams of ``query``; all of them if it has none."""
    lowered = query.lower()
    grams = sorted({lowered[i:i + 3] for i in range(len(lowered) - 2)})
    if not grams:
        return index.messages.drop("_no")
    known = index.counts.where(F.col("gram").isin(grams)).orderBy("n", "gram").collect()  # no more than the query has
    if len(known) < len(grams):
        return index.messages.drop("_no").limit(0)
    rare = [r["gram"] for r in known[:RAREST]]
    folders = [r[0] for r in index.messages.sparkSession.createDataFrame([(g,) for g in rare], "gram string").select(_folder(F.col("gram"))).distinct().collect()]
    listed = index.blocks.where(F.col("folder").isin(folders) & F.col("gram").isin(rare)).select(F.explode("nos").alias("_no"))
    met = listed.groupBy("_no").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == len(rare)).select("_no")
    few = [r["_no"] for r in met.limit(PUSHED + 1).collect()]
    if len(few) <= PUSHED:
        return index.messages.where(F.col("_no").isin(few)).drop("_no")
    return index.messages.join(met, "_no", "left_semi").drop("_no")


def indexed_search(index: Trigrams, requester: object, query: str, **filters) -> DataFrame:
    """``keyword_search`` with the same arguments and hits, over the candidates of the index."""
    return keyword_search(candidates(index, query), requester, query, **filters)
