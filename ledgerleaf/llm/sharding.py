"""Contiguous shards of equal byte size.

Documents are put in order and written in range partitions. A partition's total
moves the start of the next; inside a partition, sizes are summed in order. A
document belongs to the shard in whose share of all bytes its middle falls, so
shards are contiguous and differ by no more than one document's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerleaf.llm.common import stored


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus 1 for its end; null has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def prefix_sums(ordered: DataFrame) -> DataFrame:
    """Rows with ``part``, ``place`` and ``size`` -> the same with ``before`` and ``number``.

    ``before``: bytes of all earlier rows; ``number``: how many they are.
    Only one row for each partition is gathered to turn totals into starts.
    """
    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    starts, bytes_so_far, rows_so_far = {}, 0, 0
    for row in totals.orderBy("part").collect():  # as many rows as partitions
        starts[row["part"]] = (bytes_so_far, rows_so_far)
        bytes_so_far, rows_so_far = bytes_so_far + row["bytes"], rows_so_far + row["rows"]
    schema = T.StructType([*ordered.schema.fields, T.StructField("before", T.LongType()), T.StructField("number", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, list[int]] = {}
        for batch in batches:
            part, size = np.asarray(batch.column("part")), np.asarray(batch.column("size"))
            before, number = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p)
                state = at.setdefault(p, list(starts[p]))
                sums = np.cumsum(size[own])
                before[own] = state[0] + sums - size[own]
                number[own] = state[1] + np.arange(len(own))
                state[0] += int(sums[-1])
                state[1] += len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(number)], [f.name for f in schema.fields])

    return ordered.repartition("part").sortWithinPartitions("part", "place").mapInArrow(run, schema)


def contiguous_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per row.

    Order: doc_id, null first, then checksum, digest and where a row was read;
    so rows of one id may be parted, also when a third of all rows share it. A
    null text has size 1 and checksum 0. A table smaller than ``shards`` leaves
    shards empty; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    slim = docs.select("doc_id", byte_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("tie"))
    slim = stored(slim.withColumn("read_at", F.monotonically_increasing_id()), "sizes")
    order = ["doc_id", "text_crc32", "tie", "read_at"]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "read_at")
    placed = ranged.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    summed = stored(prefix_sums(stored(placed, "placed")), "prefix-sums")
    total = summed.agg(F.coalesce(F.sum("size"), F.lit(1)).alias("total")).first()["total"]
    # The middle of a document, in halves of a byte, decides; exact in whole numbers.
    middle = (F.col("before") * 2 + F.col("size")).cast("decimal(38,0)")
    cut = summed.withColumn("shard", F.least(F.floor(middle * shards / (2 * total)).cast("int"), F.lit(shards - 1)))
    # One row for each shard.
    firsts = cut.groupBy("shard").agg(F.min("number").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("number") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
