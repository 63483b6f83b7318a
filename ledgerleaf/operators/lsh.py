"""Approximate vector search by signed random projections, as an option beside the exact scan.

In each of several tables, a vector's bucket is the signs of its products with
some random directions. A query looks into its own bucket and into those that
differ in one sign, in every table; the chunks met there are scored exactly.
Buckets are looked up by joins; a large bucket is cut into parts by chunk, and
its askers are sent to every part.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerleaf.functions.vectors import cosine
from ledgerleaf.session import cut_lineage

TABLES, BITS, SEED = 20, 8, 17
#: Rows of a bucket in one part.
PART_ROWS = 10_000
RANK_DIGITS = 10


def directions(dimension: int, tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> Column:
    """array (tables) of arrays (bits) of random directions, the same for the same arguments."""
    drawn = np.random.default_rng(seed).normal(size=(tables, bits, dimension)).round(4)
    return F.from_json(F.lit(json.dumps(drawn.tolist())), F.lit("array<array<array<double>>>"))


def buckets(vector: Column, planes: Column, probe: bool = False) -> Column:
    """array<struct(table, bucket)> of a vector; with ``probe``, also the buckets that differ in one sign."""

    def of_table(own: Column, table: Column) -> Column:
        dot = lambda p: F.aggregate(F.zip_with(vector, p, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        signs = F.transform(own, lambda p, j: F.when(dot(p) >= 0, F.lit(1)).otherwise(F.lit(0)) * F.pow(F.lit(2.0), j).cast("long"))

        def numbered(s: Column) -> Column:
            code = F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x)
            codes = F.array(code)
            if probe:
                codes = F.concat(codes, F.transform(s, lambda x, j: code - x + (F.pow(F.lit(2.0), j).cast("long") - x)))
            return F.transform(codes, lambda c: F.struct(table.alias("table"), c.alias("bucket")))

        # The signs are bound once: the codes read them many times.
        return F.transform(F.array(signs), numbered)[0]

    return F.flatten(F.transform(planes, of_table))


def vector_topk_lsh(
    queries: DataFrame, chunks: DataFrame, k: int = 5, tables: int = TABLES, bits: int = BITS, seed: int = SEED, part_rows: int = PART_ROWS
) -> DataFrame:
    """``vector_topk`` over the chunks that share a bucket with the query: ``(query_id, chunk_id, score, rank)``.

    Scores are exact, a near chunk may be missed; more ``tables`` find more, more
    ``bits`` score fewer. Null vectors take no part; with fewer chunks met than
    ``k`` the list is shorter; an empty side gives an empty result.
    """
    one = chunks.where(F.col("embedding").isNotNull()).select(F.size("embedding").alias("d")).first()
    planes = directions(one["d"] if one else 1, tables, bits, seed)
    held = chunks.where(F.col("embedding").isNotNull()).select("chunk_id", F.explode_outer(buckets(F.col("embedding").cast("array<double>"), planes)).alias("b"))
    held = cut_lineage(held.select("chunk_id", "b.table", "b.bucket"))
    parts = held.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    asked = queries.where(F.col("query_vec").isNotNull()).select("query_id", F.explode_outer(buckets(F.col("query_vec").cast("array<double>"), planes, True)).alias("b"))
    spread = asked.select("query_id", "b.table", "b.bucket").join(parts, ["table", "bucket"]).select(
        "query_id", "table", "bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    placed = held.join(parts, ["table", "bucket"]).select(
        "chunk_id", "table", "bucket", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int").alias("part")
    )
    met = placed.join(spread, ["table", "bucket", "part"]).select("query_id", "chunk_id").distinct()
    scored = met.join(chunks.select("chunk_id", "embedding"), "chunk_id").join(queries.select("query_id", "query_vec"), "query_id")
    score = F.round(cosine(F.col("query_vec").cast("array<double>"), F.col("embedding").cast("array<double>")), RANK_DIGITS)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    best = scored.select("query_id", "chunk_id", score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")
