"""Order inside groups of any size.

A window over a group puts that group into one task. Here a group is cut into
spans of its order column first, so a group that holds a third of all rows is
spread over many tasks, and only one small row per span meets in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerleaf.session import cut_lineage

SPAN = 100_000


def _join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on all ``keys``, a null being equal to a null."""
    named = {key: f"_of_{key}" for key in keys}
    same = [left[key].eqNullSafe(F.col(other)) for key, other in named.items()]
    return left.join(right.withColumnsRenamed(named), same).drop(*named.values())


def next_in_group(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, span: int = SPAN) -> DataFrame:
    """Adds ``out``: ``value`` of the following row of the same group, else null."""
    spanned = df.withColumn("_span", F.floor(F.col(order) / span))
    inside = W.partitionBy(*keys, "_span").orderBy(order)
    local = spanned.withColumn("_next", F.lead(F.struct(value)).over(inside))
    firsts = spanned.groupBy(*keys, "_span").agg(F.min_by(F.struct(value), order).alias("_first"))
    following = firsts.withColumn("_following", F.lead("_first").over(W.partitionBy(*keys).orderBy("_span")))
    joined = _join_groups(local, following.drop("_first"), [*keys, "_span"])
    return joined.withColumn(out, F.coalesce("_next", "_following")[value]).drop("_span", "_next", "_following")


def rank_in_group(df: DataFrame, keys: Sequence[str], order: str, tie: str, out: str, span: int = SPAN) -> DataFrame:
    """Adds ``out``: the row's number in its group, from 1, by ``order`` then ``tie``."""
    spanned = df.withColumn("_span", F.floor(F.col(order) / span))
    local = F.row_number().over(W.partitionBy(*keys, "_span").orderBy(order, tie))
    counts = spanned.groupBy(*keys, "_span").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1))
    before = counts.select(*keys, "_span", F.coalesce(earlier, F.lit(0)).alias("_before"))
    ranked = _join_groups(spanned.withColumn("_local", local), before, [*keys, "_span"])
    return ranked.withColumn(out, F.col("_before") + F.col("_local")).drop("_span", "_local", "_before")


def number_rows(df: DataFrame, order: Sequence[Column], out: str, start: int = 1) -> DataFrame:
    """Consecutive numbers over the whole table in the given order, without one big window.

    Rows are range-partitioned and sorted, written once to the shared folder so
    that both passes see the same partitions, and numbered from the counts of the
    partitions before theirs.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition, so the running sum and the broadcast are small.
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    inside = F.col("_place").bitwiseAND((1 << 33) - 1)
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(out, F.col("_before") + inside + start).drop("_part", "_place", "_before")


def assign_ids(existing: DataFrame, new_rows: DataFrame, order: Sequence[Column], id_col: str = "id") -> DataFrame:
    """``new_rows`` with ids that continue after the largest id of ``existing``."""
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top")).first()["top"]
    return number_rows(new_rows, order, id_col, start=top + 1)
