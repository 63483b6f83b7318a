"""Chat records from JSON arrays or JSON lines, and training tables to parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerleaf.schemas import CHAT_MESSAGES

_STRICT = {"allowSingleQuotes": "false"}


def chat_messages_of(item: Column) -> Column:
    """Messages of one record: ``{"messages": [...]}`` or the bare list."""
    wrapped = F.from_json(item, F.lit("messages string"), _STRICT)["messages"]
    return F.from_json(F.when(F.ltrim(item).startswith("["), item).otherwise(wrapped), CHAT_MESSAGES, _STRICT)


def parse_chat_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """One record per non-blank line."""
    rows = lines.filter(F.trim(column) != "")
    return rows.select(*[c for c in lines.columns if c != column], chat_messages_of(F.col(column)).alias("messages"))


def read_chat_json(spark: SparkSession, path: str) -> DataFrame:
    """Records as ``messages array<struct<role, content>>`` and ``error``, the text of an item that is none.

    Each file is judged by itself. It is one JSON array if its first line opens a
    list that does not close there, or if it is a single line whose list holds
    something else than messages; otherwise each line is a record, be it an
    object or a bare list. Lines are split over tasks; an array has to be read
    by one task, so prefer lines for large inputs.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("place")).where(F.trim("value") != "")
    files = lines.groupBy("file").agg(F.min_by("value", "place").alias("head"), F.count(F.lit(1)).alias("lines"))
    items = F.from_json("head", F.lit("array<string>"), _STRICT)
    messages = F.get_json_object(F.get(items, F.lit(0)), "$.role").isNotNull()
    single = (F.col("lines") == 1) & ~F.coalesce(messages, F.lit(False))
    arrays = files.where(F.ltrim("head").startswith("[") & (items.isNull() | single)).select("file")
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")).join(arrays, "file", "left_semi")
    # A text that is no list is one bad item, not an empty list.
    listed = F.coalesce(F.from_json("value", F.lit("array<string>"), _STRICT), F.array("value"))
    every = lines.join(arrays, "file", "left_anti").select("value").union(whole.select(F.explode(listed)))
    parsed = every.select("value", chat_messages_of(F.col("value")).alias("messages"))
    return parsed.select("messages", F.when(F.col("messages").isNull(), F.col("value")).alias("error"))


def write_training_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
