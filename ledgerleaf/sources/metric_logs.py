"""Metric log folders as ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerleaf.operators.training import metric_series, parse_metric_lines
from ledgerleaf.sources.files import file_path


def read_metric_lines(spark: SparkSession, folder: str, names: str = "*.jsonl") -> DataFrame:
    """``(file, line_no, line)`` of all files with such names below the folder.

    ``file`` (path parts) and ``line_no`` (split start, position) sort in reading
    order, so files of any size are split over tasks without losing their order.
    """
    lines = spark.read.text(folder, pathGlobFilter=names, recursiveFileLookup=True).select(
        F.col("value").alias("line"),
        file_path().alias("path"),
        F.struct(
            F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place")
        ).alias("line_no"),
    )
    skipped = F.col("path").rlike(r"/wandb") | F.col("path").rlike(r"/events\.out\.tfevents[^/]*$")
    return lines.filter(~skipped).select(F.split("path", "/").alias("file"), "line_no", "line")


def read_metric_logs(spark: SparkSession, folder: str, names: str = "*.jsonl") -> DataFrame:
    """``(metric, step, value)`` of a log folder."""
    return metric_series(parse_metric_lines(read_metric_lines(spark, folder, names)))
