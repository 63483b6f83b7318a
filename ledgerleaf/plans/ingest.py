"""Ingest jobs: uploads of personal documents, and rebuilding a public corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerleaf.functions.text import fixed_point, make_summary
from ledgerleaf.functions.vectors import Embedder, embed
from ledgerleaf.operators.chunking import chunks_of
from ledgerleaf.operators.graph import ENTITY_RULES, extract_graph
from ledgerleaf.plans.corpus import build_corpus
from ledgerleaf.sources.files import dispatch_by_extension, scan_corpus

# The size limit in megabytes and the messages of refused files.
MAX_FILE_MB = 20
NO_CHUNKS = "文档切分后无有效内容块。"


class Tables(Mapping):
    """Tables by name, each planned when it is first asked for: edges store their entities when they are planned."""

    def __init__(self, plans: dict[str, Callable[[], DataFrame]]) -> None:
        self.plans = {name: cache(plan) for name, plan in plans.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self.plans[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self.plans)

    def __len__(self) -> int:
        return len(self.plans)


def ingest_documents(
    files: DataFrame,
    max_file_mb: float = MAX_FILE_MB,
    embedder: Embedder | None = None,
    rules: Sequence[tuple[str, str]] = ENTITY_RULES,
    max_chars: int = 600,
    overlap: int = 80,
    staging: str | None = None,
) -> Mapping[str, DataFrame]:
    """Uploads ``(id, user_id, filename, content, uploaded_at)`` -> five tables.

    A file that is too large, unsupported, empty or without chunks becomes an
    ``error`` row of ``documents`` and owns nothing else; the others are unaffected.
    All tables but the edges are row-local projections of the files, so nothing is
    shuffled. The graph is extracted only for a caller who takes ``nodes`` or ``edges``.
    With ``staging`` (a path in shared storage) the parsed files are written there
    once, so that writing all five tables does not parse the files five times.
    """
    # The limit is cut to whole megabytes before it is applied.
    size = F.length("content").cast("bigint")
    limit = int(max_file_mb) * 1024 * 1024
    message = F.concat(
        F.lit(f"文件超过大小上限 {max_file_mb}MB（当前 "), fixed_point(size / F.lit(1048576.0), 1), F.lit("MB）")
    )
    sized = files.withColumn("size", size).withColumn("_large", F.when(size > limit, message))
    # Bytes of refused files are dropped before any of them is parsed.
    sized = sized.withColumn("content", F.when(F.col("_large").isNull(), F.col("content")))
    parsed = dispatch_by_extension(sized)
    pieces = F.when(F.coalesce("_large", "error").isNull(), chunks_of(F.col("text"), max_chars, overlap))
    parsed = parsed.withColumn("pieces", pieces)
    no_chunks = F.when(F.size("pieces") == 0, F.lit(NO_CHUNKS))
    raw = [c for c in ("raw",) if c in files.columns]
    parsed = parsed.select(
        "id", "user_id", "filename", "size", "uploaded_at", "text", "pieces", *raw,
        F.coalesce("_large", "error", no_chunks).alias("error"),
    )
    if staging:
        parsed.write.parquet(staging)
        parsed = files.sparkSession.read.parquet(staging)
    fine = F.col("error").isNull()
    documents = parsed.select(
        "id", "user_id", "filename", "size", F.when(fine, F.lit("done")).otherwise(F.lit("error")).alias("status"),
        "error", "uploaded_at", F.when(fine, make_summary(F.col("text"))).alias("summary"),
    )
    # A refused file has no pieces, so it yields no chunk. A filter (also the one the
    # optimizer infers for a bare exploded column) would be pushed below the parsing
    # and have every file parsed twice.
    pieces = F.coalesce("pieces", F.array().cast(parsed.schema["pieces"].dataType))
    chunks = parsed.select(F.col("id").alias("doc_id"), "user_id", F.posexplode(pieces).alias("idx", "piece")).select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":c"), F.col("idx").cast("string")).alias("id"),
        "doc_id", "user_id", "idx", F.col("piece.text").alias("text"), F.col("piece.chapter").alias("chapter"),
    )
    vectors = embed(chunks, embedder).select(
        F.col("id").alias("chunk_id"), "doc_id", "user_id", "embedding", F.size("embedding").alias("dim")
    )
    accepted = parsed.select(
        F.col("id").alias("doc_id"), "user_id", "filename", F.when(fine, F.col("text")).alias("text"), *raw
    )
    graph = cache(lambda: extract_graph(accepted, rules))
    return Tables({
        "documents": lambda: documents, "chunks": lambda: chunks, "embeddings": lambda: vectors,
        "nodes": lambda: graph()[0], "edges": lambda: graph()[1],
    })


def rebuild(
    spark: SparkSession, folder: str, target: str, built_at: str, embedder: Embedder | None = None
) -> tuple[int, DataFrame]:
    """Rescan a corpus folder into ``target``; returns the rows cleared and the new build record.

    The new corpus is written whole before it takes the old one's place.
    """
    try:
        cleared = spark.read.parquet(f"{target}/chunks").count()
    except Exception as missing:  # noqa: BLE001 - a first build has nothing to clear
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        cleared = 0
    build_corpus(scan_corpus(spark, folder), embedder).write.mode("overwrite").parquet(f"{target}/chunks")
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
    record = spark.createDataFrame([("last_build_at", built_at)], schema)
    record.write.mode("overwrite").parquet(f"{target}/kb_meta")
    return cleared, record
