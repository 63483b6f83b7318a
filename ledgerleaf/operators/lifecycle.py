"""Versions, deletions, status updates and roll-ups of documents and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.functions.text import epoch_ms_to_iso
from ledgerleaf.operators.history import AccessError, is_admin


# ---------------------------------------------------------------- documents
def upsert_by_doc(target: DataFrame, batch: DataFrame, key: str = "doc_id") -> DataFrame:
    """The target with every document of ``batch`` replaced by its new version.

    A document whose new version has no rows is not in ``batch``, so it keeps its
    old rows. The batch's keys are small next to the target's, and are taken once.
    """
    replaced = batch.select(key).distinct()
    return target.join(replaced, key, "left_anti").unionByName(batch, allowMissingColumns=True)


def delete_docs(target: DataFrame, doc_ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(rows that stay, deleted rows per document)``.

    The deleted keys may be as many as the target's, so they are never broadcast.
    Both sides are dealt by key into twice the shuffle partitions. (With just as
    many, Spark takes the deal for its own and merges partitions again.)
    """
    parts = 2 * int(target.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gone = doc_ids.select(key).distinct().repartition(parts, key).hint("merge")
    dealt = target.repartition(parts, key)
    removed = dealt.join(gone, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("removed"))
    return dealt.join(gone, key, "left_anti"), removed


def cascade_delete(tables: dict[str, DataFrame], requests: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete documents with everything that hangs on them, for their owners only.

    ``tables['documents']`` has ``id, user_id``; all others ``doc_id, user_id``.
    ``requests(doc_id, user_id)``. Returns the tables and ``(doc_id, user_id, deleted)``.
    """
    owners = tables["documents"].select(F.col("id").alias("doc_id"), "user_id").withColumn("_own", F.lit(True))
    asked = requests.select("doc_id", "user_id").distinct()
    granted = asked.join(owners, ["doc_id", "user_id"], "left_semi")
    left = {}
    for name, table in tables.items():
        key = granted.withColumnRenamed("doc_id", "id") if name == "documents" else granted
        left[name] = table.join(key, key.columns, "left_anti")
    answer = asked.join(owners, ["doc_id", "user_id"], "left").select(
        "doc_id", "user_id", F.coalesce("_own", F.lit(False)).alias("deleted")
    )
    return left, answer


def get_doc(docs: DataFrame, doc_id: object, user_id: object) -> DataFrame:
    """One row, or none when the document is missing or someone else's."""
    return docs.filter((F.col("id") == doc_id) & (F.col("user_id") == user_id))


def apply_status_updates(docs: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest status per document; error and summary change only to non-null values.

    ``updates(doc_id, status, error, summary, at)``; each of a document's updates
    counts, so a later one without an error does not wipe an earlier error.
    """
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("at")))
    merged = updates.groupBy(F.col("doc_id").alias("id")).agg(
        F.max_by("status", "at").alias("_status"), latest("error").alias("_error"),
        latest("summary").alias("_summary"), F.max("at").alias("_at"),
    )
    keep = lambda new, old: F.coalesce(F.col(new), F.col(old)).alias(old)
    joined = docs.join(merged, "id", "left")
    changed = {"status": "_status", "error": "_error", "summary": "_summary", "updated_at": "_at"}
    return joined.select(*[keep(changed[c], c) if c in changed else F.col(c) for c in docs.columns])


def list_docs(docs: DataFrame, user_id: object, sequence: str = "seq") -> DataFrame:
    """A user's documents, newest upload first; ``sequence`` is the order of arrival."""
    return docs.filter(F.col("user_id") == user_id).orderBy(F.desc("uploaded_at"), F.desc(sequence))


# ---------------------------------------------------------------- roll-ups
def kb_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, documents and largest dimension in one row.

    Documents are counted after a per-document pre-aggregate, which also makes the
    exact distinct count cheap when one document owns very many chunks.
    """
    per_doc = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim"))
    return per_doc.agg(
        F.count("doc_id").alias("doc_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"),
        F.max("dim").alias("dim"),
    )


def list_kb_docs(chunks: DataFrame) -> DataFrame:
    by = ("doc_id", "title", "doc_type", "agency", "domain", "version")
    named = chunks.select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in by[1:]])
    return named.groupBy(*by).agg(F.count(F.lit(1)).alias("chunk_count")).orderBy("doc_id")


def personal_stats(docs: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per user: documents, bytes, chunks, vectors and largest dimension."""
    of_docs = docs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size")
    )
    of_chunks = chunks.groupBy("user_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    of_vectors = vectors.groupBy("user_id").agg(F.count(F.lit(1)).alias("vector_count"), F.max("dim").alias("dim"))
    joined = of_docs.join(of_chunks, "user_id", "left").join(of_vectors, "user_id", "left")
    return joined.fillna(0, ["chunk_count", "vector_count"])


def count_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))


# ---------------------------------------------------------------- sessions
def purge_before(
    conversations: DataFrame, cutoff_ms: int, requester: object, admins: Sequence = (), allow_admin_all: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(kept, purged)``: records last updated before the cutoff, or never, are purged."""
    if not is_admin(requester, admins, allow_admin_all):
        raise AccessError("only an administrator may purge")
    return split_purge(conversations, cutoff_ms)


def split_purge(conversations: DataFrame, cutoff_ms: int) -> tuple[DataFrame, DataFrame]:
    cutoff: Column = epoch_ms_to_iso(F.lit(cutoff_ms).cast("bigint"))
    old = F.col("updated_at").isNull() | (F.col("updated_at") < cutoff)
    return conversations.filter(~old), conversations.filter(old)


def apply_retention(
    conversations: DataFrame, retention_days: int | None, now_ms: int, requester: object,
    admins: Sequence = (), allow_admin_all: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Purge by age in days; 0 purges everything so far, None keeps all."""
    if retention_days is None:
        return conversations, conversations.limit(0)
    cutoff = now_ms - retention_days * 86_400_000
    return purge_before(conversations, cutoff, requester, admins, allow_admin_all)


def delete_session(
    conversations: DataFrame, conv_id: object, requester: object, admins: Sequence = (), allow_admin_all: bool = False
) -> DataFrame:
    """Records without the deleted one; an error when it is missing or someone else's."""
    row = conversations.filter(F.col("id").cast("string") == str(conv_id)).select("user_id").first()
    if row is None:
        raise AccessError(f"conversation {conv_id} does not exist")
    if str(row["user_id"]) != str(requester) and not is_admin(requester, admins, allow_admin_all):
        raise AccessError(f"conversation {conv_id} belongs to another user")
    return conversations.filter(F.col("id").cast("string") != str(conv_id))


# ---------------------------------------------------------------- schema upkeep
def backfill_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add each missing column with its default; running it again changes nothing."""
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


USER_DEFAULTS = {"hashed_password": "", "is_active": 1}  # fixed values
