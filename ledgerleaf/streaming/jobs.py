"""Streaming jobs: chat event streams, continuous ingest, trace recording."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerleaf.operators.history import attach_traces, redact_runs
from ledgerleaf.operators.lifecycle import upsert_by_doc
from ledgerleaf.schemas import STREAM_EVENT
from ledgerleaf.session import cut_lineage

BUCKETS = 256
RUN_BUCKETS = 2048


# ---------------------------------------------------------------- chat event streams
def parse_stream_events(lines: DataFrame) -> DataFrame:
    """``(run_id, seq, line, at)`` -> event columns; lines that are no event are skipped."""
    body = F.when(F.col("line").startswith("data: "), F.substring("line", 7, 1_000_000_000))
    event = F.from_json(body, STREAM_EVENT, {"allowSingleQuotes": "false"})
    # Exploding the readable events parses each line once; a filter would parse it again.
    readable = F.filter(F.array(event), lambda e: e["type"].isNotNull())
    return lines.select("run_id", "seq", "at", F.inline(readable))


def chat_messages(lines: DataFrame) -> DataFrame:
    """Message rows of a stream, in ``seq`` order per run: agents', then the reply.

    Every event gives its row by itself, so a stream needs no state for it.
    """
    events = parse_stream_events(lines)
    agent = (F.col("type") == "agent_message") & (F.length("content") > 0)
    rows = events.filter(agent | (F.col("type") == "done"))
    done = F.col("type") == "done"
    return rows.select(
        "run_id", "seq", "at",
        F.when(done, F.lit("assistant")).otherwise(F.lit("agent")).alias("role"),
        F.when(done, F.coalesce("reply", F.lit(""))).otherwise(F.col("content")).alias("content"),
        F.when(~done, F.col("agent")).alias("agent"),
        F.when(~done, F.col("avatar")).alias("avatar"),
        F.when(~done, F.col("mention")).alias("mention"),
        F.when(~done, F.lit("expert_opinion")).alias("type"),
        F.when(done, F.col("conversation_id")).alias("conversation_id"),
    )


def fold_chat_stream(lines: DataFrame, watermark: str | None = None) -> DataFrame:
    """One row per run: reply, conversation, number of agent messages, failure.

    With ``watermark`` (for streams) a run is given out once it has been quiet that long.
    """
    events = parse_stream_events(lines)
    keys = ["run_id"]
    if watermark:
        events = events.withWatermark("at", watermark)
        keys = [F.session_window("at", watermark), "run_id"]
    kind = F.col("type")
    last = lambda value, name: F.max_by(value, F.when(kind == name, F.col("seq")))
    folded = events.groupBy(*keys).agg(
        F.coalesce(last(F.coalesce("reply", F.lit("")), "done"), F.lit("")).alias("reply"),
        last(F.col("conversation_id"), "done").alias("conversation_id"),
        F.count(F.when((kind == "agent_message") & (F.length("content") > 0), 1)).alias("agent_messages"),
        F.coalesce(F.bool_or(kind == "error"), F.lit(False)).alias("failed"),
        last(F.col("detail"), "error").alias("detail"),
    )
    return folded.select("run_id", "reply", "conversation_id", "agent_messages", "failed", "detail")


_FOLDED = "run_id string, reply string, conversation_id long, agent_messages long, failed boolean, detail string, version long, closed boolean"
_FOLD_STATE = "run_id string, seen array<long>, done_seq long, reply string, conversation_id long, agent_messages long, failed boolean, detail_seq long, detail string, until long"


def _fold_bucket(quiet_ms: int):
    """The new events of a bucket's runs and its state -> folds so far of the runs with new events, and once more, closed, of those that stay quiet."""

    columns, names = (T.StructType.fromDDL(x).fieldNames() for x in (_FOLDED, _FOLD_STATE))

    def row(s: dict, closed: bool) -> tuple:
        return s["run_id"], s["reply"] or "", s["conversation_id"], s["agent_messages"], s["failed"], s["detail"], len(s["seen"]), closed

    def fold(_bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = {r[0]: dict(zip(names, r)) for r in (state.get[0] if state.exists else ())}
        touched, fresh = {}, {}  # distinct sequence numbers of the runs with events; those runs that have new ones
        for events in batches:
            for run_id, seq, at, kind, content, reply, conversation, detail in zip(*(events[c] for c in ("run_id", "seq", "at", "type", "content", "reply", "conversation_id", "detail"))):
                s = runs.get(run_id)
                if s is None:
                    s = runs[run_id] = dict(zip(names, (run_id, [], None, None, None, 0, False, None, None, 0)))
                if run_id not in touched:
                    touched[run_id] = set(s["seen"])
                s["until"] = max(s["until"], int(at.timestamp() * 1000) + quiet_ms)
                if seq in touched[run_id]:
                    continue  # replayed
                seq, fresh[run_id] = int(seq), True
                touched[run_id].add(seq)
                if kind == "agent_message" and content:
                    s["agent_messages"] += 1
                elif kind == "done" and (s["done_seq"] is None or seq > s["done_seq"]):
                    s.update(done_seq=seq, reply=reply or "", conversation_id=None if pd.isna(conversation) else int(conversation))
                elif kind == "error":
                    s["failed"] = True
                    if s["detail_seq"] is None or seq > s["detail_seq"]:
                        s.update(detail_seq=seq, detail=detail)
        watermark = state.getCurrentWatermarkMs()
        for run_id, seen in touched.items():
            runs[run_id].update(seen=sorted(seen), until=max(runs[run_id]["until"], watermark + 1))
        quiet = [run_id for run_id, s in runs.items() if s["until"] < watermark]
        rows = [row(runs[run_id], False) for run_id in fresh] + [row(runs.pop(run_id), True) for run_id in quiet]
        if runs:
            state.update(([tuple(s[n] for n in names) for s in runs.values()],))
            state.setTimeoutTimestamp(min(s["until"] for s in runs.values()))
        else:
            state.remove()
        if rows:
            # Numbers with gaps would become floats, which hold no large ones.
            yield pd.DataFrame(rows, columns=columns, dtype=object).astype({"conversation_id": "Int64"})

    return fold


def fold_runs_with_state(lines: DataFrame, late: str = "10 minutes", quiet_ms: int = 600_000, buckets: int = RUN_BUCKETS) -> DataFrame:
    """A stream of ``(run_id, seq, line, at)`` -> the fold of each run whenever it has new events (update mode).

    ``version`` counts the run's distinct events, so the row with the largest one
    is the newest, also where a batch is written twice. Replayed sequence numbers
    change nothing. A run without events for ``quiet_ms`` of event time is given
    out once more as ``closed`` and forgotten. State per run: its sequence
    numbers and the fold. Rows without a sequence number or a time are left out.

    Runs share a state row by a hash, as each call of Python takes longer than some
    hundred runs inside it. Choose ``buckets`` so that one holds about that many open
    runs; it stays the same for the life of a checkpoint.
    """
    events = parse_stream_events(lines).where("seq IS NOT NULL AND at IS NOT NULL")
    typed = events.select(
        F.col("run_id").cast("string").alias("run_id"), F.col("seq").cast("long").alias("seq"), "at", "type", "content", "reply",
        F.col("conversation_id").cast("string").alias("conversation_id"), "detail",  # pandas would make numbers with nulls floats
    )
    bucketed = typed.withColumn("_bucket", F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int"))
    return bucketed.withWatermark("at", late).groupBy("_bucket").applyInPandasWithState(
        _fold_bucket(quiet_ms), _FOLDED, f"runs array<struct<{_FOLD_STATE}>>", "update", GroupStateTimeout.EventTimeTimeout
    )


def write_folds(lines: DataFrame, path: str, checkpoint: str, **how) -> StreamingQuery:
    """Appends every fold of ``fold_runs_with_state`` under ``path``; ``latest_folds`` reads them."""
    folds = fold_runs_with_state(lines, **how)
    write = lambda batch, _number: batch.write.mode("append").parquet(path)
    return folds.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_folds(spark: SparkSession, path: str) -> DataFrame:
    """The newest fold of each run."""
    rows = spark.read.schema(_FOLDED).parquet(path)
    newest = rows.groupBy("run_id").agg(F.max_by(F.struct(*rows.columns[1:]), F.struct("version", "closed")).alias("f"))
    return newest.select("run_id", "f.*")


# ---------------------------------------------------------------- tables in buckets
def write_buckets(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write ``df`` split by a hash of ``key``; only the buckets it holds are replaced.

    Choose ``buckets`` so that one holds about a gigabyte: a batch rewrites the
    buckets it touches.
    """
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    (
        bucketed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("_bucket").parquet(path)
    )


def touched_buckets(table: DataFrame, batch: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The table's rows in the buckets the batch touches: a list of at most ``buckets`` numbers."""
    number = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    hit = [r[0] for r in batch.select(number).distinct().collect()]
    return table.filter(F.col("_bucket").isin(hit)) if hit else table.filter(F.lit(False))


def _existing(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(path)
    except Exception as missing:  # noqa: BLE001 - a first batch has no table yet
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise


def upsert_table(batch: DataFrame, path: str, key: str = "doc_id", buckets: int = BUCKETS) -> None:
    """Replace the batch's documents in the stored table, rewriting only their buckets.

    Doing it twice changes nothing, so a batch may be replayed after a failure.
    """
    table = _existing(batch.sparkSession, path, batch.schema)
    if table is None:
        write_buckets(batch, path, key, buckets)
        return
    old = touched_buckets(table, batch, key, buckets).drop("_bucket")
    write_buckets(cut_lineage(upsert_by_doc(old, batch, key)), path, key, buckets)


# ---------------------------------------------------------------- tables in versions
def append_version(rows: DataFrame, path: str, version: int) -> None:
    """Add rows as one version of their documents; nothing stored before is rewritten."""
    rows.write.mode("overwrite").parquet(f"{path}/_version={version}")


def current_rows(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """The newest version of each document of a table written by ``append_version``.

    Only keys and versions are aggregated; what is joined back to the table is the
    list of replaced versions, which is short between compactions.
    """
    versions = table.groupBy(key, "_version").agg(F.lit(1).alias("_one")).drop("_one")
    newest = versions.groupBy(key).agg(F.max("_version").alias("_newest"), F.count(F.lit(1)).alias("_count"))
    replaced = newest.filter(F.col("_count") > 1).join(versions, key).filter(F.col("_version") < F.col("_newest"))
    return table.join(replaced.select(key, "_version"), [key, "_version"], "left_anti")


def compact(spark: SparkSession, path: str, target: str, key: str = "doc_id") -> None:
    """Write the current rows of a versioned table to a new place, as its newest version."""
    table = spark.read.parquet(path)
    append_version(current_rows(table, key).drop("_version"), target, table.agg(F.max("_version")).first()[0] or 0)


def _first_version(spark: SparkSession, path: str, checkpoint: str) -> int:
    """The version of a stream's first batch: one above all that were stored when it began.

    It is kept beside the stream's own checkpoint, so a restart goes on with the same numbers.
    """
    note, kind = f"{checkpoint}/_first_version", T.StructType([T.StructField("version", T.LongType())])
    known = _existing(spark, note, kind)
    if known is None:
        table = _existing(spark, path, T.StructType([T.StructField("_version", T.LongType())]))
        top = table.agg(F.max("_version")).first()[0] if table is not None else None
        spark.createDataFrame([((top or 0) + 1,)], kind).write.mode("overwrite").parquet(note)
        known = spark.read.schema(kind).parquet(note)
    return known.first()["version"]


def ingest_stream(
    uploads: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Ingest arriving documents; each replaces its earlier version (see ``current_rows``).

    ``transform`` turns a batch of documents into the rows to store (with
    ``doc_id``), for example ``build_corpus``. A document that arrives twice in one
    batch counts with its latest ``arrived_at``, which is required and does not
    reach ``transform``. The cost of a batch is that of its own documents. Versions
    follow the batch numbers, so a replayed batch overwrites itself.
    """
    if "arrived_at" not in uploads.columns:
        raise ValueError("documents need a column arrived_at")
    first = _first_version(uploads.sparkSession, path, checkpoint)

    def store(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("doc_id").agg(F.max("arrived_at").alias("arrived_at"))
        latest = batch.join(newest, ["doc_id", "arrived_at"], "left_semi").drop("arrived_at")
        append_version(transform(latest), path, first + number)

    return (
        uploads.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# ---------------------------------------------------------------- trace recording
def split_failed(payloads: DataFrame, schema: T.StructType, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """``(parsed rows, failed rows)``: a payload that cannot be read is set aside, never an exception."""
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})
    required = schema.fields[0].name
    readable = F.filter(F.array(parsed), lambda row: row[required].isNotNull())
    good = payloads.select(*[c for c in payloads.columns if c != column], F.inline(readable))
    bad = payloads.filter(F.size(readable) == 0).select(
        F.lit("payload is not readable").alias("error"), F.col(column).alias("payload"),
        F.unix_millis(F.current_timestamp()).alias("at"),
    )
    return good, bad


def quarantine(bad: DataFrame, path: str, batch: int | None = None) -> None:
    """Add failed payloads as JSON lines with error and time; those of a numbered batch replace themselves."""
    if batch is None:
        bad.write.mode("append").json(path)
    else:
        bad.write.mode("overwrite").json(f"{path}/_batch={batch}")


MESSAGES = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("trace", T.StringType()),
    ]
)
RUN = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("at", T.LongType()),
        T.StructField("reply", T.StringType()),
        T.StructField("trace", T.StringType()),
    ]
)


def record_run_stream(
    payloads: DataFrame, messages_path: str, quarantine_path: str, checkpoint: str, buckets: int = BUCKETS
) -> StreamingQuery:
    """Attach arriving runs (JSON text) to the stored messages, redacted; bad ones go to quarantine.

    Without a stored table the runs begin one. A run whose trace is stored already
    is passed over, so a batch may be replayed.
    """

    def record(batch: DataFrame, number: int) -> None:
        good, bad = split_failed(batch, RUN)
        quarantine(bad, quarantine_path, number)
        spark = batch.sparkSession
        runs = redact_runs(good.select(*RUN.names))
        table = _existing(spark, messages_path, MESSAGES)
        if table is None:
            old = spark.createDataFrame([], MESSAGES)
        else:
            old = touched_buckets(spark.read.parquet(messages_path), runs, "conv_id", buckets).drop("_bucket")
            stored = old.select("conv_id", F.get_json_object("trace", "$.run_id").alias("run_id")).where("run_id IS NOT NULL")
            runs = runs.join(stored, ["conv_id", "run_id"], "left_anti")
        runs = cut_lineage(runs)
        write_buckets(cut_lineage(attach_traces(old, runs)), messages_path, "conv_id", buckets)

    return (
        payloads.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
