"""Conversation history: records, session roll-ups, search, export, traces.

A conversation is stored as one record ``(id, user_id, scene, title, created_at,
updated_at, data)`` with its messages as JSON in ``data``; what concerns one
record is computed inside its row. Message tables ``(conv_id, idx, role,
content, ...)`` are the exploded form, and use aggregates with map-side combine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerleaf.functions.redact import redact_text
from ledgerleaf.functions.text import strip, to_epoch_ms, truncate_title
from ledgerleaf.operators.ordering import rank_in_group
from ledgerleaf.schemas import CONVERSATION_DATA, EVENT, EVENT_FIELDS, TRACE
from ledgerleaf.session import cut_lineage

_NO_NULLS = {"ignoreNullFields": "false"}


class AccessError(PermissionError):
    """The requester may not see or change what was asked for."""


# ---------------------------------------------------------------- records and messages
def _messages_of(data: str = "data") -> Column:
    parsed = F.from_json(data, CONVERSATION_DATA)["messages"]
    return F.coalesce(parsed, F.array().cast(CONVERSATION_DATA["messages"].dataType))


def parse_records(conversations: DataFrame) -> DataFrame:
    """Adds ``messages``; unreadable JSON gives an empty list."""
    return conversations.withColumn("messages", _messages_of())


def explode_messages(conversations: DataFrame) -> DataFrame:
    """One row per message, with the record's ``conv_id``, ``user_id`` and ``scene``.

    The expression itself is exploded, not a column holding it: for a column the
    optimizer adds a non-empty filter, and the JSON would be parsed twice.
    """
    rows = conversations.select(
        F.col("id").alias("conv_id"), "user_id", F.col("scene").alias("conv_scene"),
        F.posexplode(_messages_of()).alias("idx", "m"),
    )
    return rows.select("conv_id", "user_id", "conv_scene", "idx", "m.*")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def _has_trace(m: Column) -> Column:
    """A trace counts when it has any content."""
    t = m["trace"]
    return F.coalesce(t["run_id"], t["turn_id"], t["status"], t["model"], t["final_result"]).isNotNull()


def _meta_columns() -> list[Column]:
    times = F.filter(F.transform("messages", lambda m: m["created_at"]), lambda t: t != 0)
    asked = F.filter("messages", lambda m: (m["role"] == "user") & (F.length(m["content"]) > 0))
    first_ask = truncate_title(F.try_element_at(asked, F.lit(1))["content"])
    row_time = lambda c: F.coalesce(to_epoch_ms(F.col(c)), F.lit(0))
    return [
        F.col("scene"),
        F.when(F.length("title") > 0, F.col("title")).otherwise(first_ask).alias("title"),
        F.lit("active").alias("status"),
        F.size("messages").alias("msg_count"),
        _sum(F.transform("messages", lambda m: m["trace"]["total_tokens"])).alias("total_tokens"),
        F.when(F.size(times) > 0, F.array_min(times)).otherwise(row_time("created_at")).alias("first_at"),
        F.when(F.size(times) > 0, F.array_max(times)).otherwise(row_time("updated_at")).alias("last_at"),
    ]


def session_meta(conversations: DataFrame) -> DataFrame:
    """One summary row per record, computed inside the row."""
    return parse_records(conversations).select(
        F.col("id").cast("string").alias("conversation_id"),
        *_meta_columns(),
        F.coalesce(to_epoch_ms(F.col("created_at")), F.lit(0)).alias("created_at"),
    )


def session_meta_of_messages(messages: DataFrame, tokens: str | None = None) -> DataFrame:
    """The same roll-up from a message table ``(conv_id, idx, role, content, created_at)``."""
    asked = (F.col("role") == "user") & (F.length("content") > 0)
    at = F.when(F.col("created_at") != 0, F.col("created_at"))
    first = F.min_by(F.when(asked, F.col("content")), F.when(asked, F.col("idx")))
    return messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("msg_count"),
        F.coalesce(F.sum(tokens) if tokens else F.lit(None).cast("bigint"), F.lit(0)).alias("total_tokens"),
        truncate_title(first).alias("title"),
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
    )


# ---------------------------------------------------------------- scope
def is_admin(requester: object, admins: Sequence[object] = (), allow_admin_all: bool = False) -> bool:
    return allow_admin_all and str(requester) in {str(a) for a in admins}


def scope_filter(
    df: DataFrame, requester: object, admins: Sequence[object] = (), allow_admin_all: bool = False
) -> DataFrame:
    """Own rows, or all rows for an administrator; ids are compared as text."""
    if is_admin(requester, admins, allow_admin_all):
        return df
    return df.filter(F.col("user_id").cast("string") == str(requester))


def list_sessions(
    conversations: DataFrame,
    requester: object,
    user_id: object | None = None,
    scene: str | None = None,
    limit: int = 50,
    offset: int = 0,
    admins: Sequence[object] = (),
    allow_admin_all: bool = False,
) -> DataFrame:
    """Newest sessions first, one page. Others' sessions are empty for non-administrators."""
    rows = scope_filter(conversations, requester, admins, allow_admin_all)
    if is_admin(requester, admins, allow_admin_all):
        if user_id is not None:
            rows = rows.filter(F.col("user_id").cast("string") == str(user_id))
    elif user_id is not None and str(user_id) != str(requester):
        rows = rows.filter(F.lit(False))
    if scene:
        rows = rows.filter(F.col("scene") == scene)
    page = rows.orderBy(F.desc("updated_at"), F.asc("id")).offset(offset).limit(limit)
    return session_meta(page)


def _accessible(conversations: DataFrame, conv_id: object, requester, admins, allow_admin_all) -> DataFrame:
    """The asked record; an error when it exists but belongs to someone else."""
    row = conversations.filter(F.col("id").cast("string") == str(conv_id))
    owner = row.select(F.col("user_id").cast("string").alias("u")).first()
    if owner is not None and owner["u"] != str(requester) and not is_admin(requester, admins, allow_admin_all):
        raise AccessError(f"conversation {conv_id} belongs to another user")
    return row


_SHOWN = ("role", "content", "scene", "created_at", "agent", "avatar", "mention", "type")


def session_detail(conversations: DataFrame, with_trace: bool = True) -> DataFrame:
    """Meta data, messages and traces of each record."""
    records = parse_records(conversations)
    shown = F.transform(
        "messages",
        lambda m: F.struct(
            *[F.coalesce(m[c], F.lit(0)).alias(c) if c == "created_at" else m[c].alias(c) for c in _SHOWN]
        ),
    )
    traces = F.transform(F.filter("messages", _has_trace), lambda m: m["trace"])
    body = records.select(
        F.col("id").cast("string").alias("conversation_id"),
        F.struct(*_meta_columns()).alias("meta"),
        shown.alias("messages"),
        (traces if with_trace else F.lit(None).cast(T.ArrayType(TRACE))).alias("trace"),
    )
    return body.withColumn("has_trace", F.coalesce(F.size("trace") > 0, F.lit(False)))


def get_session(
    conversations: DataFrame, requester, conv_id, with_trace=True, admins: Sequence = (), allow_admin_all: bool = False
) -> DataFrame:
    return session_detail(_accessible(conversations, conv_id, requester, admins, allow_admin_all), with_trace)


# ---------------------------------------------------------------- events inside a record
def flatten_nodes(events: Column) -> Column:
    """JSON texts of nested events, depth first, as ``array<struct<depth, ...event fields>>``.

    One round per level opens the events of that level. A row has no more levels
    than the deepest of its texts has brackets, so the rounds end by themselves.
    """
    entry = T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("e", EVENT)])
    none = F.array().cast(T.ArrayType(entry))

    def read(texts: Column, depth: Column) -> Column:
        return F.transform(texts, lambda t: F.struct(depth.cast("int").alias("depth"), F.from_json(t, EVENT).alias("e")))

    def open_level(state: Column, depth: Column) -> Column:
        below = lambda x: F.when(x["depth"] == depth, F.coalesce(read(x["e"]["children"], depth + 1), none)).otherwise(none)
        return F.flatten(F.transform(state, lambda x: F.concat(F.array(x), below(x))))

    def node(x: Column) -> Column:
        return F.struct(x["depth"].alias("depth"), *[x["e"][name].alias(name) for name in EVENT_FIELDS])

    levels = F.coalesce(F.array_max(F.transform(events, _json_depth)), F.lit(0))
    opened = F.aggregate(F.sequence(F.lit(0), levels), read(events, F.lit(0)).cast(T.ArrayType(entry)), open_level)
    return F.transform(opened, node)


def _json_depth(text: Column) -> Column:
    """How deep arrays are nested in a JSON text."""
    brackets = F.split(F.regexp_replace(F.regexp_replace(text, _STRING, ""), r"[^\[\]]", ""), "")
    step = lambda s, c: F.struct(
        (s["now"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)).alias("now"),
        F.greatest(s["most"], s["now"] + F.when(c == "[", 1).otherwise(0)).alias("most"),
    )
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.coalesce(brackets, F.array().cast("array<string>")), zero, step, lambda s: s["most"])


def _flat_type() -> T.DataType:
    fields = [T.StructField("depth", T.IntegerType())] + [EVENT[name] for name in EVENT_FIELDS]
    return T.ArrayType(T.StructType(fields))


def turn_detail(conversations: DataFrame, turn_id: str | None = None) -> DataFrame:
    """Question, reply and flat events of turns; without ``turn_id``, of every traced turn."""
    rows = explode_messages(conversations).filter(F.col("trace.turn_id").isNotNull())
    if turn_id is not None:
        rows = rows.filter(F.col("trace.turn_id") == turn_id)
    flat = rows.select("conv_id", "idx", "trace", flatten_nodes(F.col("trace.events")).alias("events"))
    first = lambda kind, part: F.try_element_at(
        F.filter("events", lambda e: e["type"] == kind), F.lit(1)
    )[part]
    reply = F.coalesce(first("assistant", "summary_out"), F.get_json_object("trace.final_result", "$.reply"), F.lit(""))
    return (
        flat.groupBy(F.col("conv_id"), F.col("trace.turn_id").alias("turn_id"))
        .agg(F.min_by(F.struct("trace", "events"), "idx").alias("found"))
        .select("conv_id", "turn_id", F.col("found.trace").alias("trace"), F.col("found.events").alias("events"))
        .select(
            F.col("conv_id").cast("string").alias("conversation_id"),
            "turn_id",
            F.coalesce(first("user", "summary_in"), F.lit("")).alias("user_message"),
            reply.alias("assistant_reply"),
            "events",
            F.col("trace.final_result").alias("final_result"),
        )
    )


def _time_bound(value: float) -> int:
    return int(value if value > 1e11 else value * 1000)


def keyword_search(
    messages: DataFrame,
    requester: object,
    query: str = "",
    scene: str | None = None,
    start: float | None = None,
    end: float | None = None,
    limit: int = 20,
    admins: Sequence[object] = (),
    allow_admin_all: bool = False,
) -> DataFrame:
    """Newest messages that contain the words, as ``explode_messages`` gives them.

    A sorted limit keeps ``limit`` rows per task, so nothing else is shuffled.
    """
    rows = scope_filter(messages, requester, admins, allow_admin_all)
    if scene:
        rows = rows.filter(F.col("conv_scene") == scene)
    content = F.coalesce(F.col("content"), F.lit(""))
    at = F.coalesce(F.col("created_at"), F.lit(0))
    if query:
        rows = rows.filter(F.contains(F.lower(content), F.lit(query.lower())))
    if start is not None:
        rows = rows.filter(at >= _time_bound(start))
    if end is not None:
        rows = rows.filter(at <= _time_bound(end))
    turn = F.col("trace.turn_id") if "trace" in messages.columns else F.lit(None).cast("string")
    hits = rows.select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.coalesce(turn, F.lit("")).alias("turn_id"),
        F.col("idx").alias("event_id"),
        F.substring(content, 1, 200).alias("snippet"),
        F.lit(1.0).alias("score"),
        F.coalesce(F.col("role"), F.lit("")).alias("type"),
        at.alias("created_at"),
    )
    return hits.orderBy(F.desc("created_at"), "conversation_id", "event_id").limit(limit)


# ---------------------------------------------------------------- trace building
_STEP = "struct<agent:string,type:string,summary_in:string,summary_out:string,meta_json:string>"


def build_trace_events(results: DataFrame) -> DataFrame:
    """Run results -> event rows in order: question, reply, notes, flags, agent steps.

    ``results``: ``run_id, user_message, reply, compliance_notes, risk_flags, at``
    and ``steps array<struct<agent, type, content, meta_json>>``. Empty ones are dropped.
    """

    def event(agent: str, text: Column, inward: bool = False) -> Column:
        return F.struct(
            F.lit(agent).alias("agent"), F.lit(agent).alias("type"),
            (text if inward else F.lit("")).alias("summary_in"),
            (F.lit("") if inward else text).alias("summary_out"),
            F.lit("").alias("meta_json"),
        ).cast(_STEP)

    none = F.array().cast(f"array<{_STEP}>")
    filled = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.length(x) > 0)
    steps = F.transform(
        "steps",
        lambda s: F.struct(
            F.coalesce(s["agent"], F.lit("")).alias("agent"), F.coalesce(s["type"], F.lit("")).alias("type"),
            F.lit("").alias("summary_in"), F.coalesce(s["content"], F.lit("")).alias("summary_out"),
            F.coalesce(s["meta_json"], F.lit("{}")).alias("meta_json"),
        ).cast(_STEP),
    )
    events = F.concat(
        F.transform(filled(F.array("user_message")), lambda x: event("user", x, inward=True)),
        F.transform(filled(F.array("reply")), lambda x: event("assistant", x)),
        F.transform(filled(F.col("compliance_notes")), lambda x: event("review", x)),
        F.transform(filled(F.col("risk_flags")), lambda x: event("risk", x)),
        F.coalesce(steps, none),
    )
    rows = results.select("run_id", F.col("at").alias("created_at"), F.posexplode(events).alias("seq", "e"))
    return rows.select("run_id", "seq", "e.*", "created_at")


def flatten_event_table(events: DataFrame) -> DataFrame:
    """``(run_id, id, parent_id, seq)`` -> adds ``root_id``, ``depth`` and ``path``; one row per row.

    An event without a known parent is a root. ``path`` lists the ``seq`` of all
    ancestors and its own, so sorting by it is depth-first order. Of a repeated id,
    children hang under the row with the largest ``seq``. Events on a cycle, or
    below one, have no root: their ``root_id``, ``depth`` and ``path`` are null.

    By doubling: a row knows an ancestor and the path from there; each round puts
    the ancestor's own ancestor and path in front, so all rows of depth less than
    2^k are placed after k rounds. A round that places no row leaves cycles only.
    """
    rows = cut_lineage(events.select("run_id", "id", "parent_id", "seq").withColumn("_row", F.monotonically_increasing_id()))
    parents = rows.groupBy("run_id", F.col("id").alias("parent_id")).agg(F.max_by("_row", F.struct("seq", "_row")).alias("_up"))
    linked = cut_lineage(
        rows.join(parents, ["run_id", "parent_id"], "left").select(
            "_row", "_up", F.col("_up").isNotNull().cast("int").alias("depth"), F.array("seq").alias("path"),
            F.when(F.col("_up").isNull(), F.col("id")).alias("root_id"),
        )
    )
    placed, open_ = linked.where("_up IS NULL"), linked.where("_up IS NOT NULL")
    left = open_.count()
    while left:
        upper = placed.unionByName(open_).toDF("_at", "_next", "_steps", "_above", "_root")
        moved = cut_lineage(
            open_.join(upper, F.col("_up") == F.col("_at")).select(
                "_row", F.col("_next").alias("_up"), (F.col("depth") + F.col("_steps")).alias("depth"), F.concat("_above", "path").alias("path"),
                F.col("_root").alias("root_id"),
            )
        )
        placed, open_ = placed.unionByName(moved.where("_up IS NULL")), moved.where("_up IS NOT NULL")
        before, left = left, open_.count()
        if left == before:
            break
    return rows.join(placed.drop("_up"), "_row", "left").select("run_id", "id", "parent_id", "seq", "root_id", "depth", "path")


# ---------------------------------------------------------------- writing runs and turns
# Texts of a trace that name things and stay as they are.
KEPT_KEYS = ("run_id", "turn_id", "id", "parent_event_id", "agent", "type", "model", "status", "role", "scene")

#: Possessive, so that long texts are matched in a loop and not by recursion.
_STRING = r'"(?:[^"\\]++|\\(?s:.))*+"'
#: A key with its text, a key, a text, or what stands between.
_JSON_PARTS = rf'{_STRING}\s*:\s*{_STRING}|{_STRING}\s*:|{_STRING}|[^"]+|"'


def redact_json(text: Column, kept: Sequence[str] = KEPT_KEYS) -> Column:
    """JSON text with its string values masked, at any depth and under any key but ``kept``.

    Keys, numbers and structure stay as they are written; values with escapes are
    read, masked and written again.
    """
    keys = "|".join(kept)

    def value(token: Column) -> Column:
        plain = F.from_json(F.concat(F.lit('{"v":'), token, F.lit("}")), F.lit("v string"))["v"]
        written = F.to_json(F.struct(F.coalesce(redact_text(plain), F.lit("")).alias("v")))
        escaped = F.substring(written, F.lit(6), F.length(written) - 6)
        return F.when(F.contains(token, F.lit("\\")), F.when(plain.isNull(), redact_text(token)).otherwise(escaped)).otherwise(redact_text(token))

    def part(token: Column) -> Column:
        key = F.regexp_extract(token, rf"^({_STRING}\s*:\s*)", 1)
        return (
            F.when(token.rlike(rf'^"({keys})"\s*:'), token)
            .when(token.rlike(rf"(?s)^{_STRING}\s*:\s*{_STRING}$"), F.concat(key, value(F.substring(token, F.length(key) + 1, F.length(token)))))
            .when(token.rlike(rf"(?s)^{_STRING}$"), value(token))
            .otherwise(token)
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_JSON_PARTS), F.lit(0)), part), "")


def redact_trace(trace: Column, record_events: bool = True) -> Column:
    """A trace as JSON text with its texts masked, whatever its depth and fields; other text is masked whole.

    Without ``record_events`` only the head of the trace is kept.
    """
    head = T.StructType([f for f in TRACE.fields if f.name != "events"])
    parsed = F.from_json(trace, head, {"allowSingleQuotes": "false"})
    if record_events:
        known = F.when(parsed["run_id"].isNotNull(), redact_json(trace))
        return F.coalesce(known, redact_text(trace))

    def rebuilt(t: Column) -> Column:
        fields = [t[f.name].alias(f.name) for f in head.fields if f.name != "final_result"]
        none = F.array().cast("array<string>").alias("events")
        return F.struct(*fields, redact_text(t["final_result"]).alias("final_result"), none)

    known = F.transform(F.array(parsed), lambda t: F.when(t["run_id"].isNotNull(), F.to_json(rebuilt(t))))
    return F.coalesce(F.get(known, F.lit(0)), redact_text(trace))


def redact_runs(runs: DataFrame, record_events: bool = True) -> DataFrame:
    """Runs ``(reply, trace)`` as they may be stored."""
    return runs.withColumns(
        {"reply": redact_text(F.col("reply")), "trace": redact_trace(F.col("trace"), record_events)}
    )


def _take_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation its free messages, last first, then its runs in order of time -> (_row, idx) of runs that take one.

    A free message whose time has come for one run stays taken for all later
    runs, so both are walked once.
    """
    now: tuple = ()
    free: list[tuple] = []  # (idx, time of the first matching run), the last message at the end
    reverse = False
    for batch in batches:
        rows, places = [], []
        for conv, kind, idx, at, run_id, row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
            if now != (conv,):
                now, free, reverse = (conv,), [], True
            if kind == 0:
                free.append((idx, None if run_id is None and at is None else (at, run_id)))
                continue
            if reverse:
                free.reverse()
                reverse = False
            while free and free[-1][1] is not None and free[-1][1] <= (at, run_id):
                free.pop()
            if free:
                rows.append(row)
                places.append(free.pop()[0])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(places, batch.schema.field("idx").type)], ["_row", "idx"])


def attach_traces(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """Hang each run's trace on the assistant message it belongs to.

    ``messages(conv_id, idx, role, content, created_at, trace)`` and
    ``runs(conv_id, run_id, at, reply, trace)``, both traces as JSON text. In order
    of time a run takes the last assistant message with the same text, else the
    last assistant message without a trace, else it appends a new message; a later
    run may overwrite.

    Runs with a matching message do not depend on each other: one join and one
    aggregate place them all. The others and the messages they may take meet, as
    numbers without texts, in one ordered pass over each conversation. The number
    of jobs does not depend on the number of runs.
    """
    replies = (
        messages.filter(F.col("role") == "assistant")
        .select("conv_id", "idx", F.coalesce("content", F.lit("")).alias("reply"), F.col("trace").isNotNull().alias("traced"))
    )
    targets = replies.groupBy("conv_id", "reply").agg(F.max("idx").alias("idx"))
    timed = runs.withColumn("reply", F.coalesce("reply", F.lit(""))).join(targets, ["conv_id", "reply"], "left")
    timed = cut_lineage(timed.withColumn("_row", F.monotonically_increasing_id()))
    stamp = F.struct("at", "run_id")
    exact = timed.filter(F.col("idx").isNotNull())
    taken_from = exact.groupBy("conv_id", "idx").agg(F.min(stamp).alias("taken_at"))
    # Messages that some unmatched run may still take, and until when.
    pending = timed.filter(F.col("idx").isNull()).drop("idx")
    free = (
        replies.filter(~F.col("traced"))
        .join(pending.select("conv_id").distinct(), "conv_id", "left_semi")
        .join(taken_from, ["conv_id", "idx"], "left")
        .select("conv_id", F.lit(0).alias("kind"), "idx", "taken_at.at", "taken_at.run_id", F.lit(None).cast("long").alias("_row"))
    )
    asking = pending.select(
        "conv_id", F.lit(1).alias("kind"), F.lit(None).cast(messages.schema["idx"].dataType).alias("idx"), "at", "run_id", "_row"
    )
    ordered = free.unionByName(asking).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.desc("idx"), "at", "run_id")
    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("idx", messages.schema["idx"].dataType)])
    choice = cut_lineage(ordered.mapInArrow(_take_free, schema))
    written = exact.select("conv_id", "idx", stamp.alias("stamp"), "trace").unionByName(
        pending.join(choice, "_row").select("conv_id", "idx", stamp.alias("stamp"), "trace")
    )
    # Without a free message, a run appends; and so do all later ones of its conversation.
    appended = pending.join(choice, "_row", "left_anti")
    final = written.groupBy("conv_id", "idx").agg(F.max_by("trace", "stamp").alias("_new"))
    updated = messages.join(final, ["conv_id", "idx"], "left").withColumn("trace", F.coalesce("_new", "trace")).drop("_new")
    last = messages.groupBy("conv_id").agg(F.max("idx").alias("_last"))
    groups = appended.groupBy("conv_id", "reply").agg(F.min("at").alias("first_at"), F.max_by("trace", stamp).alias("trace"))
    grown = (
        rank_in_group(groups, ["conv_id"], "first_at", "reply", "_no", span=3_600_000)
        .join(last, "conv_id", "left")
        .select(
            "conv_id",
            (F.coalesce("_last", F.lit(-1)) + F.col("_no")).cast(messages.schema["idx"].dataType).alias("idx"),
            F.lit("assistant").alias("role"), F.col("reply").alias("content"),
            F.col("first_at").cast(messages.schema["created_at"].dataType).alias("created_at"), "trace",
        )
    )
    return updated.unionByName(grown, allowMissingColumns=True)


def append_turns(turns: DataFrame) -> DataFrame:
    """Chat turns -> new message rows ``(conv_id, at, seq, ...)`` in the order they are appended.

    ``turns(conv_id, at, message, reply, scene, agent_messages)``: the question at
    ``at``, agent messages one millisecond apart after it, and the reply only when
    no agent message is the assistant's already.
    """
    agents = F.coalesce("agent_messages", F.array().cast(turns.schema["agent_messages"].dataType))
    text = "struct<role:string,content:string,agent:string,avatar:string,mention:string,type:string>"

    def plain(role: str, content: Column) -> Column:
        nothing = F.lit(None).cast("string")
        return F.struct(
            F.lit(role).alias("role"), content.alias("content"), nothing.alias("agent"), nothing.alias("avatar"),
            nothing.alias("mention"), nothing.alias("type"),
        ).cast(text)

    shown = F.transform(
        agents,
        lambda m: F.struct(
            F.coalesce(m["role"], F.lit("agent")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"),
            m["agent"].alias("agent"), m["avatar"].alias("avatar"), m["mention"].alias("mention"), m["type"].alias("type"),
        ).cast(text),
    )
    answered = F.exists(agents, lambda m: m["role"] == "assistant")
    reply = F.when(answered, F.array().cast(f"array<{text}>")).otherwise(F.array(plain("assistant", F.col("reply"))))
    everything = F.concat(F.array(plain("user", F.col("message"))), shown, reply)
    rows = turns.select("conv_id", "at", "scene", F.posexplode(everything).alias("seq", "m"))
    return rows.select("conv_id", "at", "seq", "m.*", "scene", (F.col("at") + F.col("seq")).alias("created_at"))


def touch_conversations(headers: DataFrame, turns: DataFrame) -> DataFrame:
    """Conversation headers after their turns: created when missing, titled by the first question."""
    news = turns.groupBy("conv_id").agg(
        F.max("at").alias("_at"), F.min("at").alias("_from"),
        F.min_by("user_id", "at").alias("_user"), F.min_by("scene", "at").alias("_scene"),
        F.min_by(F.substring("message", 1, 50), F.when(F.length("message") > 0, F.col("at"))).alias("_title"),
    )
    joined = headers.join(news, headers["id"] == news["conv_id"], "full")
    return joined.select(
        F.coalesce("id", "conv_id").alias("id"),
        F.coalesce("user_id", "_user").alias("user_id"),
        F.when(F.col("id").isNull(), F.col("_scene")).otherwise(F.col("scene")).alias("scene"),
        F.when(F.length("title") > 0, F.col("title")).otherwise(F.col("_title")).alias("title"),
        F.coalesce("created_at", "_from").alias("created_at"),
        F.coalesce("_at", "updated_at").alias("updated_at"),
    )


# ---------------------------------------------------------------- export
def render_export(details: DataFrame) -> DataFrame:
    """``(conversation_id, document)``: one markdown document per ``session_detail`` row."""
    dash = lambda c: F.when(F.length(c) > 0, c).otherwise(F.lit("—"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    lines = lambda *items: F.array(*[F.lit(i) if isinstance(i, str) else i for i in items])
    head = lines(
        "# 会话复盘文档", "",
        F.concat(F.lit("- 会话 ID：`"), F.col("conversation_id"), F.lit("`")),
        F.concat(F.lit("- 场景："), dash(F.col("meta.scene"))),
        F.concat(F.lit("- 标题："), dash(F.col("meta.title"))),
        F.concat(F.lit("- 状态："), F.col("meta.status")),
        F.concat(
            F.lit("- 消息数："), text(F.col("meta.msg_count")), F.lit("　累计 token："), text(F.col("meta.total_tokens"))
        ),
        "", "## 主消息流", "",
    )
    talk = F.transform(
        "messages", lambda m: F.concat(F.lit("**"), text(m["role"]), F.lit("**："), text(m["content"]))
    )

    def event_lines(e: Column) -> Column:
        pad = F.repeat(F.lit("  "), e["depth"])
        extra = lambda label, c: F.when(F.length(c) > 0, F.concat(pad, F.lit(f"  - {label}："), c))
        first = F.concat(pad, F.lit("- ["), text(e["type"]), F.lit("] "), F.coalesce(e["agent"], F.lit("")))
        return F.array_compact(
            F.array(
                first, extra("输入", e["summary_in"]), extra("输出", e["summary_out"]), extra("结构化", e["meta_json"])
            )
        )

    def run_lines(t: Column) -> Column:
        title = F.concat(
            F.lit("### run `"), F.substring(t["run_id"], 1, 8), F.lit("` · model="), text(t["model"]), F.lit(" · 耗时 "),
            text(t["duration_ms"]), F.lit("ms · token "), text(t["total_tokens"]), F.lit(" · 状态 "), text(t["status"]),
        )
        events = F.coalesce(flatten_nodes(t["events"]), F.array().cast(_flat_type()))
        return F.concat(F.array(title), F.flatten(F.transform(events, event_lines)))

    traced = F.when(
        F.col("has_trace"),
        F.concat(lines("## 执行轨迹（trace）", ""), F.flatten(F.transform("trace", run_lines))),
    ).otherwise(F.array().cast("array<string>"))
    document = F.array_join(F.concat(head, talk, lines(""), traced, lines("")), "\n")
    return details.select("conversation_id", document.alias("document"))


def export_json(details: DataFrame) -> DataFrame:
    """The same as JSON text; absent values stay as null. Events are written as they are stored, at any depth."""
    head = F.struct("conversation_id", "meta", "messages")

    def run(t: Column) -> Column:
        fields = F.to_json(F.struct(*[t[f.name].alias(f.name) for f in TRACE.fields if f.name != "events"]), _NO_NULLS)
        events = F.concat(F.lit("["), F.array_join(t["events"], ",", "null"), F.lit("]"))
        return F.concat(F.substring(fields, F.lit(1), F.length(fields) - 1), F.lit(',"events":'), F.coalesce(events, F.lit("null")), F.lit("}"))

    runs = F.coalesce(F.concat(F.lit("["), F.array_join(F.transform("trace", run), ","), F.lit("]")), F.lit("null"))
    start = F.to_json(head, _NO_NULLS)
    document = F.concat(
        F.substring(start, F.lit(1), F.length(start) - 1), F.lit(',"trace":'), runs, F.lit(',"has_trace":'), F.col("has_trace").cast("string"), F.lit("}")
    )
    return details.select("conversation_id", document.alias("document"))


def review_context(details: DataFrame) -> DataFrame:
    """``(conversation_id, context)``: the user's requests and every agent conclusion."""
    known = lambda c: F.when(F.length(c) > 0, c).otherwise(F.lit("未知"))
    asks = F.transform(
        F.filter("messages", lambda m: m["role"] == "user"),
        lambda m: F.concat(F.lit("- "), F.coalesce(m["content"], F.lit(""))),
    )

    def conclusion(e: Column) -> Column:
        said = F.coalesce(F.nullif(e["summary_out"], F.lit("")), F.nullif(e["summary_in"], F.lit("")), F.lit(""))
        meta = lambda key: F.coalesce(F.get_json_object(e["meta_json"], f"$.{key}"), F.lit("None"))
        source = F.when(
            (e["type"] == "rag_hit") & (F.length(e["meta_json"]) > 2),
            F.concat(F.lit("（溯源："), meta("doc_id"), F.lit(" / "), meta("title"), F.lit(" / score="), meta("score"), F.lit("）")),
        ).otherwise(F.lit(""))
        return strip(
            F.concat(
                F.lit("- ["), F.coalesce(e["type"], F.lit("None")), F.lit("/"), F.coalesce(e["agent"], F.lit("")), F.lit("] "), said,
                F.lit(" "), source,
            )
        )

    events = F.flatten(F.transform("trace", lambda t: F.coalesce(flatten_nodes(t["events"]), F.array().cast(_flat_type()))))
    told = F.transform(
        F.filter(F.coalesce(events, F.array().cast(_flat_type())), lambda e: ~F.coalesce(e["type"], F.lit("")).isin("user", "assistant")),
        conclusion,
    )
    head = F.array(
        F.lit("【会话复盘上下文】"),
        F.concat(F.lit("场景："), known(F.col("meta.scene")), F.lit("；标题："), known(F.col("meta.title"))),
        F.lit("\n=== 用户诉求 ==="),
    )
    middle = F.array(F.lit("\n=== 各智能体结论 / RAG 依据 / 审核风控 ==="))
    return details.select("conversation_id", F.array_join(F.concat(head, asks, middle, told), "\n").alias("context"))
