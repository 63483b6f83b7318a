"""Schemas of the records the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

#: One event of a stored trace; ``children`` are the JSON texts of the events below it, so nothing limits the levels.
EVENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("parent_event_id", T.LongType()),
        T.StructField("agent", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("summary_in", T.StringType()),
        T.StructField("summary_out", T.StringType()),
        T.StructField("meta_json", T.StringType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("children", T.ArrayType(T.StringType())),
    ]
)
EVENT_FIELDS = [f.name for f in EVENT.fields if f.name != "children"]

TRACE = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("turn_id", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("final_result", T.StringType()),  # JSON text
        T.StructField("events", T.ArrayType(T.StringType())),  # JSON text of each root
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("scene", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("agent", T.StringType()),
        T.StructField("avatar", T.StringType()),
        T.StructField("mention", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("trace", TRACE),
    ]
)

CONVERSATION_DATA = T.StructType([T.StructField("messages", T.ArrayType(MESSAGE))])

CHAT_MESSAGES = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)

STREAM_EVENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("agent", T.StringType()),
        T.StructField("avatar", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("mention", T.StringType()),
        T.StructField("scene", T.StringType()),
        T.StructField("reply", T.StringType()),
        T.StructField("conversation_id", T.LongType()),
        T.StructField("detail", T.StringType()),
    ]
)

GRAPH_REPLY = T.StructType(
    [
        T.StructField(
            "nodes",
            T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("type", T.StringType())])),
        ),
        T.StructField(
            "edges",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("source", T.StringType()),
                        T.StructField("target", T.StringType()),
                        T.StructField("label", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)
