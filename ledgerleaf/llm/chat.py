"""Chat formatting with loss masks from token offsets.

A conversation becomes one string: every turn stands between control strings
that the tokenizer knows as single tokens,

    <|im_start|>role<|im_sep|>text<|im_end|>\\n

Inside roles and texts, control strings are escaped: of every ``<``, any number
of ``\\``, ``|`` one ``\\`` is added, so no text can end a turn, and taking one
away gives the text back. The string is encoded once, with the character offsets
of its tokens. Both the spans of the assistant's texts and those of the tokens
are in order, so the tokens of a span are found by two binary searches.

Rows are put in order by range partitions of (conversation, turn), so a
conversation of any size is spread over tasks. One that a partition ends inside,
or longer than ``SEGMENT_CHARS``, is given out in several segments cut between
turns: control tokens end every merge, so the segments' tokens are those of the
whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer, processors

from ledgerleaf.llm.bpe import enumerate_pieces
from ledgerleaf.llm.common import stored

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
SEGMENT_CHARS, BATCH_CHARS = 1 << 19, 1 << 18

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    """``text`` without control strings."""
    return _CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    """What ``escape`` was given."""
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def rendered(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn as it is written, and where its text begins and ends; nulls count as empty."""
    head = START + escape(role or "") + SEP
    body = escape(text or "")
    return head + body + END + "\n", len(head), len(head) + len(body)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted string."""
    at = 0
    for turn in _TURN.finditer(formatted):
        if turn.start() != at:
            break
        at = turn.end()
        yield unescape(turn[1]), unescape(turn[2])
    if at != len(formatted):
        raise ValueError("not a sequence of turns")


def chat_tokenizer(tokenizer_json: str) -> Tokenizer:
    """The tokenizer with the control strings as tokens of their own, and offsets that leave out no character."""
    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.add_special_tokens([START, SEP, END])
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens overlap a span; tokens and spans in order, both as (start, end)."""
    steps = np.zeros(len(offsets) + 1, np.int64)
    if len(spans):
        np.add.at(steps, np.searchsorted(offsets[:, 1], spans[:, 0], side="right"), 1)
        np.add.at(steps, np.searchsorted(offsets[:, 0], spans[:, 1], side="left"), -1)
    return np.cumsum(steps[:-1]) > 0


class _Segment:
    def __init__(self, conv_id, turn, place: int):
        self.conv_id, self.turn, self.place = conv_id, turn, place
        self.pieces: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.chars, self.turns, self.whole = 0, 0, True

    def add(self, role: str | None, text: str | None, trained: str) -> None:
        piece, start, end = rendered(role, text)
        if role == trained:
            self.spans.append((self.chars + start, self.chars + end))
        self.pieces.append(piece)
        self.chars += len(piece)
        self.turns += 1


def _format(tokenizer_json: str, schema: T.StructType, trained: str, segment_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chat_tokenizer(tokenizer_json)
        part = TaskContext.get().partitionId()
        waiting: list[_Segment] = []
        conv_kind = turn_kind = None

        def encoded() -> pa.RecordBatch:
            texts = ["".join(s.pieces) for s in waiting]
            ids, masks = [], []
            for segment, encoding in zip(waiting, tokenizer.encode_batch(texts, add_special_tokens=False)):
                offsets = np.array(encoding.offsets, np.int64).reshape(-1, 2)
                ids.append(np.array(encoding.ids, np.int32))
                masks.append(loss_mask(offsets, np.array(segment.spans, np.int64).reshape(-1, 2)))
            bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
            made = [
                pa.array([s.conv_id for s in waiting], conv_kind), pa.array([part] * len(waiting), pa.int32()),
                pa.array([s.place for s in waiting], pa.int64()), pa.array([s.whole for s in waiting]),
                pa.array([s.turn for s in waiting], turn_kind), pa.array([s.turns for s in waiting], pa.int64()), pa.array(texts, pa.string()),
                pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(ids))), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(masks))),
            ]
            return pa.RecordBatch.from_arrays(made, [f.name for f in schema.fields])

        open_: _Segment | None = None
        place, alone = 0, False  # the first conversation may have begun in the partition before
        for batch in batches:
            conv_kind, turn_kind = batch.column("conv_id").type, batch.column("turn").type
            for conv_id, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                same = open_ is not None and open_.conv_id == conv_id
                if same and open_.chars >= segment_chars:
                    open_.whole = alone = False
                if open_ is None or not same or open_.chars >= segment_chars:
                    if open_ is not None:
                        if not same and not alone:
                            open_.whole = False
                        waiting.append(open_)
                        alone = alone if same else True
                        if sum(s.chars for s in waiting) >= BATCH_CHARS or len(waiting) >= 1000:
                            yield encoded()
                            waiting.clear()
                    open_ = _Segment(conv_id, turn, place)
                    place += 1
                open_.add(role, text, trained)
        if open_ is not None:
            open_.whole = False  # it may go on in the next partition
            waiting.append(open_)
        if waiting:
            yield encoded()

    return run


def format_chats(turns: DataFrame, tokenizer_path: str, trained: str = "assistant", segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, part, place, whole, first_turn, n_turns, formatted, ids, loss.

    One row for each conversation; several, in the order of (part, place), where
    one is cut into segments. ``whole`` marks rows that surely stand alone.
    ``loss`` has one flag for each id: true inside texts of the role ``trained``.

    Turns go by turn, null first; equal turns by a digest of role and text, so
    reruns agree. Null roles and texts count as empty; an empty text has no
    tokens under the mask. Rows with a null conv_id form one conversation;
    repeated rows are turns of their own; other columns are not read. An empty
    table gives an empty result.
    """
    slim = turns.select("conv_id", "turn", "role", "text", F.xxhash64("role", "text").alias("tie"))
    order = ["conv_id", "turn", "tie"]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([
        slim.schema["conv_id"], *T.StructType.fromDDL("part int, place long, whole boolean").fields,
        T.StructField("first_turn", slim.schema["turn"].dataType),
        *T.StructType.fromDDL("n_turns long, formatted string, ids array<int>, loss array<boolean>").fields,
    ])
    return ordered.drop("tie").mapInArrow(_format(Path(tokenizer_path).read_text(), schema, trained, segment_chars), schema)


def _read(tokenizer_json: str, schema: T.StructType):
    """Digests of conversations from their segments; segments of one stand together, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = enumerate_pieces(tokenizer_json)
        none = object()
        conv_id, kind, state = none, None, None

        def row():
            return conv_id, state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"]

        def table(rows):
            columns = list(zip(*rows))
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.name for f in schema.fields])

        for batch in batches:
            kind, done = batch.column("conv_id").type, []
            ids, loss = batch.column("ids"), batch.column("loss")
            for i, (key, formatted) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist())):
                if conv_id is none or key != conv_id:
                    if conv_id is not none:
                        done.append(row())
                    conv_id, state = key, {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                for role, text in turns_of(formatted):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                state["formatted"] += len(formatted)
                own, mask = np.asarray(ids[i].values), np.asarray(loss[i].values.cast(pa.int8()))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
                for start, end in edges.reshape(-1, 2).tolist():
                    text = unescape(b"".join([pieces[x] for x in own[start:end].tolist()]).decode())
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
            if done:
                yield table(done)
        if conv_id is not none:
            yield table([row()])

    return run


def read_back(chats: DataFrame, tokenizer_path: str) -> DataFrame:
    """Rows of ``format_chats`` -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are parsed from ``formatted``; texts under the mask are decoded from
    ``ids``. Only conversations in several segments, or at a partition's edge,
    are shuffled; those are read as a stream, so a long one needs little memory.
    """
    fields = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = T.StructType([chats.schema["conv_id"], *T.StructType.fromDDL(fields).fields])
    read = _read(Path(tokenizer_path).read_text(), schema)
    kept = chats.select("conv_id", "part", "place", "whole", "formatted", "ids", "loss")
    cut = kept.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    use = ("conv_id", "formatted", "ids", "loss")
    return kept.where("whole").select(*use).mapInArrow(read, schema).union(cut.select(*use).mapInArrow(read, schema))


def chat_report(turns: DataFrame, tokenizer_path: str, **how) -> DataFrame:
    """Conversations formatted, written, and read back."""
    return read_back(stored(format_chats(turns, tokenizer_path, **how), "chats"), tokenizer_path)
