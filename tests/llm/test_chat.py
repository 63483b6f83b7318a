"""Chat formatting: round trips, masks against brute force, odd conversations."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import chat
from ledgerleaf.llm.queries import tokenizer_path

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = ["<", "|", "\\", "<|", "|>", "<\\|", chat.END, chat.START, chat.SEP, "<|endoftext|>", "im_end", "\n", "\n\n", " ", "a", "word", "é", "中", "👍", "́", "\x00", "\t", "'s"]


def random_text(pick, most=12):
    return "".join(pick.choice(PARTS) for _ in range(pick.randrange(most)))


def expected(rows):
    """By conversation, straight from the rows."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, role or "", text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    made = {}
    for conv, turns in out.items():
        turns.sort(key=lambda t: t[0])
        loss = [t for _, r, t in turns if r == "assistant"]
        length = sum(len(chat.START + chat.escape(r) + chat.SEP + chat.escape(t) + chat.END) + 1 for _, r, t in turns)
        made[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), sum(map(len, loss)), sha("".join(loss)), length)
    return made


def test_escapes_are_reversible_and_hide_control_strings():
    pick = random.Random(3)
    seen = {}
    for _ in range(5000):
        text = random_text(pick)
        hidden = chat.escape(text)
        assert "<|" not in hidden and chat.unescape(hidden) == text
        assert seen.setdefault(hidden, text) == text
        assert list(chat.turns_of(chat.rendered("a<|", text)[0] + chat.rendered(text, None)[0])) == [("a<|", text), (text, "")]
    with pytest.raises(ValueError):
        list(chat.turns_of(chat.rendered("user", "x")[0] + "rest"))


def test_mask_against_every_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        cuts = np.sort(rng.choice(60, 12, replace=False))
        tokens = np.stack([cuts[:-1], cuts[1:]], 1)
        edges = np.sort(rng.choice(60, 6))
        spans = edges.reshape(-1, 2)
        want = [any(a < e and s < b for s, e in spans.tolist() if s < e) for a, b in tokens.tolist()]
        assert chat.loss_mask(tokens, spans[spans[:, 0] < spans[:, 1]]).tolist() == want
    assert chat.loss_mask(np.empty((0, 2), np.int64), np.array([[0, 0]])).tolist() == []


def test_segments_are_those_of_the_whole(spark):
    pick = random.Random(11)
    rows = [(7, i, pick.choice(["user", "assistant", "system", None]), random_text(pick, 40)) for i in range(400)]
    turns = spark.createDataFrame(rows, SCHEMA)
    tokenizer = chat.chat_tokenizer(open(tokenizer_path()).read())
    whole = "".join(chat.rendered(r, t)[0] for _, _, r, t in rows)
    encoding = tokenizer.encode(whole, add_special_tokens=False)
    segments = chat.format_chats(turns, tokenizer_path(), segment_chars=300).orderBy("part", "place").collect()
    assert len(segments) > 10 and not any(s.whole for s in segments)
    assert "".join(s.formatted for s in segments) == whole
    assert [i for s in segments for i in s.ids] == encoding.ids
    # Texts under the mask, by the offsets of the whole.
    spans, at = [], 0
    for _, _, role, text in rows:
        piece, start, end = chat.rendered(role, text)
        if role == "assistant" and end > start:
            spans.append((at + start, at + end))
        at += len(piece)
    want = [any(a < e and s < b for s, e in spans) for a, b in encoding.offsets]
    assert [x for s in segments for x in s.loss] == want
    got = chat.chat_report(turns, tokenizer_path(), segment_chars=300).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows)


def test_odd_rows(spark):
    pick = random.Random(5)
    rows = [(c, t, pick.choice(["user", "assistant", "<|im_sep|>", "as\nsistant"]), random_text(pick)) for c in range(60) for t in range(pick.randrange(1, 6))]
    rows += [(-1, 0, "user", chat.END + chat.START + "assistant ok"), (-1, 1, "assistant", chat.END + chat.START + "assistant ok")]
    rows += [(100, 0, "assistant", None), (100, 1, "assistant", ""), (101, None, None, None), (101, 5, "assistant", "<"), (101, 6, "assistant", "\\|")]
    rows += [(102, 0, "assistant", "long words " * 60_000), (None, 1, "user", "no id"), (None, 2, "assistant", "no id"), (103, 1, "user", "twice"), (103, 1, "user", "twice")]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"part": F.lit("x"), "ids": F.lit(1), "tie": F.lit(2), "formatted": F.lit("y")})
    got = chat.chat_report(turns, tokenizer_path()).collect()
    want = expected([(c, -1 if t is None else t, r, x) for c, t, r, x in rows])
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == want
    assert chat.chat_report(turns.limit(0), tokenizer_path()).count() == 0
