"""Files with names and shapes that the tables do not hold."""

import json

from pyspark.sql import functions as F

from ledgerleaf.operators.history import redact_trace
from ledgerleaf.sources.chat_json import read_chat_json
from ledgerleaf.sources.files import dispatch_by_extension, scan_corpus


def test_names_are_kept(spark, tmp_path):
    names = ["my doc.md", "50%.txt", "a+b.txt", "养老.md", "x%20y.txt"]
    for name in names:
        (tmp_path / name).write_text("text")
    assert {r.doc_id for r in scan_corpus(spark, str(tmp_path)).collect()} == set(names)


def test_zipped_word_files_are_error_rows(spark):
    rows = [("a.docx", bytearray(b"PK\x03\x04" + "养老".encode("utf-16-le")), None), ("b.docx", bytearray(b"PK\x03\x04zip"), "read elsewhere"), ("c.doc", bytearray("养老理财".encode("utf-16-le")), None)]
    files = spark.createDataFrame(rows, "filename string, content binary, extracted string")
    got = {r.filename: (r.text, r.error is None) for r in dispatch_by_extension(files).collect()}
    assert got["a.docx"][1] is False and got["b.docx"] == ("read elsewhere", True) and got["c.doc"] == ("养老理财", True)


def test_chat_files_are_judged_one_by_one(spark, tmp_path):
    message = lambda c: {"role": "user", "content": c}
    (tmp_path / "lists.jsonl").write_text("\n".join(json.dumps([message(c)]) for c in "ab"))
    (tmp_path / "one.jsonl").write_text(json.dumps([message("c"), message("d")]))
    (tmp_path / "array.json").write_text(json.dumps([{"messages": [message("e")]}, [message("f")]], indent=1))
    (tmp_path / "flat.json").write_text(json.dumps([{"messages": [message("g")]}]))
    (tmp_path / "lines.jsonl").write_text(json.dumps({"messages": [message("h")]}) + "\nnot json\n")
    got = read_chat_json(spark, str(tmp_path)).collect()
    assert sorted("".join(m.content for m in r.messages) for r in got if r.messages) == ["a", "b", "cd", "e", "f", "g", "h"]
    assert [r.error for r in got if not r.messages] == ["not json"]


def test_deep_traces_lose_nothing(spark):
    event = {"id": 12, "summary_out": "call 13800138000", "extra": {"list": ["x@y.com", 13800138000]}, "children": []}
    for level in range(11):
        event = {"id": level, "type": "t", "note": 'quoted " \\ 13800138000', "children": [event]}
    trace = {"run_id": "e13800138000f", "events": [event], "final_result": {"reply": "13800138000"}, "unknown": True}
    text = spark.range(1).select(redact_trace(F.lit(json.dumps(trace, ensure_ascii=False)))).first()[0]
    got = json.loads(text)
    assert got["run_id"] == "e13800138000f" and got["unknown"] is True and "13800138000" not in got["final_result"]["reply"]
    deep, levels = got["events"][0], 0
    while deep["children"]:
        assert deep["note"].startswith('quoted " \\ 138') and "13800138000" not in deep["note"]
        deep, levels = deep["children"][0], levels + 1
    assert levels == 11 and deep["extra"]["list"][1] == 13800138000 and "x@y.com" not in deep["extra"]["list"][0] and "13800138000" not in deep["summary_out"]
