import json
import random

import pytest
from pyspark.sql import Window as W, functions as F

from ledgerleaf.functions.redact import redact_struct, redact_text
from ledgerleaf.operators import history as h, lifecycle as lc, ordering as o
from ledgerleaf.operators.transcript import participants

REC = "id long, user_id long, scene string, title string, created_at string, updated_at string, data string"


def record(i, user, messages, updated="2024-01-02T00:00:00+00:00"):
    return (i, user, "Banking", None, "2024-01-01T00:00:00+00:00", updated, json.dumps({"messages": messages}, ensure_ascii=False))


TRACE = {
    "run_id": "run-1-abcdef", "turn_id": "turn-1", "model": "m", "status": "ok", "duration_ms": 123, "total_tokens": 10,
    "final_result": {"reply": "答案是42"},
    "events": [{"type": "user", "agent": "user", "summary_in": "什么是GDP"}, {"type": "review", "agent": "review", "summary_out": "合规OK"}],
}


@pytest.fixture
def records(spark):
    talk = [{"role": "user", "content": "什么是GDP", "created_at": 1700000000000}, {"role": "assistant", "content": "答案是42", "created_at": 1700000000001, "trace": TRACE}]
    return spark.createDataFrame([record(1, 1, talk), record(2, 2, talk[:1]), (3, 1, "x", "t", None, None, "{bad")], REC)


def test_meta_and_detail(records):
    meta = {r.conversation_id: r for r in h.session_meta(records).collect()}
    assert (meta["1"].msg_count, meta["1"].total_tokens, meta["1"].title) == (2, 10, "什么是GDP")
    assert (meta["3"].msg_count, meta["3"].first_at, meta["3"].title) == (0, 0, "t")
    turn = h.turn_detail(records, "turn-1").first()
    assert (turn.user_message, turn.assistant_reply) == ("什么是GDP", "答案是42")
    assert [e.type for e in turn.events] == ["user", "review"]


def test_scope(records):
    seen = lambda *a, **k: {r.conversation_id for r in h.list_sessions(records, *a, **k).collect()}
    assert seen(1) == {"1", "3"} and seen(1, user_id=2) == set()
    assert seen(999, admins=[999], allow_admin_all=True) == {"1", "2", "3"}
    assert seen(999, user_id=2, admins=[999], allow_admin_all=True) == {"2"}
    with pytest.raises(h.AccessError):
        h.get_session(records, 2, 1)
    with pytest.raises(h.AccessError):
        lc.delete_session(records, 1, 2)
    assert {r.id for r in lc.delete_session(records, 1, 1).collect()} == {2, 3}


def test_search(records):
    messages = h.explode_messages(records)
    assert h.keyword_search(messages, 1, "gdp").count() == 1
    assert h.keyword_search(messages, 5, "gdp").count() == 0
    assert h.keyword_search(messages, 1, "gdp", start=4_000_000_000).count() == 0


def test_purge(spark):
    rows = spark.createDataFrame([record(1, 1, [], "2020-01-01T00:00:00+00:00"), record(2, 1, [])], REC)
    kept, purged = lc.purge_before(rows, 1_600_000_000_001, 9, [9], True)
    assert [r.id for r in kept.collect()] == [2] and [r.id for r in purged.collect()] == [1]
    with pytest.raises(h.AccessError):
        lc.purge_before(rows, 1, 1)
    assert lc.apply_retention(rows, 0, 1_800_000_000_000, 9, [9], True)[0].count() == 0
    assert lc.apply_retention(rows, None, 1_800_000_000_000, 9)[0].count() == 2


def test_export(records):
    detail = h.get_session(records, 1, 1)
    text = h.render_export(detail).first().document
    for part in ("# 会话复盘文档", "- 会话 ID：`1`", "**assistant**：答案是42", "### run `run-1-ab` · model=m · 耗时 123ms", "  - 输出：合规OK"):
        assert part in text
    assert "- [review/review] 合规OK" in h.review_context(detail).first().context
    assert json.loads(h.export_json(detail).first().document)["meta"]["scene"] == "Banking"


def test_redaction(spark):
    text = "手机号13800138000，身份证11010119900307123X，卡6217001234567890，邮箱a@b.com long@b.org x@y.zz@c.com"
    row = spark.createDataFrame([(text,)], "t string").select(
        redact_text(F.col("t")).alias("all"), redact_text(F.col("t"), ["13800138000"]).alias("kept")
    ).first()
    assert row["all"] == "手机号138****8000，身份证110101********123X，卡6217****7890，邮箱***@b.com lo***@b.org ***@y.zz@c.com"
    assert "13800138000" in row["kept"] and "6217****7890" in row["kept"]
    nested = spark.createDataFrame([({"reply": "联系13800138000", "list": ["邮件x@y.com"], "n": 1},)], "r struct<reply:string,list:array<string>,n:int>")
    got = nested.select(redact_struct(F.col("r"), nested.schema["r"].dataType).alias("r")).first().r
    assert (got.reply, got.list, got.n) == ("联系138****8000", ["邮件***@y.com"], 1)


def one_by_one(messages, runs):
    """Attach runs in order of time, one after the other."""
    for conv, run_id, at, reply, trace in sorted(runs, key=lambda r: (r[2], r[1])):
        mine = messages.setdefault(conv, [])
        said = [m for m in mine if m["role"] == "assistant"]
        target = next((m for m in reversed(said) if m["content"] == reply), None) or next(
            (m for m in reversed(said) if not m["trace"]), None
        )
        if target is None:
            mine.append({"role": "assistant", "content": reply, "trace": trace})
        else:
            target["trace"] = trace
    return messages


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_attached_traces_match_one_by_one(spark, seed):
    rng = random.Random(seed)
    messages = {c: [{"role": rng.choice(["user", "assistant"]), "content": rng.choice("abcd"), "trace": rng.choice([None, None, "old"])} for _ in range(rng.randint(1, 8))] for c in range(12)}
    runs = [(rng.randint(0, 14), f"r{i:03}", rng.randint(0, 9), rng.choice("abcdxyz"), f"t{i}") for i in range(120)]
    rows = [(c, i, m["role"], m["content"], i, m["trace"]) for c, ms in messages.items() for i, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "conv_id int, idx long, role string, content string, created_at long, trace string")
    rf = spark.createDataFrame(runs, "conv_id int, run_id string, at long, reply string, trace string")
    got = {}
    for r in sorted(h.attach_traces(df, rf).collect(), key=lambda r: (r.conv_id, r.idx)):
        got.setdefault(r.conv_id, []).append((r.role, r.content, r.trace))
    size = {c: len(ms) for c, ms in messages.items()}
    want = {c: [(m["role"], m["content"], m["trace"]) for m in ms] for c, ms in one_by_one(messages, runs).items()}
    cut = lambda table: {c: (v[: size.get(c, 0)], sorted(v[size.get(c, 0):], key=repr)) for c, v in table.items()}
    assert cut(got) == cut(want)


def test_order_helpers_with_one_hot_group(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN 0 ELSE id END AS k", "id * 7 AS n", "concat('v', id) AS v")
    plain = df.withColumn("nxt", F.lead("v").over(W.partitionBy("k").orderBy("n"))).withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("n")).cast("bigint"))
    ours = o.rank_in_group(o.next_in_group(df, ["k"], "n", "v", "nxt", span=50), ["k"], "n", "v", "r", span=50)
    assert sorted(map(tuple, ours.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    numbered = o.number_rows(df, [F.desc("n")], "no")
    assert [r.no for r in numbered.orderBy(F.desc("n")).collect()] == list(range(1, 3001))


TREE = "run_id string, id string, parent_id string, seq long"


def test_event_tree_reports_cycles_and_roots_orphans(spark):
    rows = [("r", "a", None, 0), ("r", "b", "a", 1), ("r", "c", "b", 2), ("r", "d", "gone", 3), ("r", "x", "y", 4), ("r", "y", "x", 5), ("r", "below", "y", 6), ("r", "self", "self", 7)]
    rows += [("q", "b", "a", 0), (None, "n", None, 0)]
    got = h.flatten_event_table(spark.createDataFrame(rows, TREE)).collect()
    assert len(got) == len(rows)
    placed = [(r.id, r.root_id, r.depth) for r in sorted((r for r in got if r.path is not None and r.run_id == "r"), key=lambda r: r.path)]
    assert placed == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "d", 0)]
    assert {r.id for r in got if r.path is None} == {"x", "y", "below", "self"} == {r.id for r in got if r.depth is None and r.root_id is None}
    assert h.flatten_event_table(spark.createDataFrame([], TREE)).count() == 0


def test_long_chains_and_wide_levels_take_few_rounds(spark, monkeypatch):
    rows = [("r", f"c{i}", f"c{i - 1}" if i else None, i) for i in range(1000)] + [("r", f"w{i}", "c500", 1000 + i) for i in range(2000)]
    cuts = []
    monkeypatch.setattr(h, "cut_lineage", lambda df, real=h.cut_lineage: cuts.append(1) or real(df))
    got = {r.id: r for r in h.flatten_event_table(spark.createDataFrame(rows, TREE)).collect()}
    assert len(got) == 3000 and all(got[f"c{i}"].depth == i and got[f"c{i}"].path == list(range(i + 1)) for i in range(1000))
    assert all(got[f"w{i}"].depth == 501 and got[f"w{i}"].root_id == "c0" and got[f"w{i}"].path[-2:] == [500, 1000 + i] for i in range(2000))
    assert len(cuts) <= 2 + 10


def test_participants(spark):
    df = spark.createDataFrame([([("B",), ("A",), ("B",), ("",)],), ([],)], "s array<struct<agent:string>>")
    assert [r.p for r in df.select(participants(F.col("s")).alias("p")).collect()] == [["B", "A"], ["Assistant"]]


def test_stored_traces_are_masked_but_keep_their_ids(spark):
    trace = dict(TRACE, run_id="e13800138000f", final_result={"reply": "13800138000"})
    trace["events"] = [{"type": "user", "summary_in": "13800138000", "children": [{"type": "rag_hit", "summary_out": "a@b.com"}]}]
    rows = [("r", json.dumps(trace)), ("r", "text 13800138000")]
    df = spark.createDataFrame(rows, "reply string, trace string")
    kept, plain = [r.trace for r in h.redact_runs(df).collect()]
    kept = json.loads(kept)
    assert kept["run_id"] == "e13800138000f" and kept["final_result"]["reply"] == "138****8000"
    assert kept["events"][0]["summary_in"] == "138****8000" and kept["events"][0]["children"][0]["summary_out"] == "***@b.com"
    assert plain == "text 138****8000"
    assert json.loads(h.redact_runs(df, record_events=False).first().trace)["events"] == []


def test_escaped_values_of_stored_traces_are_masked(spark):
    values = [
        'say "mail a@b.com" now', 'call "13800138000"', json.dumps({"reply": "mail a@b.com, call 13800138000"}), 'a\\"13800138000"', '"a@b.com\\',
        'long "13800138000" ' + 'x "y" \\ ' * 20_000 + "z " * 50_000 + ' "a@b.com"',
    ]
    rows = [("r", json.dumps(dict(TRACE, final_result=v, events=[{"type": "user", "summary_in": v}]), ensure_ascii=False)) for v in values]
    got = [json.loads(r.trace) for r in h.redact_runs(spark.createDataFrame(rows, "reply string, trace string").coalesce(1)).collect()]
    for value, trace in zip(values, got):
        masked = value.replace("a@b.com", "***@b.com").replace("13800138000", "138****8000")
        assert trace["final_result"] == masked and trace["events"][0]["summary_in"] == masked


def test_events_of_any_depth_are_read(spark):
    def nested(depth, last):
        return {"type": "step", "agent": f"a{depth}", "summary_out": f"out [{depth}]", "more": {"k": [depth]}, "children": [nested(depth + 1, last)] if depth < last else []}

    events = [nested(0, 40), {"type": "rag_hit", "agent": "z", "summary_out": "second root"}]
    talk = [{"role": "assistant", "content": "c", "trace": dict(TRACE, events=events)}]
    df = spark.createDataFrame([record(1, 1, talk)], REC)
    flat = h.turn_detail(df).first().events
    assert [(e.depth, e.agent) for e in flat] == [(i, f"a{i}") for i in range(41)] + [(0, "z")]
    detail = h.session_detail(df)
    assert json.loads(detail.first().trace[0].events[0]) == events[0]
    document = json.loads(h.export_json(detail).first().document)
    assert document["trace"][0]["events"] == events and document["trace"][0]["run_id"] == TRACE["run_id"] and document["has_trace"] is True
    assert "  " * 40 + "- [step] a40" in h.render_export(detail).first().document
    assert "- [step/a40] out [40]" in h.review_context(detail).first().context


def test_children_of_a_repeated_id_hang_under_its_last_row(spark):
    rows = [("r", "a", None, 0), ("r", "b", "a", 1), ("r", "a", None, 2), ("r", "c", "b", 3)]
    got = h.flatten_event_table(spark.createDataFrame(rows, TREE))
    assert sorted((r.seq, r.id, r.depth, r.path) for r in got.collect()) == [(0, "a", 0, [0]), (1, "b", 1, [2, 1]), (2, "a", 0, [2]), (3, "c", 2, [2, 1, 3])]


def test_traces_take_as_many_jobs_for_many_runs(spark):
    messages = [(c, i, "assistant", f"text {c} {i}", i, None) for c in range(3) for i in range(100)]
    counts = []
    for n in (2, 500):
        runs = [(i % 3, f"r{i:04}", i, f"reply {i % 450}", f"t{i}") for i in range(n)]
        df = spark.createDataFrame(messages, "conv_id int, idx long, role string, content string, created_at long, trace string")
        rf = spark.createDataFrame(runs, "conv_id int, run_id string, at long, reply string, trace string")
        spark.sparkContext.setJobGroup(f"traces-{n}", "")
        rows = h.attach_traces(df, rf).collect()
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"traces-{n}")))
        taken = {(r.conv_id, r.idx): r.trace for r in rows if r.idx < 100 and r.trace is not None}
        assert len(taken) == min(n, 300) and taken[0, 99] == "t0" and taken[1, 99] == "t1"
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Spark may broadcast the small sides of one and not of the other, each a job of its own.
    assert max(counts) <= 60 and abs(counts[1] - counts[0]) <= 8
