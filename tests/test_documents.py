import json

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions.structured import parse_structured, strip_json_fence
from ledgerleaf.functions.text import to_epoch_ms
from ledgerleaf.operators import graph as g, lifecycle as lc, training as tr
from ledgerleaf.plans.ingest import ingest_documents, rebuild
from ledgerleaf.session import scratch_path
from ledgerleaf.sources.chat_json import read_chat_json
from ledgerleaf.sources.files import parse_frontmatter, scan_corpus
from ledgerleaf.sources.metric_logs import read_metric_logs
from ledgerleaf.streaming import jobs

PLAN = "# 我的理财规划\n我在工商银行购买了稳健理财产品和指数基金。\n第三条 约定 年化收益率：3.5% ，管理费率 0.3%。\n风险等级 为中低，由 张三经理 跟进。"
FILES = "id string, user_id int, filename string, content binary, uploaded_at string"


def upload(spark, *files, **kw):
    rows = [(f"d{i}", u, name, bytearray(raw), "2024") for i, (u, name, raw) in enumerate(files)]
    return ingest_documents(spark.createDataFrame(rows, FILES), **kw)


def test_upload_makes_chunks_vectors_and_graph(spark):
    made = upload(spark, (1, "理财规划.md", PLAN.encode()))
    assert made["documents"].first().status == "done"
    assert made["chunks"].count() == made["embeddings"].count() > 0
    nodes = made["nodes"].collect()
    assert sum(n.type == "Document" for n in nodes) == 1
    assert {"Org", "Product", "Clause", "Metric", "Person"} <= {n.type for n in nodes}
    ids = {n.id for n in nodes}
    assert all(e.source in ids and e.target in ids for e in made["edges"].collect())


def test_failures_stay_with_their_file(spark):
    legacy = bytes.fromhex("d0cf11e0a1b11ae1") + "养老理财规划".encode("utf-16-le") + b"\x00\x00"
    made = upload(
        spark, (1, "good.md", PLAN.encode()), (1, "bad.xlsx", b"PK"), (1, "blank.txt", b"   \n  \n"), (1, "scan.pdf", b"%PDF-1.4"),
        (1, "old.DOC", legacy), (1, "page.html", "<html><body><p>养老保险</p></body></html>".encode()), (1, "no_extension", b"x"),
    )
    docs = {r.filename: r for r in made["documents"].collect()}
    assert {n: d.status for n, d in docs.items()} == {
        "good.md": "done", "bad.xlsx": "error", "blank.txt": "error", "scan.pdf": "error", "old.DOC": "done",
        "page.html": "done", "no_extension": "error",
    }
    assert "养老理财规划" in docs["old.DOC"].summary and docs["page.html"].summary == "养老保险"
    done = {r.id for r in docs.values() if r.status == "done"}
    for name in ("chunks", "embeddings", "nodes", "edges"):
        assert {r.doc_id for r in made[name].select("doc_id").distinct().collect()} <= done
    large = upload(spark, (1, "a.txt", b"x" * 2_000_000), (1, "b.txt", b"y"), max_file_mb=1)["documents"].collect()
    assert {r.filename: r.error for r in large} == {"a.txt": "文件超过大小上限 1MB（当前 1.9MB）", "b.txt": None}


def test_rules_on_other_documents(spark):
    text = "姓名：林富强\n毕业于北京大学，熟悉 Python 与 深度学习 。\n在蚂蚁集团 工作"
    df = spark.createDataFrame([(1, "cv.txt", text)], "doc_id int, filename string, text string")
    found = {(n.type, n.label) for n in g.graph_nodes(g.extract_entities(df)).collect()}
    assert {("Person", "林富强"), ("Education", "北京大学"), ("Skill", "Python")} <= found


def test_graph_limits(spark):
    text = "\n".join(" ".join(f"n{i}x{j}@ab.de {100000 + 50 * i + j}" for j in range(6)) for i in range(9))
    df = spark.createDataFrame([(1, "f", text)], "doc_id int, filename string, text string")
    rules = (("Email", r"[a-z0-9]+@[a-z]+\.[a-z]{2,}"), ("Number", r"[0-9]{6}"))
    nodes, edges = g.extract_graph(df, rules, max_nodes=40, max_edges=80)
    assert nodes.count() == 40 and edges.count() == 80
    assert g.extract_entities(df, rules, 40).first().cut_entities == 108 - 39
    nodes, edges = g.extract_graph(df, rules)
    assert nodes.count() == 109 and edges.count() == 108 + 9 * 36


def test_frontmatter(spark):
    df = spark.createDataFrame([("---\ntitle: \"A: b\"\nx: 'y'\nx: z\n---\nbody",), ("no block",)], "t string")
    rows = [r.f for r in df.select(parse_frontmatter(F.col("t")).alias("f")).collect()]
    assert (rows[0].meta, rows[0].body) == ({"title": "A: b", "x": "z"}, "body")
    assert (rows[1].meta, rows[1].body) == ({}, "no block")


def test_corpus_folder_and_rebuild(spark, tmp_path):
    (tmp_path / "faq.md").write_text("---\ntitle: FAQ\ndoc_type: product\ndomain: Banking\n---\n# Q\n存款", encoding="utf-8")
    (tmp_path / "reg.HTML").write_bytes("<p>规定</p>\xff".encode("latin-1", "ignore") + "条文".encode())
    (tmp_path / "skip.csv").write_text("x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.txt").write_text("below")
    docs = {r.doc_id: r for r in scan_corpus(spark, str(tmp_path)).collect()}
    assert set(docs) == {"faq.md", "reg.HTML"}
    assert (docs["faq.md"].title, docs["faq.md"].doc_type, docs["reg.HTML"].title) == ("FAQ", "product", "reg.HTML")
    target = scratch_path(spark, "kb")
    assert rebuild(spark, str(tmp_path), target, "2024-01-01")[0] == 0
    assert rebuild(spark, str(tmp_path), target, "2024-01-02")[0] == 2
    assert spark.read.parquet(f"{target}/chunks").select("doc_id").distinct().count() == 2
    assert spark.read.parquet(f"{target}/kb_meta").first().value == "2024-01-02"


def test_chat_files(spark, tmp_path):
    talk = [{"role": "HUMAN", "content": "q"}, {"role": "GPT", "content": "<think> t </think> a"}]
    (tmp_path / "array.json").write_text(json.dumps([{"id": "1", "messages": talk}, talk]))
    (tmp_path / "lines.jsonl").write_text(json.dumps({"id": "1", "messages": talk}) + "\n\n" + json.dumps({"messages": talk}) + "\n")
    for name in ("array.json", "lines.jsonl"):
        records = read_chat_json(spark, str(tmp_path / name))
        assert records.count() == 2
        sft = tr.prepare_sft(records).first().messages
        assert [m.role for m in sft] == ["user", "assistant"]
        dapo = tr.prepare_dapo(records).first()
        assert json.loads(dapo.extra_info) == {"question": "q", "gold_thinking": "t", "gold_output": "a"} and len(dapo.messages) == 1


def test_metric_logs(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "wandb-x").mkdir()
    (tmp_path / "wandb-x" / "m.jsonl").write_text('{"step": 1, "loss": 99}\n')
    (tmp_path / "a" / "1.jsonl").write_text('{"step": 1, "loss": 0.5, "on": true}\nbad\n[1]\n{"loss": 3}\n{"step": 1, "loss": 0.25}\n')
    (tmp_path / "b.jsonl").write_text('{"global_step": "2", "loss": 1, "name": "x"}\n{"step": "2.5", "loss": 7}\n{"step": 3.9, "loss": 8}\n')
    got = sorted((r.metric, r.step, r.value) for r in read_metric_logs(spark, str(tmp_path)).collect())
    assert got == [("loss", 1, 0.25), ("loss", 2, 1.0), ("loss", 3, 8.0)]


def test_model_output(spark):
    rows = [('x {"intent": "buy", "slots": {"n": 1}, "tool_plan": "no", "expression": "e"} y',), ("none",), ("{'a': 1}",)]
    got = [r.p for r in spark.createDataFrame(rows, "t string").select(parse_structured(F.col("t")).alias("p")).collect()]
    assert (got[0].intent, got[0].slots, got[0].tool_plan) == ("buy", {"n": "1"}, [])
    assert all((p.intent, p.slots, p.tool_plan, p.expression) == (None, {}, [], "") for p in got[1:])
    fences = ['```json\n{"expression": "hello there"}\n```', '{"a": 1}', " plain ", '[{"k": "v"}, "s"]', "{}"]
    out = [r.x for r in spark.createDataFrame([(f,) for f in fences], "t string").select(strip_json_fence(F.col("t")).alias("x")).collect()]
    assert out == ["hello there", "a: 1", "plain", "k: v\ns", "{}"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_epochs_ignore_the_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = ["1700000000", "1700000000123", "2024-01-01", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00.5+08:00", "x", "-5"]
        got = [r.m for r in spark.createDataFrame([(r,) for r in rows], "t string").select(to_epoch_ms(F.col("t")).alias("m")).collect()]
        assert got == [1700000000000, 1700000000123, 1704067200000, 1704067200000, 1704038400500, None, -5000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_folding_a_stream_with_a_watermark(spark, tmp_path):
    line = lambda kind, **kw: "data: " + json.dumps({"type": kind, **kw})
    rows = [
        {"run_id": "a", "seq": 1, "line": line("agent_message", content="hi", agent="B"), "at": "2024-01-01T00:00:01Z"},
        {"run_id": "a", "seq": 2, "line": line("done", reply="ok", conversation_id=5), "at": "2024-01-01T00:00:02Z"},
        {"run_id": "b", "seq": 1, "line": line("error", detail="no"), "at": "2024-01-01T00:00:03Z"},
        {"run_id": "z", "seq": 1, "line": "noise", "at": "2024-01-01T02:00:00Z"},
        {"run_id": "z", "seq": 2, "line": line("route"), "at": "2024-01-01T03:00:00Z"},
    ]
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps(r) for r in rows))
    stream = spark.readStream.schema("run_id string, seq long, line string, at timestamp").json(str(source))
    out = str(tmp_path / "out")
    folded = jobs.fold_chat_stream(stream, "10 minutes")
    (folded.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
     .trigger(availableNow=True).start().awaitTermination())
    got = {r.run_id: r for r in spark.read.schema(folded.schema).parquet(out).collect()}
    assert (got["a"].reply, got["a"].conversation_id, got["a"].agent_messages, got["a"].failed) == ("ok", 5, 1, False)
    assert got["b"].failed and got["b"].detail == "no"


def test_upserts_are_idempotent(spark):
    path = scratch_path(spark, "table")
    batch = lambda rows: spark.createDataFrame(rows, "doc_id string, idx int, content string")
    jobs.upsert_table(batch([("a", 0, "old"), ("a", 1, "old"), ("b", 0, "keep")]), path, buckets=4)
    for _twice in range(2):
        jobs.upsert_table(batch([("a", 0, "new"), ("c", 0, "add")]), path, buckets=4)
    got = sorted((r.doc_id, r.idx, r.content) for r in spark.read.parquet(path).collect())
    assert got == [("a", 0, "new"), ("b", 0, "keep"), ("c", 0, "add")]


def test_versions_and_compaction(spark):
    path, target = scratch_path(spark, "versions"), scratch_path(spark, "compact")
    batch = lambda rows: spark.createDataFrame(rows, "doc_id string, idx int, content string")
    jobs.append_version(batch([("a", 0, "old"), ("a", 1, "old"), ("b", 0, "keep")]), path, 1)
    jobs.append_version(batch([("a", 0, "new")]), path, 2)
    want = [("a", 0, "new"), ("b", 0, "keep")]
    read = lambda at: sorted((r.doc_id, r.idx, r.content) for r in jobs.current_rows(spark.read.parquet(at)).collect())
    assert read(path) == want
    jobs.compact(spark, path, target)
    assert read(target) == want


def test_a_paragraph_of_two_thousand_entities(spark):
    rules = (("A", r"a\d+"), ("B", r"b\d+"))
    names = [f"{'ab'[i % 2]}{i}" for i in range(2000)]
    rows = [(1, "big", " ".join(names), 7), (2, "small", "a1 b2 a3\nb2 a1\nb4", 7), (3, "none", "nothing", 8), (4, "null", None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, filename string, text string, user_id int")
    edges = g.graph_edges(g.extract_entities(df, rules))
    sizes = {r.doc_id: (r["n"], r["ids"], r["last"]) for r in edges.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max(F.substring_index("id", ":e", -1).cast("long")).alias("last")).collect()}
    assert sizes[1] == (2000 + 1_000_000, 2000 + 1_000_000, 2000 + 1_000_000 - 1)
    small = [(r.id, r.source, r.target, r.label, r.user_id) for r in edges.where("doc_id = 2").collect()]
    assert len(small) == 4 + 2 and len({i for i, *_ in small}) == 6 and {u for *_, u in small} == {7}
    nodes = {r.id: r.label for r in g.graph_nodes(g.extract_entities(df.where("doc_id = 2"), rules)).collect()}
    ends = {frozenset((nodes[s], nodes[t])) for _, s, t, k, _ in small if k == g.RELATED}
    assert ends == {frozenset(("a1", "b2")), frozenset(("a3", "b2"))}
    assert g.graph_edges(g.extract_entities(df, rules), max_edges=3).groupBy("doc_id").count().where("count > 3").count() == 0


def test_rollups_compute_only_what_they_read(spark):
    from ledgerleaf.plans import document_queries as dq, search_queries as sq

    for query in (dq.chunk_counts, dq.kb_documents, sq.prefiltered_chunks):
        assert "ArrowEvalPython" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    stats = dq.kb_stats(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert stats.count("ArrowEvalPython") == 1 and "corpus-" not in stats


def test_deleted_keys_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    left, removed = lc.delete_docs(rows, spark.createDataFrame([(1,), (1,), (3,)], "doc_id long"))
    assert {r.text for r in left.collect()} == {"c", "d"} and [tuple(r) for r in removed.collect()] == [(1, 2)]
    for df in (left, removed):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
