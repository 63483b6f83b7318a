"""Registered queries: conversations, traces, transcripts, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerleaf.operators import history as h, transcript as t
from ledgerleaf.plans import sqlparts as q
from ledgerleaf.plans.text_queries import table

_BASE = 1_700_000_000_000
_TRACE = """named_struct('run_id', concat('run-', conv_id, '-', turn), 'turn_id', concat('t', conv_id, '-', turn), 'created_at', 5L,
  'model', 'm', 'status', 'ok', 'duration_ms', turn, 'total_tokens', turn * 10, 'final_result', named_struct('reply', text),
  'events', array(
    named_struct('agent', 'user', 'type', 'user', 'summary_in', 'ask', 'summary_out', '', 'meta_json', '', 'children', from_json('[]', 'array<struct<agent:string,type:string,summary_out:string,meta_json:string>>')),
    named_struct('agent', 'Banking', 'type', 'expert_opinion', 'summary_in', '', 'summary_out', role, 'meta_json', '{"scene": "B"}', 'children',
      array(named_struct('agent', 'rag', 'type', 'rag_hit', 'summary_out', 'hit', 'meta_json', '{"doc_id": "d1", "title": "T", "score": 0.5}')))))"""


def _records(spark, sf):
    """Every message as a stored conversation of its own; system ones are unreadable."""
    data = f"""CASE role WHEN 'system' THEN '{{"messages": [' ELSE to_json(named_struct('messages', array(
        named_struct('role', role, 'content', text, 'scene', 'qa', 'created_at', CASE turn WHEN 2 THEN 0 ELSE {_BASE} + turn END,
          'trace', CASE role WHEN 'assistant' THEN {_TRACE} END)))) END"""
    return table(spark, sf, "conversations").selectExpr(
        "conv_id * 1000 + turn AS id", "role AS user_id", "CASE WHEN turn > 3 THEN 'analyze' ELSE 'qa' END AS scene",
        "CASE turn WHEN 4 THEN 'four' END AS title", "concat('2024-01-0', turn + 1, 'T00:00:00+00:00') AS created_at",
        "concat('2024-02-0', turn + 1, 'T00:00:00Z') AS updated_at", f"{data} AS data",
    )


def _messages(spark, sf):
    return table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn AS idx", "role", "text AS content", f"CASE turn WHEN 2 THEN 0 ELSE {_BASE} + turn END AS created_at",
        "turn * 10 AS tokens",
    )


def exploded_messages(spark, sf):
    rows = h.explode_messages(_records(spark, sf))
    return rows.select(
        "conv_id", "user_id", "idx", "role", "content", "created_at", F.col("trace.turn_id").alias("turn_id"),
        F.col("trace.total_tokens").alias("tokens"), F.get_json_object("trace.final_result", "$.reply").alias("reply"),
    )


def session_summaries(spark, sf):
    return h.session_meta(_records(spark, sf))


def session_rollup(spark, sf):
    return h.session_meta_of_messages(_messages(spark, sf), tokens="tokens")


def session_page(spark, sf):
    return h.list_sessions(_records(spark, sf), "user", scene="qa", limit=50, offset=5).select("conversation_id", "title", "last_at")


def session_page_of_admin(spark, sf):
    rows = h.list_sessions(_records(spark, sf), "root", user_id="assistant", limit=20, admins=["root"], allow_admin_all=True)
    return rows.select("conversation_id", "total_tokens")


def scoped_records(spark, sf):
    own = h.scope_filter(_records(spark, sf), "assistant").select("id", F.lit("own").alias("scope"))
    every = h.scope_filter(_records(spark, sf), "root", ["root"], True).select("id", F.lit("all").alias("scope"))
    return own.unionByName(every)


def session_details(spark, sf):
    rows = h.session_detail(_records(spark, sf))
    return rows.select(
        "conversation_id", F.col("meta.title").alias("title"), F.size("messages").alias("n"),
        F.try_element_at("messages", F.lit(1))["content"].alias("content"),
        F.try_element_at("trace", F.lit(1))["run_id"].alias("run_id"), "has_trace",
    )


def turn_details(spark, sf):
    rows = h.turn_detail(_records(spark, sf))
    return rows.select(
        "conversation_id", "turn_id", "user_message", "assistant_reply", F.size("events").alias("n_events"),
        F.array_join(F.transform("events", lambda e: F.concat(e["depth"].cast("string"), e["type"])), ",").alias("events"),
    )


def keyword_hits(spark, sf):
    messages = h.explode_messages(_records(spark, sf))
    return h.keyword_search(messages, "assistant", "TION", scene="qa", start=1_699_999_999, end=1_800_000_000, limit=20)


def keyword_hits_of_admin(spark, sf):
    messages = h.explode_messages(_records(spark, sf))
    return h.keyword_search(messages, "root", "eau", limit=30, admins=["root"], allow_admin_all=True)


def trace_events(spark, sf):
    results = table(spark, sf, "conversations").selectExpr(
        "concat(conv_id, '-', turn) AS run_id", "CASE WHEN turn = 0 THEN '' ELSE role END AS user_message", "text AS reply",
        "array('note', '') AS compliance_notes", "CASE WHEN turn > 2 THEN array(role) END AS risk_flags", "turn AS at",
        "array(named_struct('agent', 'Banking', 'type', 'expert_opinion', 'content', role, 'meta_json', CAST(NULL AS STRING))) AS steps",
    )
    return h.build_trace_events(results)


def _tree(spark, sf):
    """Regions, nations, customers, orders and line items as one tree of events per world part."""
    region = table(spark, sf, "region").selectExpr("concat('r', r_regionkey) AS id", "CAST(NULL AS STRING) AS parent_id", "CAST(r_regionkey AS BIGINT) AS seq")
    nation = table(spark, sf, "nation").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)", "CAST(n_nationkey AS BIGINT)")
    customer = table(spark, sf, "customer").selectExpr("concat('c', c_custkey)", "concat('n', c_nationkey)", "c_custkey")
    orders = table(spark, sf, "orders").selectExpr("concat('o', o_orderkey)", "concat('c', o_custkey)", "o_orderkey")
    return region.union(nation).union(customer).union(orders).withColumn("run_id", F.lit("world"))


def event_tree(spark, sf):
    placed = h.flatten_event_table(_tree(spark, sf))
    return placed.select("id", "root_id", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


def attached_traces(spark, sf):
    """Each assistant text has its run; two more runs per conversation quote its first user text."""
    talk = table(spark, sf, "conversations")
    messages = talk.selectExpr("conv_id", "turn AS idx", "role", "text AS content", "turn AS created_at", "CAST(NULL AS STRING) AS trace")
    exact = talk.filter("role = 'assistant'").selectExpr(
        "conv_id", "concat('x', turn) AS run_id", "turn + 1 AS at", "text AS reply", "concat('exact ', turn) AS trace"
    )
    early = talk.filter("turn = 0 AND role = 'user'").selectExpr("conv_id", "'early' AS run_id", "0L AS at", "concat('? ', text) AS reply", "'early' AS trace")
    late = talk.filter("turn = 0 AND role = 'user'").selectExpr("conv_id", "'late' AS run_id", "1000L AS at", "concat('? ', text) AS reply", "'late' AS trace")
    return h.attach_traces(messages, exact.unionByName(early).unionByName(late)).select("conv_id", "idx", "role", "content", "trace")


def appended_turns(spark, sf):
    turns = table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn * 1000 AS at", "text AS message", "role AS reply", "'qa' AS scene",
        """CASE WHEN turn = 0 THEN NULL ELSE array(named_struct('role', CAST(NULL AS STRING), 'content', 'opinion', 'agent', 'Banking', 'avatar', 'a', 'mention', 'm', 'type', 'expert_opinion'),
           named_struct('role', CASE WHEN turn = 1 THEN 'assistant' ELSE 'agent' END, 'content', role, 'agent', 'Coordinator', 'avatar', 'a', 'mention', NULL, 'type', 'final')) END AS agent_messages""",
    )
    return h.append_turns(turns).select("conv_id", "at", "seq", "role", "content", "agent", "type", "scene", "created_at")


def touched_conversations(spark, sf):
    turns = table(spark, sf, "conversations").selectExpr("conv_id", "turn AS at", "text AS message", "role AS user_id", "'qa' AS scene")
    headers = table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "c_mktsegment AS user_id", "'old' AS scene", "CASE WHEN c_acctbal > 0 THEN c_name END AS title", "-1L AS created_at", "-1L AS updated_at"
    )
    return h.touch_conversations(headers, turns)


_STEP_AGENT = "CASE turn WHEN 2 THEN NULL WHEN 4 THEN 'InsuranceExpert' ELSE 'BankingExpert' END"
_STEP_TYPE = "CASE turn WHEN 1 THEN 'route' WHEN 5 THEN 'revise' ELSE 'expert_opinion' END"


def transcripts(spark, sf):
    talk = table(spark, sf, "conversations")
    steps = talk.selectExpr("conv_id AS run_id", "turn AS seq", f"{_STEP_AGENT} AS agent", f"{_STEP_TYPE} AS type", "text AS content")
    runs = talk.groupBy(F.col("conv_id").alias("run_id")).agg(F.max_by("text", "turn").alias("reply"), F.max("turn").alias("n"))
    runs = runs.selectExpr(
        "run_id", "reply", "CASE WHEN n > 4 THEN array('ok', '') END AS compliance_notes",
        "CASE WHEN n > 2 THEN array('mind') ELSE array() END AS risk_flags",
    )
    return t.build_transcript(steps, runs)


def run_participants(spark, sf):
    steps = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("agent")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(t.participants(steps), "|").alias("agents"))


def latest_replies(spark, sf):
    return t.latest_assistant_reply(_messages(spark, sf))


def exported_sessions(spark, sf):
    return h.render_export(h.session_detail(_records(spark, sf)))


def exported_json(spark, sf):
    rows = h.export_json(h.session_detail(_records(spark, sf)))
    part = lambda path: F.get_json_object("document", path)
    return rows.select(
        "conversation_id", part("$.meta.msg_count").alias("n"), part("$.messages[0].content").alias("content"),
        part("$.trace[0].run_id").alias("run_id"), part("$.has_trace").alias("has_trace"),
    )


def review_contexts(spark, sf):
    return h.review_context(h.session_detail(_records(spark, sf)))


QUERIES = {
    "exploded_messages": exploded_messages, "session_summaries": session_summaries, "session_rollup": session_rollup,
    "session_page": session_page, "session_page_of_admin": session_page_of_admin, "scoped_records": scoped_records,
    "session_details": session_details, "turn_details": turn_details, "keyword_hits": keyword_hits,
    "keyword_hits_of_admin": keyword_hits_of_admin, "trace_events": trace_events, "event_tree": event_tree,
    "attached_traces": attached_traces, "appended_turns": appended_turns, "touched_conversations": touched_conversations,
    "transcripts": transcripts, "run_participants": run_participants, "latest_replies": latest_replies,
    "exported_sessions": exported_sessions, "exported_json": exported_json, "review_contexts": review_contexts,
}

_ID = "conv_id * 1000 + turn"
_AT = f"CASE turn WHEN 2 THEN 0 ELSE {_BASE} + turn END"
_TITLE = f"CASE WHEN turn = 4 THEN 'four' WHEN role = 'user' THEN substr(replace({q.strip('text')}, chr(10), ' '), 1, 50) END"
_DAY = "CAST(epoch_ms(TIMESTAMP '2024-01-01') + turn * 86400000 AS BIGINT)"
_UPDATED = "CAST(epoch_ms(TIMESTAMP '2024-02-01') + turn * 86400000 AS BIGINT)"
_TIMED = "role <> 'system' AND turn <> 2"
_SCENE = "CASE WHEN turn > 3 THEN 'analyze' ELSE 'qa' END"
_NL = "chr(10)"
_DASH_TITLE = f"coalesce({_TITLE}, '—')"
_TRACE_MD = f"""'## 执行轨迹（trace）' || {_NL} || {_NL} || '### run `' || substr('run-' || conv_id || '-' || turn, 1, 8) || '` · model=m · 耗时 ' || turn || 'ms · token ' || turn * 10 || ' · 状态 ok'
  || {_NL} || '- [user] user' || {_NL} || '  - 输入：ask' || {_NL} || '- [expert_opinion] Banking' || {_NL} || '  - 输出：assistant' || {_NL} || '  - 结构化：{{"scene": "B"}}'
  || {_NL} || '  - [rag_hit] rag' || {_NL} || '    - 输出：hit' || {_NL} || '    - 结构化：{{"doc_id": "d1", "title": "T", "score": 0.5}}' || {_NL}"""
_AGENT_NAMES = {"BankingExpert": "银行专家", "InsuranceExpert": "保险专家"}
_NAME = lambda c: f"CASE {c} WHEN 'BankingExpert' THEN '银行专家' WHEN 'InsuranceExpert' THEN '保险专家' WHEN 'review' THEN '合规审核' WHEN 'risk' THEN '风控' WHEN 'Coordinator' THEN '协调者' END"
_FACE = lambda c: f"CASE {c} WHEN 'BankingExpert' THEN '🏦' WHEN 'InsuranceExpert' THEN '🛡️' ELSE '🤖' END"

ORACLE = {
    "exploded_messages": f"""SELECT {_ID} AS conv_id, role AS user_id, CAST(0 AS INTEGER) AS idx, role, text AS content, {_AT} AS created_at,
        CASE role WHEN 'assistant' THEN 't' || conv_id || '-' || turn END AS turn_id, CASE role WHEN 'assistant' THEN turn * 10 END AS tokens,
        CASE role WHEN 'assistant' THEN text END AS reply FROM conversations WHERE role <> 'system'""",
    "session_summaries": f"""SELECT CAST({_ID} AS VARCHAR) AS conversation_id, {_SCENE} AS scene, {_TITLE} AS title, 'active' AS status,
        CAST(CASE role WHEN 'system' THEN 0 ELSE 1 END AS INTEGER) AS msg_count, CASE role WHEN 'assistant' THEN turn * 10 ELSE 0 END AS total_tokens,
        CASE WHEN {_TIMED} THEN {_BASE} + turn ELSE {_DAY} END AS first_at, CASE WHEN {_TIMED} THEN {_BASE} + turn ELSE {_UPDATED} END AS last_at, {_DAY} AS created_at FROM conversations""",
    "session_rollup": f"""SELECT conv_id, count(*) AS msg_count, CAST(sum(turn * 10) AS BIGINT) AS total_tokens,
        substr(replace({q.strip("arg_min(text, turn) FILTER (role = 'user' AND length(text) > 0)")}, chr(10), ' '), 1, 50) AS title,
        min({_BASE} + turn) FILTER (turn <> 2) AS first_at, max({_BASE} + turn) FILTER (turn <> 2) AS last_at FROM conversations GROUP BY 1""",
    "session_page": f"""WITH p AS (SELECT * FROM conversations WHERE role = 'user' AND turn <= 3 ORDER BY turn DESC, {_ID} LIMIT 50 OFFSET 5)
        SELECT CAST({_ID} AS VARCHAR) AS conversation_id, {_TITLE} AS title, CASE WHEN turn <> 2 THEN {_BASE} + turn ELSE {_UPDATED} END AS last_at FROM p""",
    "session_page_of_admin": f"""SELECT CAST({_ID} AS VARCHAR) AS conversation_id, turn * 10 AS total_tokens FROM conversations WHERE role = 'assistant' ORDER BY turn DESC, {_ID} LIMIT 20""",
    "scoped_records": f"SELECT {_ID} AS id, 'own' AS scope FROM conversations WHERE role = 'assistant' UNION ALL SELECT {_ID}, 'all' FROM conversations",
    "session_details": f"""SELECT CAST({_ID} AS VARCHAR) AS conversation_id, {_TITLE} AS title, CAST(CASE role WHEN 'system' THEN 0 ELSE 1 END AS INTEGER) AS n,
        CASE WHEN role <> 'system' THEN text END AS content, CASE role WHEN 'assistant' THEN 'run-' || conv_id || '-' || turn END AS run_id, role = 'assistant' AS has_trace FROM conversations""",
    "turn_details": f"""SELECT CAST({_ID} AS VARCHAR) AS conversation_id, 't' || conv_id || '-' || turn AS turn_id, 'ask' AS user_message, text AS assistant_reply,
        CAST(3 AS INTEGER) AS n_events, '0user,0expert_opinion,1rag_hit' AS events FROM conversations WHERE role = 'assistant'""",
    "keyword_hits": f"""SELECT CAST({_ID} AS VARCHAR) AS conversation_id, 't' || conv_id || '-' || turn AS turn_id, CAST(0 AS INTEGER) AS event_id, substr(text, 1, 200) AS snippet,
        CAST(1 AS DOUBLE) AS score, role AS type, {_AT} AS created_at FROM conversations WHERE role = 'assistant' AND turn <= 3 AND turn <> 2 AND contains(lower(text), 'tion')
        ORDER BY created_at DESC, conversation_id LIMIT 20""",
    "keyword_hits_of_admin": f"""SELECT CAST({_ID} AS VARCHAR) AS conversation_id, CASE role WHEN 'assistant' THEN 't' || conv_id || '-' || turn ELSE '' END AS turn_id, CAST(0 AS INTEGER) AS event_id,
        substr(text, 1, 200) AS snippet, CAST(1 AS DOUBLE) AS score, role AS type, {_AT} AS created_at FROM conversations WHERE role <> 'system' AND contains(lower(text), 'eau')
        ORDER BY created_at DESC, conversation_id LIMIT 30""",
    "trace_events": """WITH e AS (
          SELECT conv_id || '-' || turn AS run_id, turn, role, text, 0 AS o, 'user' AS agent, 'user' AS type, role AS summary_in, '' AS summary_out, '' AS meta_json FROM conversations WHERE turn > 0
          UNION ALL SELECT conv_id || '-' || turn, turn, role, text, 1, 'assistant', 'assistant', '', text, '' FROM conversations WHERE text <> ''
          UNION ALL SELECT conv_id || '-' || turn, turn, role, text, 2, 'review', 'review', '', 'note', '' FROM conversations
          UNION ALL SELECT conv_id || '-' || turn, turn, role, text, 3, 'risk', 'risk', '', role, '' FROM conversations WHERE turn > 2
          UNION ALL SELECT conv_id || '-' || turn, turn, role, text, 4, 'Banking', 'expert_opinion', '', role, '{}' FROM conversations)
        SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY o) - 1 AS INTEGER) AS seq, agent, type, summary_in, summary_out, meta_json, turn AS created_at FROM e""",
    "event_tree": """
        WITH RECURSIVE tree AS (
          SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, CAST(r_regionkey AS BIGINT) AS seq FROM region
          UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation
          UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey FROM customer
          UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderkey FROM orders),
        walk AS (
          SELECT id, id AS root_id, CAST(0 AS INTEGER) AS depth, CAST(seq AS VARCHAR) AS path FROM tree WHERE parent IS NULL OR parent NOT IN (SELECT id FROM tree)
          UNION ALL SELECT t.id, w.root_id, w.depth + 1, w.path || '/' || t.seq FROM tree t JOIN walk w ON t.parent = w.id)
        SELECT id, root_id, depth, path FROM walk""",
    "attached_traces": """
        WITH last AS (SELECT conv_id, max(turn) AS n, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1),
        target AS (SELECT conv_id, text, max(turn) AS idx, max(turn) AS src FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
        free AS (SELECT conv_id, max(turn) AS idx FROM conversations WHERE role = 'assistant' AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0 AND role = 'user') GROUP BY 1)
        SELECT c.conv_id, turn AS idx, role, c.text AS content,
          CASE WHEN t.idx IS NOT NULL THEN 'exact ' || t.src WHEN f2.conv_id IS NOT NULL AND late.idx = turn THEN 'late' END AS trace
        FROM conversations c LEFT JOIN target t ON t.conv_id = c.conv_id AND t.idx = c.turn AND c.role = 'assistant'
          LEFT JOIN free f2 ON f2.conv_id = c.conv_id
          LEFT JOIN (SELECT c.conv_id, max(c.turn) AS idx FROM conversations c LEFT JOIN target t ON t.conv_id = c.conv_id AND t.idx = c.turn
                     WHERE c.role = 'assistant' AND t.idx IS NULL GROUP BY 1) late ON late.conv_id = c.conv_id AND c.role = 'assistant'
        UNION ALL
        SELECT u.conv_id, n + 1, 'assistant', '? ' || text, 'late' FROM conversations u JOIN last USING (conv_id) WHERE u.turn = 0 AND role = 'user'
          AND u.conv_id NOT IN (SELECT c.conv_id FROM conversations c LEFT JOIN target t ON t.conv_id = c.conv_id AND t.idx = c.turn WHERE c.role = 'assistant' AND t.idx IS NULL)""",
    "appended_turns": """
        WITH m AS (
          SELECT conv_id, turn, 0 AS o, 'user' AS role, text AS content, NULL AS agent, NULL AS type FROM conversations
          UNION ALL SELECT conv_id, turn, 1, 'agent', 'opinion', 'Banking', 'expert_opinion' FROM conversations WHERE turn > 0
          UNION ALL SELECT conv_id, turn, 2, CASE turn WHEN 1 THEN 'assistant' ELSE 'agent' END, role, 'Coordinator', 'final' FROM conversations WHERE turn > 0
          UNION ALL SELECT conv_id, turn, 3, 'assistant', role, NULL, NULL FROM conversations WHERE turn <> 1)
        SELECT conv_id, turn * 1000 AS at, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) - 1 AS INTEGER) AS seq, role, content, agent, type, 'qa' AS scene,
          turn * 1000 + row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) - 1 AS created_at FROM m""",
    "touched_conversations": """
        WITH n AS (SELECT conv_id, max(turn) AS hi, min(turn) AS lo, arg_min(role, turn) AS u, substr(arg_min(text, turn) FILTER (length(text) > 0), 1, 50) AS t FROM conversations GROUP BY 1)
        SELECT coalesce(c_custkey, conv_id) AS id, coalesce(c_mktsegment, u) AS user_id, CASE WHEN c_custkey IS NULL THEN 'qa' ELSE 'old' END AS scene,
          CASE WHEN c_acctbal > 0 THEN c_name ELSE t END AS title, CASE WHEN c_custkey IS NULL THEN lo ELSE -1 END AS created_at, coalesce(hi, -1) AS updated_at
        FROM customer FULL JOIN n ON c_custkey = conv_id""",
    "transcripts": f"""
        WITH s AS (SELECT conv_id, turn, {_STEP_AGENT} AS agent, {_STEP_TYPE} AS type, text FROM conversations),
        r AS (SELECT conv_id AS run_id, arg_max(text, turn) AS reply, max(turn) AS n FROM conversations GROUP BY 1),
        shown AS (SELECT *, lead(agent) OVER (PARTITION BY conv_id ORDER BY turn) AS ahead FROM s WHERE type NOT IN ('route', 'revise', 'rag')),
        talk AS (SELECT conv_id AS run_id, turn AS seq, coalesce(agent, 'Coordinator') AS agent, type, text,
            coalesce(ahead, CASE WHEN n > 4 THEN 'review' WHEN n > 2 THEN 'risk' ELSE 'Coordinator' END) AS following FROM shown JOIN r ON run_id = conv_id)
        SELECT run_id, CAST(0 AS INTEGER) AS section, seq, 'agent' AS role, agent, {_FACE('agent')} AS avatar, type,
          {q.strip("text || chr(10) || chr(10) || '@' || " + _NAME('following'))} AS content, {_NAME('following')} AS mention FROM talk
        UNION ALL SELECT run_id, 1, 0, 'agent', 'ComplianceReviewer', '✅', 'review', 'ok' || chr(10) || chr(10) || '@风控', '风控' FROM r WHERE n > 4
        UNION ALL SELECT run_id, 2, 0, 'agent', 'RiskController', '⚠️', 'risk', 'mind' || chr(10) || chr(10) || '@协调者', '协调者' FROM r WHERE n > 2
        UNION ALL SELECT run_id, 3, 0, 'assistant', CASE WHEN n >= 5 THEN 'BankingExpert' ELSE 'Coordinator' END, CASE WHEN n >= 5 THEN '🏦' ELSE '🤖' END, 'final', reply, NULL FROM r""",
    "run_participants": """
        WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS a, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
        f AS (SELECT conv_id, turn, a, min(i) AS i FROM w WHERE a <> '' GROUP BY 1, 2, 3)
        SELECT c.conv_id, c.turn, coalesce(string_agg(a, '|' ORDER BY i), 'Assistant') AS agents FROM conversations c LEFT JOIN f ON f.conv_id = c.conv_id AND f.turn = c.turn GROUP BY 1, 2""",
    "latest_replies": "SELECT conv_id, arg_max(text, turn) AS content FROM conversations WHERE role = 'assistant' GROUP BY 1",
    "exported_sessions": f"""SELECT CAST({_ID} AS VARCHAR) AS conversation_id,
        '# 会话复盘文档' || {_NL} || {_NL} || '- 会话 ID：`' || {_ID} || '`' || {_NL} || '- 场景：' || {_SCENE} || {_NL} || '- 标题：' || {_DASH_TITLE} || {_NL} || '- 状态：active' || {_NL}
        || '- 消息数：' || CASE role WHEN 'system' THEN 0 ELSE 1 END || '　累计 token：' || CASE role WHEN 'assistant' THEN turn * 10 ELSE 0 END || {_NL} || {_NL} || '## 主消息流' || {_NL} || {_NL}
        || CASE role WHEN 'system' THEN '' ELSE '**' || role || '**：' || text || {_NL} END || {_NL} || CASE role WHEN 'assistant' THEN {_TRACE_MD} ELSE '' END AS document FROM conversations""",
    "exported_json": f"""SELECT CAST({_ID} AS VARCHAR) AS conversation_id, CASE role WHEN 'system' THEN '0' ELSE '1' END AS n, CASE WHEN role <> 'system' THEN text END AS content,
        CASE role WHEN 'assistant' THEN 'run-' || conv_id || '-' || turn END AS run_id, CASE role WHEN 'assistant' THEN 'true' ELSE 'false' END AS has_trace FROM conversations""",
    "review_contexts": f"""SELECT CAST({_ID} AS VARCHAR) AS conversation_id, '【会话复盘上下文】' || {_NL} || '场景：' || {_SCENE} || '；标题：' || coalesce({_TITLE}, '未知') || {_NL} || {_NL} || '=== 用户诉求 ===' || {_NL}
        || CASE role WHEN 'user' THEN '- ' || text || {_NL} ELSE '' END || {_NL} || '=== 各智能体结论 / RAG 依据 / 审核风控 ==='
        || CASE role WHEN 'assistant' THEN {_NL} || '- [expert_opinion/Banking] assistant' || {_NL} || '- [rag_hit/rag] hit （溯源：d1 / T / score=0.5）' ELSE '' END AS context FROM conversations""",
}
