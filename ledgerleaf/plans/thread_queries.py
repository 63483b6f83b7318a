"""Registered queries over whole conversations: records of several messages, with several traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerleaf.operators import history as h, trigrams
from ledgerleaf.plans import history_queries as one, sqlparts as q
from ledgerleaf.plans.text_queries import table
from ledgerleaf.session import scratch_path


_INDEXES: dict[tuple[str, str], str] = {}


def _records(spark, sf):
    """Every conversation as one stored record: messages by turn, a trace on each assistant message."""
    message = f"""named_struct('turn', turn, 'm', named_struct('role', role, 'content', text, 'scene', 'qa',
        'created_at', CASE turn WHEN 2 THEN 0 ELSE {one._BASE} + turn END, 'trace', CASE role WHEN 'assistant' THEN {one._TRACE} END))"""
    talk = table(spark, sf, "conversations").selectExpr("conv_id", f"{message} AS m").groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return talk.selectExpr(
        "conv_id AS id", "CASE conv_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS user_id", "CASE WHEN conv_id % 5 = 0 THEN 'analyze' ELSE 'qa' END AS scene",
        "CASE conv_id % 3 WHEN 0 THEN 'named' END AS title", "'2024-01-01T00:00:00+00:00' AS created_at", "'2024-02-01T00:00:00Z' AS updated_at",
        "to_json(named_struct('messages', transform(ms, x -> x.m))) AS data",
    )


def thread_messages(spark, sf):
    rows = h.explode_messages(_records(spark, sf))
    return rows.select("conv_id", "user_id", "idx", "role", "content", "created_at", F.col("trace.turn_id").alias("turn_id"), F.col("trace.total_tokens").alias("tokens"))


def thread_summaries(spark, sf):
    return h.session_meta(_records(spark, sf))


def thread_page(spark, sf):
    return h.list_sessions(_records(spark, sf), "even", scene="qa", limit=40, offset=3).select("conversation_id", "title", "msg_count", "last_at")


def thread_details(spark, sf):
    rows = h.session_detail(_records(spark, sf))
    joined = lambda c, f: F.array_join(F.transform(c, f), "|")
    return rows.select(
        "conversation_id", F.col("meta.total_tokens").alias("tokens"), F.md5(joined("messages", lambda m: m["content"])).alias("contents"),
        joined("messages", lambda m: m["role"]).alias("roles"), joined("trace", lambda t: t["run_id"]).alias("runs"), "has_trace",
    )


def thread_turns(spark, sf):
    rows = h.turn_detail(_records(spark, sf))
    return rows.select("conversation_id", "turn_id", "user_message", "assistant_reply", F.size("events").alias("n_events"))


def thread_hits(spark, sf):
    messages = h.explode_messages(_records(spark, sf))
    return h.keyword_search(messages, "root", "EN", limit=60, admins=["root"], allow_admin_all=True)


def thread_hits_indexed(spark, sf):
    """The newest messages with a word, by the stored index of trigrams."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _INDEXES:
        _INDEXES[at] = scratch_path(spark, "trigrams")
        trigrams.store_trigrams(h.explode_messages(_records(spark, sf)), _INDEXES[at])
    return trigrams.indexed_search(trigrams.open_trigrams(spark, _INDEXES[at]), "root", "TION", limit=60, admins=["root"], allow_admin_all=True)


def thread_exports(spark, sf):
    return h.render_export(h.session_detail(_records(spark, sf)))


def thread_json(spark, sf):
    """Positions in the exported document: the last message and the last trace."""
    rows = h.export_json(h.session_detail(_records(spark, sf)))
    part = lambda path: F.get_json_object("document", path)
    return rows.select(
        "conversation_id", part("$.meta.msg_count").alias("n"), part("$.messages[1].content").alias("second"), part("$.trace[1].turn_id").alias("second_trace"),
    )


def thread_reviews(spark, sf):
    return h.review_context(h.session_detail(_records(spark, sf)))


QUERIES = {f.__name__: f for f in (thread_messages, thread_summaries, thread_page, thread_details, thread_turns, thread_hits, thread_hits_indexed, thread_exports, thread_json, thread_reviews)}

_NL = "chr(10)"
_FIRST_ASK = "arg_min(text, turn) FILTER (role = 'user' AND length(text) > 0)"
_DAY, _UPDATED = "CAST(epoch_ms(TIMESTAMP '2024-01-01') AS BIGINT)", "CAST(epoch_ms(TIMESTAMP '2024-02-01') AS BIGINT)"
_TALKS = f"""talks AS (
    SELECT conv_id, CAST(conv_id AS VARCHAR) AS conversation_id, CASE WHEN conv_id % 5 = 0 THEN 'analyze' ELSE 'qa' END AS scene,
      CASE conv_id % 3 WHEN 0 THEN 'named' ELSE substr(replace({q.strip(_FIRST_ASK)}, chr(10), ' '), 1, 50) END AS title,
      CAST(count(*) AS INTEGER) AS msg_count, CAST(coalesce(sum(turn * 10) FILTER (role = 'assistant'), 0) AS BIGINT) AS total_tokens,
      coalesce(min({one._BASE} + turn) FILTER (turn <> 2), {_DAY}) AS first_at, coalesce(max({one._BASE} + turn) FILTER (turn <> 2), {_UPDATED}) AS last_at,
      count(*) FILTER (role = 'assistant') AS runs FROM conversations GROUP BY conv_id)"""
_PLACED = """placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS idx,
    CASE role WHEN 'assistant' THEN 't' || conv_id || '-' || turn END AS turn_id, CASE turn WHEN 2 THEN 0 ELSE %d + turn END AS said_at FROM conversations)""" % one._BASE
_RUN = "'### run" + one._TRACE_MD.split("'### run", 1)[1].rsplit(f" || {one._NL}", 1)[0]

ORACLE = {
    "thread_messages": f"""WITH {_PLACED} SELECT conv_id, CASE conv_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS user_id, idx, role, text AS content, said_at AS created_at, turn_id,
        CASE role WHEN 'assistant' THEN turn * 10 END AS tokens FROM placed""",
    "thread_summaries": f"""WITH {_TALKS} SELECT conversation_id, scene, title, 'active' AS status, msg_count, total_tokens, first_at, last_at, {_DAY} AS created_at FROM talks""",
    "thread_page": f"""WITH {_TALKS} SELECT conversation_id, title, msg_count, last_at FROM talks WHERE conv_id % 2 = 0 AND scene = 'qa'
        ORDER BY {_UPDATED} DESC, conv_id LIMIT 40 OFFSET 3""",
    "thread_details": f"""WITH {_TALKS}, lists AS (SELECT conv_id, md5(string_agg(text, '|' ORDER BY turn)) AS contents, string_agg(role, '|' ORDER BY turn) AS roles,
        coalesce(string_agg('run-' || conv_id || '-' || turn, '|' ORDER BY turn) FILTER (role = 'assistant'), '') AS runs FROM conversations GROUP BY 1)
        SELECT conversation_id, total_tokens AS tokens, contents, roles, lists.runs, talks.runs > 0 AS has_trace FROM talks JOIN lists USING (conv_id)""",
    "thread_turns": f"""WITH {_PLACED} SELECT CAST(conv_id AS VARCHAR) AS conversation_id, turn_id, 'ask' AS user_message, text AS assistant_reply, CAST(3 AS INTEGER) AS n_events
        FROM placed WHERE role = 'assistant'""",
    "thread_hits": f"""WITH {_PLACED} SELECT CAST(conv_id AS VARCHAR) AS conversation_id, coalesce(turn_id, '') AS turn_id, idx AS event_id, substr(text, 1, 200) AS snippet, CAST(1 AS DOUBLE) AS score,
        role AS type, said_at AS created_at FROM placed WHERE contains(lower(text), 'en') ORDER BY said_at DESC, CAST(conv_id AS VARCHAR), idx LIMIT 60""",
    "thread_hits_indexed": f"""WITH {_PLACED} SELECT CAST(conv_id AS VARCHAR) AS conversation_id, coalesce(turn_id, '') AS turn_id, idx AS event_id, substr(text, 1, 200) AS snippet, CAST(1 AS DOUBLE) AS score,
        role AS type, said_at AS created_at FROM placed WHERE contains(lower(text), 'tion') ORDER BY said_at DESC, CAST(conv_id AS VARCHAR), idx LIMIT 60""",
    "thread_exports": f"""WITH {_TALKS}, said AS (SELECT conv_id, string_agg('**' || role || '**：' || text, {_NL} ORDER BY turn) AS talk,
          string_agg({_RUN}, {_NL} ORDER BY turn) FILTER (role = 'assistant') AS traces FROM conversations GROUP BY 1)
        SELECT conversation_id, '# 会话复盘文档' || {_NL} || {_NL} || '- 会话 ID：`' || conversation_id || '`' || {_NL} || '- 场景：' || scene || {_NL} || '- 标题：' || coalesce(nullif(title, ''), '—') || {_NL}
          || '- 状态：active' || {_NL} || '- 消息数：' || msg_count || '　累计 token：' || total_tokens || {_NL} || {_NL} || '## 主消息流' || {_NL} || {_NL} || talk || {_NL} || {_NL}
          || coalesce('## 执行轨迹（trace）' || {_NL} || {_NL} || traces || {_NL}, '') AS document FROM talks JOIN said USING (conv_id)""",
    "thread_json": f"""WITH {_TALKS}, nth AS (SELECT conv_id, list(text ORDER BY turn)[2] AS second,
          (list('t' || conv_id || '-' || turn ORDER BY turn) FILTER (role = 'assistant'))[2] AS second_trace FROM conversations GROUP BY 1)
        SELECT conversation_id, CAST(msg_count AS VARCHAR) AS n, second, second_trace FROM talks JOIN nth USING (conv_id)""",
    "thread_reviews": f"""WITH {_TALKS}, said AS (SELECT conv_id, coalesce(string_agg('- ' || text || {_NL}, '' ORDER BY turn) FILTER (role = 'user'), '') AS asks,
          coalesce(string_agg({_NL} || '- [expert_opinion/Banking] assistant' || {_NL} || '- [rag_hit/rag] hit （溯源：d1 / T / score=0.5）', '') FILTER (role = 'assistant'), '') AS found
          FROM conversations GROUP BY 1)
        SELECT conversation_id, '【会话复盘上下文】' || {_NL} || '场景：' || scene || '；标题：' || coalesce(nullif(title, ''), '未知') || {_NL} || {_NL} || '=== 用户诉求 ===' || {_NL}
          || asks || {_NL} || '=== 各智能体结论 / RAG 依据 / 审核风控 ===' || found AS context FROM talks JOIN said USING (conv_id)""",
}
