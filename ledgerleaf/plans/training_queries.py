"""Registered queries: training tables, rewards, metric series, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerleaf.operators import training as tr
from ledgerleaf.plans import sqlparts as q
from ledgerleaf.plans.corpus import build_corpus
from ledgerleaf.plans.text_queries import table
from ledgerleaf.session import scratch_path
from ledgerleaf.sources.metric_logs import read_metric_logs
from ledgerleaf.streaming import jobs

HUMAN = (*tr.HUMAN_ROLES, "user")  # the test table spells the human's role "user"
_WITH_THOUGHT = "CASE role WHEN 'assistant' THEN concat('<think> because ', turn, '</think> ', text) ELSE text END"


def _messages(spark, sf):
    return table(spark, sf, "conversations").selectExpr("conv_id", "turn AS idx", "role", f"{_WITH_THOUGHT} AS content")


def _raw_roles(spark, sf):
    """Role names as chat exports spell them."""
    role = "CASE role WHEN 'user' THEN 'HUMAN' WHEN 'assistant' THEN 'GPT' ELSE role END"
    return table(spark, sf, "conversations").selectExpr("conv_id", "turn AS idx", f"{role} AS role", "text AS content")


def sft_messages(spark, sf):
    return tr.sft_message_rows(_raw_roles(spark, sf))


def sft_records(spark, sf):
    """Every message as a record with a question in front."""
    records = _raw_roles(spark, sf).selectExpr(
        "array(named_struct('role', 'USER', 'content', concat('q', conv_id, '-', idx)), named_struct('role', role, 'content', content)) AS messages"
    )
    m = lambda i, part: F.col("messages")[i][part]
    return tr.prepare_sft(records).select(
        m(0, "role").alias("role0"), m(0, "content").alias("content0"), m(1, "role").alias("role1"), m(1, "content").alias("content1")
    )


def dapo_records(spark, sf):
    records = _raw_roles(spark, sf).selectExpr(
        "array(named_struct('role', 'user', 'content', 'skipped'), named_struct('role', 'human', 'content', concat('q', conv_id, '-', idx)),"
        " named_struct('role', 'ASSISTANT', 'content', concat('<think>', role, ' </think>', content))) AS messages"
    )
    info = lambda key: F.get_json_object("extra_info", f"$.{key}")
    return tr.prepare_dapo(records).select(
        F.size("messages").alias("n"), F.col("messages")[0]["role"].alias("role"), info("question").alias("question"),
        info("gold_thinking").alias("gold_thinking"), info("gold_output").alias("gold_output"),
    )


def dapo_extra_info(spark, sf):
    return tr.dapo_extra_info(_messages(spark, sf), HUMAN)


def prompt_messages(spark, sf):
    return tr.prompt_rows(_messages(spark, sf), HUMAN)


def opd_records(spark, sf):
    records = _raw_roles(spark, sf).selectExpr("conv_id", "array(named_struct('role', role, 'content', content)) AS messages")
    rows = tr.prepare_opd(records, "chat")
    return rows.select(F.size("messages").alias("n"), F.try_element_at("messages", F.lit(1))["content"].alias("content"), "data_source")


def format_gates(spark, sf):
    return _messages(spark, sf).select("conv_id", "idx", tr.format_gate(F.col("content")).alias("passes"))


def judge_prompts(spark, sf):
    question = F.when(F.col("idx") > 1, F.concat(F.lit("q"), F.col("idx").cast("string")))
    prompt = tr.judge_prompt(question, F.col("role"), F.lit("gold"), F.col("content"))
    return _messages(spark, sf).select("conv_id", "idx", prompt.alias("prompt"))


_SCORES = """CASE event_type WHEN 'error' THEN 'no json'
  WHEN 'click' THEN concat('{"dimensions": {"correctness": ', value, ', "reasoning": "7", "other": 3}, "rationale": "r"}')
  WHEN 'view' THEN concat('{"dimensions": {"correctness": ', value, ', "reasoning": "seven"}}')
  ELSE concat('{"dimensions": {"correctness": ', value, ', "reasoning": -', value, ', "compliance_risk": 4, "clarity_format": 10}}') END"""


def parsed_scores(spark, sf):
    rows = table(spark, sf, "events").select("event_id", tr.parse_scores(F.expr(_SCORES)).alias("s"))
    return rows.select(
        "event_id", F.size("s").alias("n"), F.col("s")["correctness"].alias("correctness"), F.col("s")["reasoning"].alias("reasoning")
    )


def rewards(spark, sf):
    response = F.expr("CASE WHEN user_id > 10 THEN '<think>a</think>b' ELSE '<think>a' END")
    reward = tr.compute_reward(response, F.expr(_SCORES))
    return table(spark, sf, "events").select("event_id", F.round(reward, 6).alias("reward"))


# A log line per event: its step key and value fields differ by event type.
_LOG = """CASE event_type WHEN 'error' THEN 'not json' WHEN 'signup' THEN concat('{"loss": ', value, '}')
  WHEN 'click' THEN concat('{"step": ', user_id, ', "actor/loss": ', value, ', "flag": true, "name": "x"}')
  WHEN 'view' THEN concat('  {"global_step": "', user_id, '", "reward/mean": ', value, ', "critic/score/mean": ', user_id, '}')
  ELSE concat('{"_step": ', user_id, '.7, "step_time": ', value, ', "none": null}') END"""


def _log_lines(spark, sf):
    return table(spark, sf, "events").selectExpr("array('logs', CAST(dayofweek(ts) AS STRING)) AS file", "event_id AS line_no", f"{_LOG} AS line")


def metric_points(spark, sf):
    return tr.parse_metric_lines(_log_lines(spark, sf)).select("line_no", "metric", "step", "value")


def metric_series(spark, sf):
    return tr.metric_series(tr.parse_metric_lines(_log_lines(spark, sf)))


def metric_log_files(spark, sf):
    """The log lines in order of their number, written to files and read back as a log folder."""
    folder = scratch_path(spark, "logs")
    _log_lines(spark, sf).orderBy("line_no").select("line").write.text(folder)
    return read_metric_logs(spark, folder, names="*.txt")


def metric_charts(spark, sf):
    return tr.resolve_metric_groups(metric_series(spark, sf), tr.RL_METRICS)


# ---------------------------------------------------------------- streams
_EVENT = """CASE role WHEN 'user' THEN to_json(named_struct('type', CASE turn WHEN 0 THEN 'route' ELSE 'agent_message' END, 'agent', 'Banking', 'avatar', 'a', 'content', text))
  WHEN 'assistant' THEN to_json(named_struct('type', 'done', 'reply', text, 'conversation_id', conv_id))
  ELSE to_json(named_struct('type', 'error', 'detail', text)) END"""
_LINE = f"CASE WHEN turn = 4 THEN 'data: {{broken' WHEN turn = 5 THEN ': ping' ELSE concat('data: ', {_EVENT}) END"


def _stream_lines(df):
    return df.selectExpr("conv_id AS run_id", "turn AS seq", f"{_LINE} AS line", "timestamp_seconds(1700000000 + turn) AS at")


def folded_chat_runs(spark, sf):
    return jobs.fold_chat_stream(_stream_lines(table(spark, sf, "conversations")))


def _stream_of(spark, sf, name):
    # A glob names the table whether it is one file or a folder of files.
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}[.]parquet")


def streamed_chat_messages(spark, sf):
    """The same messages as a batch, written by a streaming query."""
    out, state = scratch_path(spark, "chat-out"), scratch_path(spark, "chat-state")
    rows = jobs.chat_messages(_stream_lines(_stream_of(spark, sf, "conversations")))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select("run_id", "seq", "role", "content", "agent", "type", "conversation_id")


def streamed_folds(spark, sf):
    """The fold as a stream with state per run: stopped half-way, restarted, and with a part of the lines replayed."""
    lines = _stream_lines(table(spark, sf, "conversations"))
    source, out, state = (scratch_path(spark, name) for name in ("fold-in", "fold-out", "fold-state"))
    for part in ("seq % 2 = 0 OR seq = 1", "seq % 2 = 1 OR seq % 4 = 2"):
        lines.where(part).write.mode("append").parquet(source)
        jobs.write_folds(spark.readStream.schema(lines.schema).parquet(source), out, state).awaitTermination()
    folds = jobs.latest_folds(spark, out)
    return folds.select(F.col("run_id").cast("long").alias("run_id"), "reply", "conversation_id", "agent_messages", "failed", "detail")


def streamed_documents(spark, sf):
    """Documents chunked and stored by a streaming query, twice: the second version replaces the first."""
    out = scratch_path(spark, "ingest")
    for version in (1, 2):
        docs = _stream_of(spark, sf, "documents").selectExpr("doc_id", "text", f"{version} AS version", "doc_id AS arrived_at")
        state = scratch_path(spark, "ingest-state")
        jobs.ingest_stream(docs, build_corpus, out, state).awaitTermination()
    rows = jobs.current_rows(spark.read.parquet(out))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("version").alias("version"), F.min("version").alias("oldest"))


def streamed_runs(spark, sf):
    """Runs recorded on stored messages by a streaming query; unreadable ones set aside."""
    stored, bad, state = (scratch_path(spark, name) for name in ("messages", "quarantine", "runs-state"))
    talk = table(spark, sf, "conversations")
    messages = talk.selectExpr("conv_id", "turn AS idx", "role", "text AS content", "turn AS created_at", "CAST(NULL AS STRING) AS trace")
    jobs.write_buckets(messages, stored, "conv_id", 8)
    payloads = _stream_of(spark, sf, "conversations").selectExpr(
        """CASE role WHEN 'assistant' THEN to_json(named_struct('conv_id', conv_id, 'run_id', concat('r', turn), 'at', turn, 'reply', text,
             'trace', concat('call 13800138000 or me@example.org ', turn))) ELSE concat('oops ', conv_id, '-', turn) END AS payload"""
    )
    jobs.record_run_stream(payloads, stored, bad, state, buckets=8).awaitTermination()
    left = spark.read.parquet(stored).select(F.concat_ws("-", "conv_id", "idx").alias("what"), "trace")
    failed = spark.read.schema("payload string").json(bad).select(F.col("payload").alias("what"), F.lit("quarantined").alias("trace"))
    return left.unionByName(failed)


QUERIES = {
    "sft_messages": sft_messages, "sft_records": sft_records, "dapo_records": dapo_records, "dapo_extra_info": dapo_extra_info,
    "prompt_messages": prompt_messages, "opd_records": opd_records, "format_gates": format_gates, "judge_prompts": judge_prompts,
    "parsed_scores": parsed_scores, "rewards": rewards, "metric_points": metric_points, "metric_series": metric_series,
    "metric_log_files": metric_log_files,
    "metric_charts": metric_charts, "folded_chat_runs": folded_chat_runs, "streamed_folds": streamed_folds, "streamed_chat_messages": streamed_chat_messages,
    "streamed_documents": streamed_documents, "streamed_runs": streamed_runs,
}

_THOUGHT_SQL = "CASE role WHEN 'assistant' THEN '<think> because ' || turn || '</think> ' || text ELSE text END"
_RUBRIC = "Rubric (score each dimension 0-10):\n" + "\n".join(f"- {k}（{w:.2f}）: {d}" for k, w, d in tr.RUBRIC) + (
    '\n\nReturn ONLY JSON: {"dimensions": {"correctness": x, ...}, "rationale": "..."}'
)
_RUBRIC_SQL = " || chr(10) || ".join(q.text(line) for line in _RUBRIC.split("\n"))
_POINTS = """points AS (
  SELECT 'logs' || dayofweek(ts) AS file, event_id AS line_no, 'actor/loss' AS metric, user_id AS step, value FROM events WHERE event_type = 'click'
  UNION ALL SELECT 'logs' || dayofweek(ts), event_id, 'reward/mean', user_id, value FROM events WHERE event_type = 'view'
  UNION ALL SELECT 'logs' || dayofweek(ts), event_id, 'critic/score/mean', user_id, CAST(user_id AS DOUBLE) FROM events WHERE event_type = 'view'
  UNION ALL SELECT 'logs' || dayofweek(ts), event_id, 'step_time', user_id, value FROM events WHERE event_type = 'purchase')"""
_REWARD = """CASE WHEN user_id <= 10 THEN 0.0 WHEN event_type IN ('error', 'view') THEN 0.0
  WHEN event_type = 'click' THEN 0.4 * greatest(0, least(10, value)) / 10 + 0.3 * 0.7
  ELSE 0.4 * greatest(0, least(10, value)) / 10 + 0.3 * greatest(0, least(10, -value)) / 10 + 0.15 * 0.4 + 0.15 END"""

ORACLE = {
    "sft_messages": "SELECT conv_id, turn AS idx, role, text AS content FROM conversations",
    "sft_records": "SELECT 'user' AS role0, 'q' || conv_id || '-' || turn AS content0, role AS role1, text AS content1 FROM conversations",
    "dapo_records": f"""SELECT CAST(1 AS INTEGER) AS n, 'user' AS role, 'q' || conv_id || '-' || turn AS question,
        CASE role WHEN 'user' THEN 'HUMAN' WHEN 'assistant' THEN 'GPT' ELSE role END AS gold_thinking, {q.strip('text')} AS gold_output FROM conversations""",
    "dapo_extra_info": f"""WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS u, arg_min(turn, turn) FILTER (role = 'assistant') AS t,
          {q.strip("arg_min(text, turn) FILTER (role = 'assistant')")} AS a FROM conversations GROUP BY 1)
        SELECT conv_id, coalesce(u, '') AS question, CASE WHEN t IS NULL THEN '' ELSE 'because ' || t END AS gold_thinking, coalesce(a, '') AS gold_output FROM f""",
    "prompt_messages": "SELECT conv_id, turn AS idx, 'user' AS role, text AS content FROM conversations WHERE role = 'user'",
    "opd_records": "SELECT CAST(CASE role WHEN 'user' THEN 1 ELSE 0 END AS INTEGER) AS n, CASE role WHEN 'user' THEN text END AS content, 'chat' AS data_source FROM conversations",
    "format_gates": "SELECT conv_id, turn AS idx, role = 'assistant' AS passes FROM conversations",
    "judge_prompts": f"""SELECT conv_id, turn AS idx, CASE WHEN turn > 1 THEN '[Question]' || chr(10) || 'q' || turn || chr(10) || chr(10) ELSE '' END
        || '[Reasoning — score ''reasoning'' only]' || chr(10) || 'Gold thinking:' || chr(10) || role || chr(10) || chr(10) || 'Model thinking:' || chr(10)
        || CASE role WHEN 'assistant' THEN 'because ' || turn ELSE '' END || chr(10) || chr(10)
        || '[Output — score ''correctness'', ''compliance_risk'', ''clarity_format'']' || chr(10) || 'Gold output:' || chr(10) || 'gold' || chr(10) || chr(10) || 'Model output:' || chr(10)
        || {q.strip('text')} || chr(10) || chr(10) || {_RUBRIC_SQL} AS prompt FROM conversations""",
    "parsed_scores": """SELECT event_id, CAST(CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 0 WHEN 'click' THEN 2 ELSE 4 END AS INTEGER) AS n,
        CASE WHEN event_type NOT IN ('error', 'view') THEN value END AS correctness, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN NULL WHEN 'click' THEN 7.0 ELSE -value END AS reasoning FROM events""",
    "rewards": f"SELECT event_id, round({_REWARD}, 6) AS reward FROM events",
    "metric_points": f"WITH {_POINTS} SELECT line_no, metric, step, value FROM points",
    "metric_series": f"WITH {_POINTS} SELECT metric, step, arg_max(value, file || lpad(CAST(line_no AS VARCHAR), 12, '0')) AS value FROM points GROUP BY 1, 2",
    "metric_log_files": f"WITH {_POINTS} SELECT metric, step, arg_max(value, line_no) AS value FROM points GROUP BY 1, 2",
    "metric_charts": """SELECT chart, CASE WHEN event_type IS NULL OR NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = c.event_type) THEN NULL ELSE metric END AS metric
        FROM (VALUES ('reward_mean', 'critic/score/mean', 'view'), ('actor_loss', 'actor/loss', 'click'), ('kl', NULL, NULL), ('response_length', NULL, NULL)) c(chart, metric, event_type)""",
    "folded_chat_runs": """WITH e AS (SELECT * FROM conversations WHERE turn NOT IN (4, 5))
        SELECT conv_id AS run_id, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS reply, max(conv_id) FILTER (role = 'assistant') AS conversation_id,
          count(*) FILTER (role = 'user' AND turn > 0 AND text <> '') AS agent_messages, bool_or(role NOT IN ('user', 'assistant')) AS failed,
          arg_max(text, turn) FILTER (role NOT IN ('user', 'assistant')) AS detail FROM e GROUP BY 1""",
    "streamed_chat_messages": """SELECT conv_id AS run_id, turn AS seq, CASE role WHEN 'user' THEN 'agent' ELSE 'assistant' END AS role, text AS content,
        CASE role WHEN 'user' THEN 'Banking' END AS agent, CASE role WHEN 'user' THEN 'expert_opinion' END AS type, CASE role WHEN 'assistant' THEN conv_id END AS conversation_id
        FROM conversations WHERE turn NOT IN (4, 5) AND (role = 'assistant' OR role = 'user' AND turn > 0 AND text <> '')""",
    "streamed_documents": f"""WITH RECURSIVE {q.chunks_cte('documents', 'doc_id', 'text')}
        SELECT doc_key AS doc_id, count(*) AS chunks, CAST(2 AS INTEGER) AS version, CAST(2 AS INTEGER) AS oldest FROM packed GROUP BY 1""",
    "streamed_runs": f"""WITH t AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id, {q.redact('text')}),
        plain AS (SELECT conv_id, turn, role, text FROM conversations)
        SELECT conv_id || '-' || turn AS what, CASE WHEN role = 'assistant' AND turn IN (SELECT t.turn FROM t WHERE t.conv_id = plain.conv_id) THEN 'call 138****8000 or ***@example.org ' || turn END AS trace FROM plain
        UNION ALL SELECT 'oops ' || conv_id || '-' || turn, 'quarantined' FROM conversations WHERE role <> 'assistant'""",
}
ORACLE["streamed_folds"] = ORACLE["folded_chat_runs"]
