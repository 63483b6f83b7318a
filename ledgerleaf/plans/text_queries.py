"""Registered queries: sources, text scalars, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerleaf.functions import display, routing, structured, text as tx
from ledgerleaf.functions.redact import redact_email, redact_struct, redact_text
from ledgerleaf.operators.chunking import chunk_text
from ledgerleaf.operators.fusion import format_passage
from ledgerleaf.operators.lifecycle import USER_DEFAULTS, backfill_columns
from ledgerleaf.operators.transcript import derive_titles
from ledgerleaf.plans import sqlparts as q
from ledgerleaf.plans.corpus import spread
from ledgerleaf.plans.ingest import ingest_documents
from ledgerleaf.sources.chat_json import parse_chat_lines, read_chat_json, write_training_parquet
from ledgerleaf.sources.files import (
    NO_PDF_TEXT, NO_WORD_TEXT, SUPPORTED, corpus_documents, dispatch_by_extension, extract_legacy_doc_text, parse_frontmatter,
)
from ledgerleaf.session import scratch_path


def table(spark, sf, name):
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


# Word lists for the test texts, which hold no Chinese words.
TEST_HINTS = {
    "Banking": ("tion", "heed"), "Securities": ("eau", "elle"), "Insurance": ("ción",), "Trust": ("ung ", "sche"),
    "MutualFunds": ("zzzz",),
}
TEST_PROMISES = ("the ", "que ")


def _hint_sql(column: str) -> str:
    parts = []
    for scene, words in TEST_HINTS.items():
        any_word = " OR ".join(f"contains({column}, {q.text(w)})" for w in words)
        parts.append(f"CASE WHEN {any_word} THEN '{scene}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def strip_html_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


def document_summaries(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.make_summary(F.col("text")).alias("summary"))


def document_words(spark, sf):
    words = tx.tokenize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(words).alias("n"), F.array_join(words, " ").alias("words"))


def normalized_tags(spark, sf):
    tags = tx.normalize_domain_tags(F.replace("url", F.lit("/"), F.lit(" , ")))
    return table(spark, sf, "pages").select("page_id", tags.alias("tags"))


def redacted_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", redact_text(F.col("text")).alias("text"))


def redacted_emails(spark, sf):
    return table(spark, sf, "documents").select("doc_id", redact_email(F.col("text")).alias("text"))


def redacted_records(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.struct(
            F.col("text").alias("body"), F.array("source", "text").alias("parts"),
            F.create_map(F.lit("note"), F.col("text")).alias("extra"), F.col("n_chars").alias("n"),
        ).alias("record"),
    )
    rows = rows.withColumn("record", redact_struct(F.col("record"), rows.schema["record"].dataType))
    return rows.select(
        "doc_id", F.col("record.body").alias("body"), F.col("record.parts")[1].alias("part"),
        F.col("record.extra")["note"].alias("note"), F.col("record.n").alias("n"),
    )


def truncated_titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.truncate_title(F.col("text")).alias("title"))


def derived_titles(spark, sf):
    messages = table(spark, sf, "conversations").withColumnsRenamed({"turn": "idx", "text": "content"})
    return derive_titles(messages)


def event_epochs(spark, sf):
    ts = F.col("ts").cast("string")
    iso = F.concat(F.substring(ts, 1, 10), F.lit("T"), F.substring(ts, 12, 8), F.lit("Z"))
    ms = tx.to_epoch_ms(ts)
    return table(spark, sf, "events").select(
        "event_id", ms.alias("from_text"), tx.to_epoch_ms(iso).alias("from_iso"),
        tx.to_epoch_ms(F.floor(ms / 1000).cast("string")).alias("from_seconds"),
        tx.to_epoch_ms(F.col("event_type")).alias("from_word"), tx.epoch_ms_to_iso(ms).alias("back"),
    )


def matched_scenes(spark, sf):
    scenes = F.array_join(routing.match_scenes(F.col("text"), TEST_HINTS), ",")
    return table(spark, sf, "documents").select("doc_id", scenes.alias("scenes"))


_ROUTE = "CASE lang WHEN 'en' THEN ' Trust.; ' WHEN 'fr' THEN 'Multi' WHEN 'de' THEN 'Direct' ELSE lang END"


def resolved_scenes(spark, sf):
    docs = table(spark, sf, "documents").withColumn("route", F.expr(_ROUTE))
    return docs.select(
        "doc_id", routing.resolve_scene(F.col("route"), F.col("text"), TEST_HINTS).alias("scene"),
        F.array_join(routing.consulted_experts(F.col("text"), TEST_HINTS), ",").alias("experts"),
    )


def parsed_scenes(spark, sf):
    scene = routing.parse_scene(F.col("url"), ("Example.org", "Example.net", "EN"))
    return table(spark, sf, "pages").select("page_id", scene.alias("scene"))


def compliance_notes(spark, sf):
    notes = routing.compliance_notes(F.col("text"), TEST_PROMISES)
    return table(spark, sf, "conversations").select("conv_id", "turn", notes.alias("notes"))


_PLAIN = "trim(regexp_replace(text, '[^A-Za-z]+', ' '))"
_ANSWER = (
    "concat('say {\"intent\": \"', role, '\", \"slots\": {\"turn\": ', turn, ', \"who\": \"', role,"
    " '\"}, \"tool_plan\": [\"a\", \"b\"], \"expression\": \"', {plain}, '\"} end')"
)


def structured_answers(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("answer", F.expr(_ANSWER.replace("{plain}", _PLAIN)))
    parsed = rows.withColumn("p", structured.parse_structured(F.col("answer")))
    return parsed.select(
        "conv_id", "turn", F.col("p.intent").alias("intent"), F.col("p.slots")["turn"].alias("slot_turn"),
        F.array_join("p.tool_plan", ",").alias("plan"), F.col("p.expression").alias("expression"),
    )


def unfenced_answers(spark, sf):
    fenced = F.expr("concat('```json\\n{\"role\": \"', role, '\", \"turn\": ', turn, '}\\n```')")
    listed = F.expr("concat('[\"', role, '\", {\"turn\": ', turn, '}]')")
    answer = F.when(F.col("role") == "user", fenced).when(F.col("role") == "assistant", listed).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", structured.strip_json_fence(answer).alias("text"))


def split_thinking(spark, sf):
    response = F.when(
        F.col("role") == "assistant", F.concat(F.lit("x <think> "), F.col("text"), F.lit("\n</think>\n"), F.col("role"))
    ).otherwise(F.col("text"))
    parts = structured.split_think(response)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", parts["thinking"].alias("thinking"), parts["output"].alias("output")
    )


def entity_keys(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.entity_key(F.col("text")).alias("key"))


_KIND = "CASE event_type WHEN 'click' THEN 'Person' WHEN 'view' THEN 'BANK' ELSE event_type END"


def core_types(spark, sf):
    return table(spark, sf, "events").select("event_id", display.is_core_type(F.expr(_KIND)).alias("core"))


def entity_summaries(spark, sf):
    nations = table(spark, sf, "nation")
    rows = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    props = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("key"), F.col("c_custkey").cast("string"))
    return rows.select(
        "c_custkey", display.entity_summary(F.col("c_name"), F.lit("Company"), F.col("n_name"), props).alias("summary")
    )


_AGENT = "CASE turn WHEN 0 THEN 'BankingExpert' WHEN 1 THEN '' WHEN 2 THEN 'Stranger' WHEN 3 THEN NULL ELSE 'review' END"
_AS_ROLE = "CASE role WHEN 'user' THEN 'agent' ELSE role END"


def agent_displays(spark, sf):
    shown = display.agent_display(F.expr(_AGENT), F.expr(_AS_ROLE))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", shown["key"].alias("key"), shown["name"].alias("name"), shown["avatar"].alias("avatar")
    )


def passage_texts(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.expr("CASE WHEN lang = 'en' THEN source END").alias("title"), F.lit("base").alias("source"),
        F.col("lang").alias("domain"), F.expr("CASE WHEN n_chars > 1000 THEN '1' ELSE '2' END").alias("version"),
        F.expr("CASE WHEN n_chars > 500 THEN 0.5D ELSE 0.0D END").alias("score"), F.lit("").alias("agency"),
        F.lit("2024-01-01").alias("effective_date"), F.expr("CASE WHEN lang = 'fr' THEN 'C' END").alias("chapter"),
        F.col("text").alias("content"),
    )
    return docs.select("doc_id", format_passage(F.col("doc_id")).alias("passage"))


_FRONT = "concat('---\\n title : \"', source, '\"\\nlang: ', lang, '\\nlang: ''last''\\nno pair\\n---\\n', text)"


def front_matter(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", parse_frontmatter(F.expr(_FRONT.replace("''", "\\'"))).alias("f"))
    return rows.select(
        "doc_id", F.col("f.meta")["title"].alias("title"), F.col("f.meta")["lang"].alias("lang"),
        F.size("f.meta").alias("n"), F.col("f.body").alias("body"),
    )


def corpus_file_documents(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("/kb/p"), F.col("page_id").cast("string"), F.lit(".HTM")).alias("path"), F.col("html").alias("text")
    )
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("/kb/d"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "fr", ".txt").otherwise(".csv")).alias("path"),
        F.expr(_FRONT.replace("''", "\\'")).alias("text"),
    )
    rows = corpus_documents(pages.unionByName(docs))
    return rows.select("doc_id", "title", "doc_type", "version", "source_path", F.length("text").alias("n_chars"))


def legacy_doc_texts(spark, sf):
    rows = table(spark, sf, "documents").withColumn("raw", F.encode("text", "UTF-16LE"))
    return rows.select("doc_id", extract_legacy_doc_text(F.col("raw")).alias("text"))


def _uploads(spark, sf):
    """Uploads from four tables, with supported, unsupported, empty and unreadable ones."""
    pages = table(spark, sf, "pages").selectExpr(
        "concat('page', page_id, '.html') AS filename", "encode(html, 'UTF-8') AS content", "url AS user_id"
    )
    docs = table(spark, sf, "documents").selectExpr(
        "concat('doc', doc_id, CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.TXT' WHEN 'de' THEN '.xlsx' ELSE '' END) AS filename",
        "encode(text, 'UTF-8') AS content", "source AS user_id",
    )
    talks = table(spark, sf, "conversations").selectExpr(
        "concat('talk', conv_id, '-', turn, CASE role WHEN 'user' THEN '.pdf' WHEN 'system' THEN '.DOCX' ELSE '.txt' END) AS filename",
        "encode(CASE WHEN turn = 1 THEN ' \\n ' WHEN role = 'system' THEN concat('PK', char(3), char(4), text) ELSE text END, 'UTF-8') AS content",
        "role AS user_id",
    )
    return pages.unionByName(docs).unionByName(talks).withColumn("id", F.col("filename")).withColumn("uploaded_at", F.lit("2024"))


def dispatched_files(spark, sf):
    rows = dispatch_by_extension(_uploads(spark, sf))
    return rows.select("filename", "ext", "error", F.when(F.col("error").isNull(), F.length("text")).alias("n_chars"))


def ingest_status(spark, sf):
    docs = ingest_documents(_uploads(spark, sf))["documents"]
    return docs.groupBy("status", "error").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum(F.length("summary")).alias("summary_chars")
    )


def chunked_documents(spark, sf):
    return chunk_text(table(spark, sf, "documents"))


_SECTIONS = "concat('  # ', url, '\\n', {flat}, '\\n## empty\\n\\nNotes:\\n', url, '\\r\\nnot a heading.')"


def chunked_sections(spark, sf):
    flat = F.regexp_replace("html", r"[\s:#]+", " ")
    pages = table(spark, sf, "pages").withColumn("flat", flat)
    docs = pages.select("page_id", F.expr(_SECTIONS.replace("{flat}", "flat")).alias("text"))
    # One chunk for each section, so that whole pages are compared.
    return chunk_text(docs, 10_000_000, keep=("page_id",))


def backfilled_users(spark, sf):
    users = table(spark, sf, "customer").select("c_custkey", "c_name")
    return backfill_columns(backfill_columns(users, USER_DEFAULTS), {"c_name": "x"})


def _chat_lines(spark, sf):
    """Each message as a chat record; user messages as bare lists."""
    message = "to_json(named_struct('role', role, 'content', text))"
    return table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn",
        f"CASE role WHEN 'user' THEN concat('[', {message}, ']')"
        f" ELSE concat('{{\"id\": \"', conv_id, '\", \"messages\": [', {message}, ']}}') END AS value",
    )


def chat_records(spark, sf):
    rows = parse_chat_lines(_chat_lines(spark, sf))
    return rows.select(
        "conv_id", "turn", F.size("messages").alias("n"), F.col("messages")[0]["role"].alias("role"),
        F.col("messages")[0]["content"].alias("content"),
    )


def chat_file_round_trip(spark, sf):
    """Chat records to a file of lines, read back, written as a training table, read back."""
    lines, out = scratch_path(spark, "chat"), scratch_path(spark, "train")
    records = table(spark, sf, "conversations").select(
        F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"))).alias("value")
    )
    records.write.text(lines)
    write_training_parquet(read_chat_json(spark, lines), out)
    m = F.col("messages")[0]
    return spark.read.parquet(out).select(m["role"].alias("role"), m["content"].alias("content"))


QUERIES = {
    "strip_html_pages": strip_html_pages, "document_summaries": document_summaries, "document_words": document_words,
    "normalized_tags": normalized_tags, "redacted_documents": redacted_documents, "redacted_emails": redacted_emails,
    "redacted_records": redacted_records, "truncated_titles": truncated_titles, "derived_titles": derived_titles,
    "event_epochs": event_epochs, "matched_scenes": matched_scenes, "resolved_scenes": resolved_scenes,
    "parsed_scenes": parsed_scenes, "compliance_notes": compliance_notes, "structured_answers": structured_answers,
    "unfenced_answers": unfenced_answers, "split_thinking": split_thinking, "entity_keys": entity_keys,
    "core_types": core_types, "entity_summaries": entity_summaries, "agent_displays": agent_displays,
    "passage_texts": passage_texts, "front_matter": front_matter, "corpus_file_documents": corpus_file_documents,
    "legacy_doc_texts": legacy_doc_texts, "dispatched_files": dispatched_files, "ingest_status": ingest_status,
    "chunked_documents": chunked_documents, "chunked_sections": chunked_sections, "backfilled_users": backfilled_users,
    "chat_records": chat_records, "chat_file_round_trip": chat_file_round_trip,
}

_TALK = "conv_id, turn"
_FLAT_TITLE = f"replace({q.strip('text')}, chr(10), ' ')"
_KEPT_SQL = (
    r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\x{2010}-\x{2027}\x{2018}-\x{201F}a-zA-Z0-9"
    r" ·…—、，。：；！？（）《》“”‘’.,;:!?()''" + r'"+/\-'
)
_NAMES = " ".join(f"WHEN {q.text(k)} THEN {q.text(v[1])}" for k, v in display.AGENTS.items())
_AVATARS = " ".join(f"WHEN {q.text(k)} THEN {q.text(v[0])}" for k, v in display.AGENTS.items())
_FRONT_SQL = "'---' || chr(10) || ' title : \"' || source || '\"' || chr(10) || 'lang: ' || lang || chr(10) || 'lang: ''last''' || chr(10) || 'no pair' || chr(10) || '---' || chr(10) || text"
_UPLOADS_SQL = f"""
uploads AS (
  SELECT 'page' || page_id || '.html' AS filename, '.html' AS ext, html AS content FROM pages
  UNION ALL SELECT 'doc' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.TXT' WHEN 'de' THEN '.xlsx' ELSE '' END,
    CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.txt' WHEN 'de' THEN '.xlsx' ELSE '' END, text FROM documents
  UNION ALL SELECT 'talk' || conv_id || '-' || turn || CASE role WHEN 'user' THEN '.pdf' WHEN 'system' THEN '.DOCX' ELSE '.txt' END,
    CASE role WHEN 'user' THEN '.pdf' WHEN 'system' THEN '.docx' ELSE '.txt' END,
    CASE WHEN turn = 1 THEN ' ' || chr(10) || ' ' WHEN role = 'system' THEN 'PK' || chr(3) || chr(4) || text ELSE text END FROM conversations),
parsed AS (
  SELECT filename, ext, octet_length(encode(content)) AS size,
    CASE WHEN ext = '.html' THEN {q.strip_html('content')} WHEN ext IN ('.md', '.txt') THEN content END AS body,
    CASE WHEN ext IN ('.xlsx', '') THEN '暂不支持的文档类型：' || CASE ext WHEN '' THEN '(无扩展名)' ELSE ext END || '（本期支持 {'/'.join(SUPPORTED)}）'
         WHEN ext = '.pdf' THEN '{NO_PDF_TEXT}'
         WHEN ext = '.docx' THEN '{NO_WORD_TEXT}'
         WHEN {q.strip("CASE WHEN ext = '.html' THEN " + q.strip_html('content') + " ELSE content END")} = '' THEN '文档内容为空，无可解析文本。' END AS error
  FROM uploads)"""

ORACLE = {
    "strip_html_pages": f"SELECT page_id, {q.strip_html('html')} AS text FROM pages",
    "document_summaries": f"SELECT doc_id, {q.summary('text')} AS summary FROM documents",
    "document_words": f"SELECT doc_id, CAST(len({q.words('text')}) AS INTEGER) AS n, array_to_string({q.words('text')}, ' ') AS words FROM documents",
    "normalized_tags": "SELECT page_id, array_to_string(list_filter(list_transform(string_split(url, '/'), lambda x: trim(x)), lambda x: x <> ''), ',') AS tags FROM pages",
    "redacted_documents": f"SELECT doc_id, {q.redact('text')} AS text FROM documents",
    "redacted_emails": f"SELECT doc_id, {q.redact_email('text')} AS text FROM documents",
    "redacted_records": f"SELECT doc_id, {q.redact('text')} AS body, {q.redact('text')} AS part, {q.redact('text')} AS note, n_chars AS n FROM documents",
    "truncated_titles": f"SELECT doc_id, CASE WHEN length(text) > 0 THEN substr({_FLAT_TITLE}, 1, 50) END AS title FROM documents",
    "derived_titles": f"""
        WITH firsts AS (SELECT conv_id, {q.strip("arg_min(text, turn) FILTER (role = 'user')")} AS t FROM conversations GROUP BY conv_id)
        SELECT conv_id, CASE WHEN t IS NULL THEN '新对话' WHEN length(t) > 20 THEN substr(t, 1, 20) || '…' ELSE t END AS title FROM firsts""",
    "event_epochs": """
        WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, ts FROM events)
        SELECT event_id, ms AS from_text, ms - ms % 1000 AS from_iso, ms - ms % 1000 AS from_seconds, CAST(NULL AS BIGINT) AS from_word,
          strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN ms % 1000 = 0 THEN '' ELSE '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || '000' END || '+00:00' AS back
        FROM e""",
    "matched_scenes": f"SELECT doc_id, array_to_string({_hint_sql('text')}, ',') AS scenes FROM documents",
    "resolved_scenes": f"""
        WITH d AS (SELECT doc_id, lang, {_hint_sql('text')} AS m FROM documents)
        SELECT doc_id, CASE lang WHEN 'en' THEN 'Trust' WHEN 'fr' THEN 'Multi'
            ELSE CASE len(m) WHEN 0 THEN 'Direct' WHEN 1 THEN m[1] ELSE 'Multi' END END AS scene,
          array_to_string(CASE WHEN len(m) = 0 THEN ['Banking', 'Securities', 'Insurance'] ELSE m[1:3] END, ',') AS experts FROM d""",
    "parsed_scenes": """SELECT page_id, CASE WHEN contains(lower(url), 'example.org') THEN 'Example.org' WHEN contains(lower(url), 'example.net') THEN 'Example.net'
        WHEN contains(lower(url), 'en') THEN 'EN' END AS scene FROM pages""",
    "compliance_notes": f"""SELECT {_TALK}, CASE WHEN contains(text, 'the ') OR contains(text, 'que ') THEN '{routing.PROMISE_NOTE}' || chr(10) ELSE '' END
        || '{routing.STANDARD_NOTE}' AS notes FROM conversations""",
    "structured_answers": f"""SELECT {_TALK}, role AS intent, CAST(turn AS VARCHAR) AS slot_turn, 'a,b' AS plan,
        trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS expression FROM conversations""",
    "unfenced_answers": f"""SELECT {_TALK}, CASE role WHEN 'user' THEN 'role: user' || chr(10) || 'turn: ' || turn
        WHEN 'assistant' THEN 'assistant' || chr(10) || 'turn: ' || turn ELSE {q.strip('text')} END AS text FROM conversations""",
    "split_thinking": f"""SELECT {_TALK}, CASE WHEN role = 'assistant' THEN {q.strip('text')} ELSE '' END AS thinking,
        CASE WHEN role = 'assistant' THEN 'assistant' ELSE {q.strip('text')} END AS output FROM conversations""",
    "entity_keys": f"SELECT item_id, lower(regexp_replace(text, '{q.WS}+', '', 'g')) AS key FROM benchmark",
    "core_types": "SELECT event_id, event_type IN ('click', 'view') AS core FROM events",
    "entity_summaries": """SELECT c_custkey, '【实体】' || c_name || '（类型：Company）' || chr(10) || '来源文档：' || n_name || chr(10) || 'segment：' || c_mktsegment
        || chr(10) || 'key：' || c_custkey AS summary FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "agent_displays": f"""
        WITH k AS (SELECT {_TALK}, CASE WHEN coalesce({_AGENT}, '') <> '' THEN {_AGENT} WHEN role = 'user' THEN 'Coordinator' ELSE 'Direct' END AS key FROM conversations)
        SELECT {_TALK}, key, CASE key {_NAMES} WHEN 'Direct' THEN 'Assistant' ELSE key END AS name, CASE key {_AVATARS} ELSE '🤖' END AS avatar FROM k""",
    "passage_texts": """SELECT doc_id, '[' || doc_id || '] ' || CASE WHEN lang = 'en' THEN '来源《' || source || '》' ELSE '来源：base' END || '｜领域：' || lang || '｜生效：2024-01-01'
        || CASE WHEN n_chars > 1000 THEN '' ELSE '｜版本：2' END || CASE WHEN n_chars > 500 THEN '｜相关度：0.50' ELSE '' END
        || CASE WHEN lang = 'fr' THEN chr(10) || '章节：C' ELSE '' END || chr(10) || text AS passage FROM documents""",
    "front_matter": "SELECT doc_id, source AS title, 'last' AS lang, CAST(2 AS INTEGER) AS n, text AS body FROM documents",
    "corpus_file_documents": f"""
        SELECT 'p' || page_id || '.HTM' AS doc_id, 'p' || page_id || '.HTM' AS title, 'internal' AS doc_type, '1' AS version,
          '/kb/p' || page_id || '.HTM' AS source_path, CAST(length({q.strip_html('html')}) AS INTEGER) AS n_chars FROM pages
        UNION ALL SELECT 'd' || doc_id || CASE lang WHEN 'en' THEN '.md' ELSE '.txt' END,
          CASE lang WHEN 'en' THEN source ELSE 'd' || doc_id || '.txt' END, 'internal', '1',
          '/kb/d' || doc_id || CASE lang WHEN 'en' THEN '.md' ELSE '.txt' END,
          CAST(length(CASE lang WHEN 'en' THEN text ELSE {_FRONT_SQL} END) AS INTEGER) FROM documents WHERE lang IN ('en', 'fr')""",
    "legacy_doc_texts": f"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^{_KEPT_SQL}]', '', 'g'), '{q.WS}+', ' ', 'g')) AS text FROM documents",
    "dispatched_files": f"WITH {_UPLOADS_SQL} SELECT filename, ext, error, CASE WHEN error IS NULL THEN CAST(length(body) AS INTEGER) END AS n_chars FROM parsed",
    "ingest_status": f"""WITH {_UPLOADS_SQL}
        SELECT CASE WHEN error IS NULL THEN 'done' ELSE 'error' END AS status, error, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes,
          CAST(sum(CASE WHEN error IS NULL THEN length({q.summary('body')}) END) AS BIGINT) AS summary_chars FROM parsed GROUP BY 1, 2""",
    "chunked_documents": f"WITH RECURSIVE {q.chunks_cte('documents', 'doc_id', 'text')} SELECT doc_key AS doc_id, idx, chapter, content AS text FROM packed",
    "chunked_sections": r"""
        WITH p AS (SELECT page_id, url, trim(regexp_replace(html, '[\t\n\v\f\r :#]+', ' ', 'g')) AS body FROM pages)
        SELECT page_id, CAST(0 AS INTEGER) AS idx, '# ' || url AS chapter, '# ' || url || chr(10) || body AS text FROM p
        UNION ALL SELECT page_id, 1, 'Notes:', 'Notes:' || chr(10) || url || chr(10) || 'not a heading.' FROM p""",
    "backfilled_users": "SELECT c_custkey, c_name, '' AS hashed_password, CAST(1 AS INTEGER) AS is_active FROM customer",
    "chat_records": f"SELECT {_TALK}, CAST(1 AS INTEGER) AS n, role, text AS content FROM conversations",
    "chat_file_round_trip": "SELECT role, text AS content FROM conversations",
}
