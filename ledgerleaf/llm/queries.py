"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerleaf.llm import ann, balls, bpe, chat, crosstok, jaccard, ledger, licenses, lines, mixing, quality, sharding, suffixes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.pareto_mix(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


OP1_SQL = r"""
WITH docs AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':mix-1') AS key
    FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM totals),
room AS (SELECT *, 3 * source_size / weight AS room FROM weighed),
levels AS (
    SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER less, 0))::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER less, 0))::DOUBLE AS level
    FROM room
    WINDOW less AS (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
    SELECT source, source_size, least((3 * source_size)::DOUBLE,
        (SELECT min_by(level, room) FROM levels WHERE room >= level) * weight) AS target
    FROM levels),
classed AS (SELECT *, length(bin(size)) AS class FROM docs),
classes AS (
    SELECT c.source, class, sum(size)::BIGINT AS words, any_value(source_size) AS source_size, any_value(target) AS target
    FROM classed c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source GROUP BY c.source, class),
class_levels AS (
    SELECT *, (target - 3 * coalesce(sum(words) OVER larger, 0)::BIGINT) / nullif(sum(words * class) OVER rest, 0)::DOUBLE AS level
    FROM classes
    WINDOW larger AS (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        rest AS (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
rates AS (
    SELECT *, least(3.0::DOUBLE, coalesce(max_by(level, class) FILTER (WHERE level * class <= 3) OVER (PARTITION BY source) * class, 3.0::DOUBLE)) AS rate
    FROM class_levels),
opened AS (SELECT *, target - (sum(words * floor(rate)::BIGINT) OVER (PARTITION BY source))::DOUBLE AS open_words FROM rates),
lucky AS (
    SELECT c.*, o.source_size, o.target, o.rate, o.open_words, rate - floor(rate) AS f,
        (('0x' || substr(key, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
    FROM classed c JOIN opened o ON c.source IS NOT DISTINCT FROM o.source AND c.class = o.class),
ranked AS (SELECT *, CASE WHEN f > 0 THEN (u / (1 - u)) * ((1 - f) / f) END AS odds FROM lucky),
running AS (
    SELECT *, CASE WHEN odds IS NOT NULL
        THEN sum(size) OVER (PARTITION BY source, odds IS NULL ORDER BY odds, key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto
    FROM ranked),
first_over AS (SELECT source, min((odds, key)) AS edge FROM running WHERE upto > open_words GROUP BY source),
drawn AS (
    SELECT r.*, r.odds IS NOT NULL AND (e.edge IS NULL OR (r.odds, r.key) < e.edge) AS inside
    FROM running r LEFT JOIN first_over e ON r.source IS NOT DISTINCT FROM e.source),
gaps AS (SELECT source, any_value(open_words) - coalesce(sum(size) FILTER (WHERE inside), 0)::BIGINT AS gap FROM drawn GROUP BY source),
closing AS (
    SELECT d.source, min((abs(gap - size), odds, key)) AS best
    FROM drawn d JOIN gaps g ON d.source IS NOT DISTINCT FROM g.source
    WHERE odds IS NOT NULL AND NOT inside AND abs(gap - size) < gap GROUP BY d.source)
SELECT doc_id, size, d.source_size, d.target,
    size * (floor(rate)::BIGINT + (inside OR (odds IS NOT NULL AND coalesce(d.key = c.best[3], false)))::BIGINT) AS taken
FROM drawn d LEFT JOIN closing c ON d.source IS NOT DISTINCT FROM c.source
"""

def op2_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdict of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_report(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _op2_sql() -> str:
    """The same model in SQL: one pair of tables for each round."""
    n = len(quality.RULES)
    cases = ", ".join(
        f"CASE WHEN {bad} THEN '-' WHEN {good} THEN '+' ELSE '0' END" for bad, good in quality.RULES.values()
    )
    w, g, b = quality.PRIOR_WEIGHT, quality.BAD_VOTE_ON_GOOD, quality.BAD_VOTE_ON_BAD
    rounds = ""
    score = """post{k} AS MATERIALIZED (
        SELECT pattern, any_value(n) AS n, 1 / (1 + exp(sum(ln(bad)) + ln(1 - any_value(share)) - sum(ln(good)) - ln(any_value(share)))) AS q
        FROM cast_votes JOIN rates{k} USING (j, vote), share{k} GROUP BY pattern),
    """
    for k in range(quality.ROUNDS):
        rounds += score.format(k=k) + f"""share{k + 1} AS MATERIALIZED (
        SELECT (sum(n * q) + {w * quality.PRIOR_GOOD} * sum(n)) / ({1 + w} * sum(n)) AS share, sum(n) AS total, sum(n * q) AS good_total FROM post{k}),
    rates{k + 1} AS MATERIALIZED (
        SELECT j, vote,
            (coalesce(sum(p.n * q), 0) + {w} * any_value(total) * any_value(prior_good)) / (any_value(good_total) + {w} * any_value(total)) AS good,
            (coalesce(sum(p.n * (1 - q)), 0) + {w} * any_value(total) * any_value(prior_bad)) / (any_value(total - good_total) + {w} * any_value(total)) AS bad
        FROM all_votes LEFT JOIN cast_votes c USING (j, vote) LEFT JOIN post{k} p USING (pattern), share{k + 1} GROUP BY j, vote),
    """
    rounds += score.format(k=quality.ROUNDS)
    return rf"""
WITH words AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT r, i, (w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + d)::BIGINT AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY r),
lined AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words),
feat AS MATERIALIZED (
    SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '{quality.SYMBOLS}'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, len(l)::BIGINT AS n_lines, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}]')) AS n_letters,
        len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(t, '!')) AS n_exclaims
    FROM words JOIN lined USING (r) LEFT JOIN covered USING (r)),
voted AS MATERIALIZED (SELECT *, concat({cases}) AS pattern FROM feat),
patterns AS MATERIALIZED (SELECT pattern, count(*)::DOUBLE AS n FROM voted GROUP BY pattern),
rule_numbers AS (SELECT unnest(range(1, {n + 1})) AS j),
cast_votes AS MATERIALIZED (SELECT pattern, n, j, substr(pattern, j::INT, 1) AS vote FROM patterns, rule_numbers),
all_votes AS MATERIALIZED (
    SELECT j, vote, CASE vote WHEN '-' THEN {g}::DOUBLE ELSE {(1 - g) / 2}::DOUBLE END AS prior_good,
        CASE vote WHEN '-' THEN {b}::DOUBLE ELSE {(1 - b) / 2}::DOUBLE END AS prior_bad
    FROM rule_numbers, (SELECT unnest(['-', '0', '+']) AS vote)),
share0 AS (SELECT {quality.PRIOR_GOOD}::DOUBLE AS share),
rates0 AS (SELECT j, vote, prior_good AS good, prior_bad AS bad FROM all_votes),
{rounds}
verdicts AS (SELECT pattern, q FROM post{quality.ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AND q >= {quality.THRESHOLD} AS kept
FROM voted JOIN verdicts USING (pattern)
"""


def op4_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after cross-site boilerplate removal, lines of any length, with digest and length of its text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return lines.drop_boilerplate(docs, min_words=1).select(
        "doc_id", "lines_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")
    )


OP4_SQL = r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS l FROM documents),
lines AS MATERIALIZED (
    SELECT r, doc_id, source, place, trim(l[place], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
    FROM (SELECT r, doc_id, source, l, unnest(range(1, len(l) + 1)) AS place FROM docs)),
solid AS (SELECT * FROM lines WHERE line <> ''),
boilerplate AS (
    SELECT line, min((doc_id, place)) AS first FROM solid GROUP BY line
    HAVING count(DISTINCT source) + max((source IS NULL)::INT) >= 10),
gone AS (SELECT r, place FROM solid JOIN boilerplate USING (line) WHERE (doc_id, place) <> first),
counts AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
kept AS (
    SELECT d.r, string_agg(d.l[place], chr(10) ORDER BY place) AS text
    FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS place FROM docs) d ANTI JOIN gone USING (r, place) GROUP BY d.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS lines_removed,
    CASE WHEN d.l IS NOT NULL THEN length(coalesce(text, ''))::BIGINT END AS n_chars,
    CASE WHEN d.l IS NOT NULL THEN sha256(coalesce(text, '')) END AS text_sha256
FROM docs d LEFT JOIN kept USING (r) LEFT JOIN counts USING (r)
"""


def tokenizer_path() -> str:
    """The installed byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document."""
    return bpe.digest(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op8_count_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component and number of shingles of every document."""
    return jaccard.near_duplicate_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
    SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * o >= 75 * (x.n + y.n - o)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT doc_id, doc_id FROM words UNION SELECT r.a, e.b FROM reached r JOIN both_ways e ON r.b = e.a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM words w LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) c ON c.a = w.doc_id
"""


def op10_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.contiguous_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"))


# The checksum's table follows from its polynomial; it is applied byte by byte, all texts at once.
OP10_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
    SELECT i, 0, i::UBIGINT FROM range(256) t(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
docs AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size FROM documents),
sums AS (SELECT doc_id, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::UBIGINT)),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])))::BIGINT AS text_crc32 FROM docs, crc),
placed AS (
    SELECT doc_id, size, text_crc32, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total
    FROM docs JOIN sums USING (doc_id)),
cut AS (SELECT *, least(((2 * before + size) * 16) // (2 * total), 15)::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM cut
"""


def op5_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, each distinct text scanned once."""
    return ledger.secret_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))[0]


def _op5_sql() -> str:
    """Matches with the pieces between them, walked in a list: the piece before, the match."""
    kinds = []
    for rank, rule in enumerate(ledger.RULES):
        pattern = rule.pattern.replace("'", "''").replace("(?i:(", "((?i:").replace(r"\x20", " ")
        value = f"regexp_extract(m, '{pattern}', {rule.group})" if rule.group else "m"
        # A character that the texts do not hold marks the ends of matches.
        kinds.append(f"""
    SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, m, length({value}) AS size, pieces, k
    FROM (SELECT doc_id, ms[k] AS m, pieces, k FROM (
        SELECT doc_id, pieces, ms, unnest(range(1, len(ms) + 1)) AS k FROM (
            SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms,
                string_split(regexp_replace(t, '{pattern}', chr(57344), 'g'), chr(57344)) AS pieces FROM docs)))""")
    union = " UNION ALL ".join(kinds)
    base = ", ".join(f"'{rule.kind}'" for rule in ledger.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{rule.kind}') AS n_{rule.kind}" for rule in ledger.BASE_RULES)
    return f"""
WITH docs AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
matched AS MATERIALIZED ({union}),
placed AS (
    SELECT *, sum(length(pieces[k]) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY k) AS stop FROM matched),
spans AS (SELECT doc_id, rank, kind, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop FROM placed
    JOIN (VALUES {", ".join(f"({rank}, {rule.least})" for rank, rule in enumerate(ledger.RULES))}) least(rank, size_least) USING (rank)
    WHERE size >= size_least),
listed AS (
    SELECT doc_id, {counts},
        sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE kind IN ({base})), '')) AS base_sha256,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
    FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (doc_id)
"""


def op6_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates that lines of a document, or the whole of it, match."""
    return licenses.license_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _op6_sql() -> str:
    rows = []
    for name, text in licenses.TEMPLATES:
        grams = licenses.template_bigrams(text)
        low, high = licenses.size_bounds(len(grams), licenses.THRESHOLD)
        rows.append(f"('{name}', {low}, {high}, [{', '.join(map(repr, grams))}])")
    return rf"""
WITH templates(license, low, high, grams) AS (VALUES {", ".join(rows)}),
units AS (
    SELECT doc_id, true AS is_line, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents
    UNION ALL SELECT doc_id, false, text FROM documents WHERE contains(text, chr(10))),
words AS (
    SELECT row_number() OVER () AS u, doc_id, is_line, regexp_extract_all(
        translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM units),
grams AS MATERIALIZED (
    SELECT u, doc_id, is_line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words),
scored AS (
    SELECT u, doc_id, is_line, license, len(list_intersect(grams.g, templates.grams)) * 2.0::DOUBLE / (len(grams.g) + len(templates.grams)) AS dice
    FROM grams JOIN templates ON len(grams.g) BETWEEN low AND high),
best AS (SELECT u, any_value(doc_id) AS doc_id, any_value(is_line) AS is_line, max((dice, license)) AS m FROM scored WHERE dice >= {licenses.THRESHOLD} GROUP BY u),
found AS (
    SELECT doc_id, count(*) FILTER (WHERE is_line) AS n_matches, string_agg(DISTINCT m[2], ',' ORDER BY m[2]) AS licenses, max(m[1]) AS best_dice
    FROM best GROUP BY doc_id)
SELECT doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses, best_dice FROM documents LEFT JOIN found USING (doc_id)
"""


def op3_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    return ann.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op7_suffix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat earlier ones, and the digest of the rest."""
    return suffixes.removal_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and quantisation error of every vector."""
    made = balls.ball_codes(_table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, made.codebooks.ravel().tolist())).encode()).hexdigest()
    return balls.with_label_error(made.rows).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _op13_sql() -> str:
    """Every round over all entries, in whole numbers."""
    rounds = ""
    for k in range(balls.ROUNDS + 1):
        rounds += f""",
near{k} AS MATERIALIZED (
    SELECT r, p, min((d, e)) AS best FROM (
        SELECT r, p, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d
        FROM cut JOIN book{k} USING (p)) GROUP BY r, p)"""
        if k < balls.ROUNDS:
            rounds += f""",
means{k} AS (
    SELECT p, e, list(floor_div ORDER BY i) AS c FROM (
        SELECT p, e, i, (s - ((s % n) + n) % n) // n AS floor_div FROM (
            SELECT p, best[2] AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n
            FROM cut JOIN near{k} USING (r, p), (SELECT unnest(range(1, w + 1)) AS i FROM width) GROUP BY 1, 2, 3)) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (p, e))"""
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({balls.SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
width AS MATERIALIZED (SELECT any_value(len(v)) // {balls.PARTS} AS w FROM kept),
cut AS MATERIALIZED (SELECT r, p, v[p * w + 1:(p + 1) * w] AS x FROM kept, width, (SELECT unnest(range({balls.PARTS})) AS p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM cut WHERE r <= {balls.ENTRIES}){rounds},
coded AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{balls.ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{balls.ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


#: A conversation of control strings, beside those of the table.
CONTROL_TEXT = f"{chat.END}{chat.START}assistant ok"


def op11_offset_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a formatted conversation says when it is read back, and what its loss mask covers."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], turns.schema)
    return chat.chat_report(turns.union(own), tokenizer_path())


OP11_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '{CONTROL_TEXT}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
    coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum({len(chat.START + chat.SEP + chat.END) + 1} + length(role) + length(t) + len(regexp_extract_all(role || chr(10) || t, '<[\\]*[|]')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op12_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers for every document."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return crosstok.align(docs, tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op12_shared_cuts": op12_shared_cuts,
    "op11_offset_masks": op11_offset_masks,
    "op13_ball_codes": op13_ball_codes,
    "op7_suffix_shards": op7_suffix_shards,
    "op3_kmeans_tree": op3_kmeans_tree,
    "op6_license_dice": op6_license_dice,
    "op5_blob_ledger": op5_blob_ledger,
    "op10_prefix_sum_shards": op10_prefix_sum_shards,
    "op8_count_vector_tree": op8_count_vector_tree,
    "op9_word_table_bpe": op9_word_table_bpe,
    "op4_site_spread": op4_site_spread,
    "op2_weak_rules": op2_weak_rules,
    "op1_pareto_mix": op1_pareto_mix,
}

ORACLE = {
    "op11_offset_masks": OP11_SQL,
    "op13_ball_codes": _op13_sql(),
    "op6_license_dice": _op6_sql(),
    "op5_blob_ledger": _op5_sql(),
    "op10_prefix_sum_shards": OP10_SQL,
    "op8_count_vector_tree": OP8_SQL,
    "op4_site_spread": OP4_SQL,
    "op2_weak_rules": _op2_sql(),
    "op1_pareto_mix": OP1_SQL,
}
