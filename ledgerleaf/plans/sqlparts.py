"""SQL fragments shared by the cross-check statements."""

from __future__ import annotations

WS = (
    r"[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WORD = r"[\p{L}\p{N}_]+"
USER, HOST = "[A-Za-z0-9._%+-]", r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def strip_html(x: str) -> str:
    for pattern in ("(?s)<script.*?</script>", "(?s)<style.*?</style>", "<[^>]+>", "&nbsp;"):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    return collapse(x)


def summary(x: str, limit: int = 120) -> str:
    flat = strip(collapse(x))
    return f"(CASE WHEN length({flat}) > {limit} THEN substr({flat}, 1, {limit}) || '…' ELSE {flat} END)"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}')"


def redact_email(x: str) -> str:
    return f"regexp_replace({x}, '(?:({USER}{{2}}){USER}+|{USER}{{1,2}})@({HOST})', '\\1***@\\2', 'g')"


def redact(x: str) -> str:
    """No look-around here, so each digit mask keeps its neighbours and runs twice."""
    left, right = r"(^|[^0-9])", r"($|[^0-9])"
    masks = (
        (rf"{left}(1[3-9][0-9])[0-9]{{4}}([0-9]{{4}}){right}", r"\1\2****\3\4"),
        (rf"{left}([0-9]{{6}})[0-9]{{8}}([0-9]{{3}}[0-9Xx]){right}", r"\1\2********\3\4"),
        (rf"{left}([0-9]{{4}})[0-9]{{8,11}}([0-9]{{4}}){right}", r"\1\2****\3\4"),
    )
    for pattern, put in masks:
        for _twice in range(2):
            x = f"regexp_replace({x}, '{pattern}', '{put}', 'g')"
    return redact_email(x)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


CHUNK_COLUMNS = "doc_key, idx, chapter, content"


def chunks_cte(source: str, key: str, body: str, max_chars: int = 600, overlap: int = 80) -> str:
    """CTEs ending in ``packed(doc_key, idx, chapter, content)`` for texts without heading lines."""
    body = strip(f"replace({body}, E'\\r\\n', E'\\n')")
    return f"""
bodies AS (SELECT {key} AS doc_key, {body} AS body FROM {source}),
paras AS (
  SELECT doc_key, row_number() OVER (PARTITION BY doc_key ORDER BY pos) AS n, p FROM (
    SELECT doc_key, unnest(regexp_split_to_array(body, '\\n+')) AS p,
           generate_subscripts(regexp_split_to_array(body, '\\n+'), 1) AS pos
    FROM bodies WHERE length(body) > {max_chars}) WHERE {strip('p')} <> ''),
walk AS (
  SELECT doc_key, CAST(0 AS BIGINT) AS n, CAST('' AS VARCHAR) AS open, CAST(NULL AS VARCHAR) AS closed
  FROM (SELECT DISTINCT doc_key FROM paras)
  UNION ALL
  SELECT w.doc_key, p.n,
    CASE WHEN length(w.open) + length(p.p) + 1 <= {max_chars}
         THEN CASE WHEN w.open = '' THEN p.p ELSE {strip("w.open || chr(10) || p.p")} END
         ELSE right(p.p, {overlap}) || chr(10) || p.p END,
    CASE WHEN length(w.open) + length(p.p) + 1 > {max_chars} AND w.open <> '' THEN w.open END
  FROM walk w JOIN paras p ON p.doc_key = w.doc_key AND p.n = w.n + 1),
pieces AS (
  SELECT doc_key, n AS place, closed AS content FROM walk WHERE closed IS NOT NULL
  UNION ALL
  SELECT doc_key, 1000000000 AS place, arg_max(open, n) AS content FROM walk GROUP BY doc_key
  UNION ALL
  SELECT doc_key, 0 AS place, body FROM bodies WHERE body <> '' AND length(body) <= {max_chars}),
packed AS (
  SELECT doc_key, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY place) - 1 AS INTEGER) AS idx,
         '' AS chapter, content FROM pieces WHERE content <> '')"""
