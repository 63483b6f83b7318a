"""Text scalars as Catalyst expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as white space (Unicode white space
# plus the four ASCII separators), once as a character list, once as a class.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\p{IsWhite_Space}\x1c-\x1f]"
# A word is a run of letters, numbers and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(SPACES))


def collapse_spaces(col: Column) -> Column:
    return F.regexp_replace(col, SPACE_CLASS + "+", " ")


def strip_html(col: Column) -> Column:
    """Scripts, styles, tags and ``&nbsp;`` become a space; white space collapses."""
    for pattern in (r"(?s)<script.*?</script>", r"(?s)<style.*?</style>", r"<[^>]+>", "&nbsp;"):
        col = F.regexp_replace(col, pattern, " ")
    return collapse_spaces(col)


def make_summary(col: Column, limit: int = 120) -> Column:
    flat = strip(collapse_spaces(col))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def tokenize(col: Column) -> Column:
    """Lower-cased words; a run of CJK characters is one word."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))


def domain_tags(col: Column) -> Column:
    """``"a, b,,c"`` -> ``["a", "b", "c"]``."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), ","), strip)
    return F.filter(parts, lambda tag: tag != "")


def normalize_domain_tags(col: Column) -> Column:
    return F.array_join(domain_tags(col), ",")


def truncate_title(col: Column, limit: int = 50) -> Column:
    title = F.substring(F.replace(strip(col), F.lit("\n"), F.lit(" ")), 1, limit)
    return F.when(F.length(col) > 0, title)


def derive_title(first_user_text: Column, limit: int = 20, default: str = "新对话") -> Column:
    text = strip(first_user_text)
    short = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)
    return F.coalesce(short, F.lit(default))


def fixed_point(col: Column, digits: int) -> Column:
    """Fixed decimals, rounded from the exact binary value (ties to even)."""
    return F.replace(F.format_number(col, digits), F.lit(","), F.lit(""))


def entity_key(col: Column) -> Column:
    """Comparison key of an entity label: no white space, lower case."""
    return F.lower(F.regexp_replace(col, SPACE_CLASS + "+", ""))


_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?([+-]\d{2}:?\d{2})?)?$"
_ZONE = r"[+-]\d{2}:?\d{2}$"


def number_to_epoch_ms(col: Column) -> Column:
    """Numbers above 1e11 are milliseconds already, others are seconds."""
    return F.when(col > 1e11, col.try_cast("bigint")).otherwise(
        (col * 1000).try_cast("bigint")
    )


def to_epoch_ms(col: Column) -> Column:
    """Digits (seconds or milliseconds) or ISO text -> epoch milliseconds, else null.

    Text without a zone is UTC, whatever the session zone is.
    """
    text = strip(col.cast("string"))
    digits = F.when(text.rlike(r"^-*\d+$"), text.try_cast("bigint"))
    iso = F.when(F.replace(text, F.lit("Z"), F.lit("+00:00")).rlike(_ISO), F.replace(text, F.lit("Z"), F.lit("+00:00")))
    zoned = F.when(F.length(iso) == 10, F.concat(iso, F.lit("T00:00:00+00:00"))).otherwise(
        F.when(iso.rlike(_ZONE) & (F.length(iso) > 10), iso).otherwise(F.concat(iso, F.lit("+00:00")))
    )
    return F.coalesce(
        number_to_epoch_ms(digits),
        F.when(digits.isNull(), F.unix_millis(F.try_to_timestamp(zoned))),
    )


def epoch_ms_to_iso(ms: Column) -> Column:
    """Epoch milliseconds -> ISO text in UTC; lexical order is time order."""
    at = F.timestamp_millis(ms)
    utc = F.to_utc_timestamp(at, F.current_timezone())
    seconds = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(F.pmod(ms, F.lit(1000)) == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"), F.lit("000"))
    )
    return F.concat(seconds, fraction, F.lit("+00:00"))
