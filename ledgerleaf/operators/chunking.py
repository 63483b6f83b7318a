"""Splitting documents into chunks along headings and paragraphs.

A document is one row, so all of it happens inside that row: one regular
expression cuts the text in front of every heading line, and a fold packs the
paragraphs of each long section. Nothing is shuffled and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerleaf.functions.text import SPACE_CLASS, strip

# A heading line is "# " to "#### " with text, or a label of at most 30
# characters that ends in a colon. White space around it does not count.
_BLANK = SPACE_CLASS.replace("[", "(?:(?!\\n)[", 1) + ")"
_NOT_BLANK = SPACE_CLASS.replace("[", "[^", 1)
_HEADING_BODY = rf"(?:#{{1,4}}{_BLANK}+{_NOT_BLANK}[^\n]*|(?:{_NOT_BLANK}[^\n]{{0,28}})?[:：]{_BLANK}*)"
_BEFORE_HEADING = rf"(?dm)^(?={_BLANK}*{_HEADING_BODY}$)"
_FIRST_LINE = rf"(?d)\A({_BLANK}*{_HEADING_BODY})(?:\n|\z)"


def _pack(body: Column, max_chars: int, overlap: int) -> Column:
    """Greedy packing of non-blank paragraphs; a paragraph itself is never cut.

    When the next paragraph does not fit, the open piece is closed and the new
    one starts with the last ``overlap`` characters of that next paragraph.
    """
    paragraphs = F.filter(F.split(body, "\n+"), lambda p: strip(p) != "")
    start = F.struct(
        F.array().cast("array<string>").alias("closed"),
        F.lit("").alias("open"),
    )

    def step(acc: Column, para: Column) -> Column:
        opened = acc["open"]
        fits = F.length(opened) + F.length(para) + 1 <= max_chars
        joined = F.when(opened == "", para).otherwise(strip(F.concat(opened, F.lit("\n"), para)))
        restarted = F.concat(F.right(para, F.lit(overlap)), F.lit("\n"), para) if overlap else para
        closed = F.when(~fits & (opened != ""), F.array_append(acc["closed"], opened)).otherwise(acc["closed"])
        return F.struct(closed.alias("closed"), F.when(fits, joined).otherwise(restarted).alias("open"))

    def finish(acc: Column) -> Column:
        return F.when(acc["open"] != "", F.array_append(acc["closed"], acc["open"])).otherwise(acc["closed"])

    return F.aggregate(paragraphs, start, step, finish)


def chunks_of(text: Column, max_chars: int = 600, overlap: int = 80) -> Column:
    """``array<struct<chapter, text>>`` of one document."""
    sections = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), _BEFORE_HEADING)

    def pieces_of(section: Column) -> Column:
        body = section["body"]
        pieces = (
            F.when(body == "", F.array().cast("array<string>"))
            .when(F.length(body) <= max_chars, F.array(body))
            .otherwise(_pack(body, max_chars, overlap))
        )
        head = section["chapter"]
        return F.transform(
            pieces,
            lambda piece: F.struct(
                head.alias("chapter"),
                F.when(head == "", piece).otherwise(F.concat(head, F.lit("\n"), piece)).alias("text"),
            ),
        )

    def split_heading(section: Column) -> Column:
        headed = section.rlike(_FIRST_LINE)
        return F.struct(
            F.when(headed, strip(F.regexp_extract(section, _FIRST_LINE, 1))).otherwise(F.lit("")).alias("chapter"),
            strip(F.when(headed, F.regexp_replace(section, _FIRST_LINE, "")).otherwise(section)).alias("body"),
        )

    # Two transforms, so that chapter and body are computed once per section.
    return F.flatten(F.transform(F.transform(sections, split_heading), pieces_of))


def chunk_text(
    docs: DataFrame, max_chars: int = 600, overlap: int = 80, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Documents -> ``(*keep, idx, chapter, text)``, one row per chunk."""
    pieces = docs.select(*keep, F.posexplode(chunks_of(F.col(text), max_chars, overlap)).alias("idx", "piece"))
    return pieces.select(*keep, "idx", F.col("piece.chapter").alias("chapter"), F.col("piece.text").alias("text"))
