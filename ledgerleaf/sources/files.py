"""Documents from files: corpus folders, uploads, legacy formats."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerleaf.functions.text import collapse_spaces, strip, strip_html

# Extensions of corpus files and of uploads, messages of failed uploads.
MARKDOWN, HTML, PLAIN = (".md", ".markdown"), (".html", ".htm"), (".txt",)
WORD_FILES, PDF = (".doc", ".docs", ".docx"), ".pdf"
SUPPORTED = (".txt", ".md", ".markdown", ".html", ".htm", ".pdf", ".docx", ".doc", ".docs")
NO_TEXT = "文档内容为空，无可解析文本。"
NO_WORD_TEXT = "Word 文档未提取到可解析文本（可能是扫描件/图片型 .doc）。"
NO_PDF_TEXT = "PDF 未提取到可解析文本（可能是扫描件/图片型 PDF）。"


def extension(filename: Column) -> Column:
    """Lower-case extension with its dot; a leading dot of the name starts none."""
    base = F.regexp_extract(filename, r"[^/]*$", 0)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1))


def file_path(path: Column | None = None) -> Column:
    """The path of the file a row was read from, as it is named on disk."""
    shown = F.col("_metadata.file_path") if path is None else path
    return F.url_decode(F.replace(shown, F.lit("+"), F.lit("%2B")))


def _base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def utf8_lenient(raw: Column) -> Column:
    """Bytes as text; bytes that are no UTF-8 are left out."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))


# ---------------------------------------------------------------- front matter
_FRONT = r"(?sd)\A\s*---\s*\n(.*?)\n---\s*\n?(.*)\z"
_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def parse_frontmatter(text: Column) -> Column:
    """``struct<meta map<string,string>, body>`` of a text with a leading ``---`` block.

    A repeated key keeps its last value; without a block the text is the body.
    """
    lines = F.filter(F.split(F.regexp_extract(text, _FRONT, 1), _LINE_ENDS), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(
        lines,
        lambda x: F.struct(
            strip(F.substring_index(x, ":", 1)).alias("key"),
            F.btrim(F.btrim(strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))), F.lit('"')), F.lit("'")).alias("value"),
        ),
    )
    last = F.filter(
        entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"])
    )
    found = text.rlike(_FRONT)
    return F.struct(
        F.when(found, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>")).alias("meta"),
        F.when(found, F.regexp_extract(text, _FRONT, 2)).otherwise(text).alias("body"),
    )


# ---------------------------------------------------------------- corpus folders
def corpus_documents(files: DataFrame) -> DataFrame:
    """``(path, text)`` -> documents with metadata, from front matter or by default."""
    ext = extension(F.col("path"))
    front = F.when(ext.isin(*MARKDOWN), parse_frontmatter(F.col("text"))).otherwise(
        F.struct(F.create_map().cast("map<string,string>").alias("meta"), F.col("text").alias("body"))
    )
    rows = files.filter(ext.isin(*MARKDOWN, *HTML, *PLAIN)).select("path", front.alias("front"))
    name = _base_name(F.col("path"))
    meta = lambda key, default: F.coalesce(F.col("front.meta")[key], default)
    named = lambda key: F.coalesce(F.nullif(F.col("front.meta")[key], F.lit("")), name)
    body = F.col("front.body")
    return rows.select(
        named("doc_id").alias("doc_id"),
        named("title").alias("title"),
        meta("doc_type", F.lit("internal")).alias("doc_type"),
        meta("agency", F.lit("")).alias("agency"),
        meta("domain", F.lit("")).alias("domain"),
        meta("effective_date", F.lit("")).alias("effective_date"),
        meta("version", F.lit("1")).alias("version"),
        F.col("path").alias("source_path"),
        F.when(extension(F.col("path")).isin(*HTML), strip_html(body)).otherwise(body).alias("text"),
    )


def scan_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the folder's text files; other files and sub-folders are passed over."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" for c in word)
    names = ",".join(either(e[1:]) for e in (*MARKDOWN, *HTML, *PLAIN))
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*.{{{names}}}")
    return corpus_documents(
        files.select(file_path().alias("path"), utf8_lenient(F.col("value").cast("binary")).alias("text"))
    )


# ---------------------------------------------------------------- uploads
@F.arrow_udf(T.StringType())
def _utf16(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for array in arrays:
        yield pa.array(
            [None if b is None else b.decode("utf-16-le", "ignore") for b in array.to_pylist()], pa.string()
        )


# The characters kept from a legacy binary document.
_KEPT = (
    r"\u3400-\u4DBF\u4E00-\u9FFF\u3000-\u303F\uFF00-\uFFEF\u2010-\u2027\u2018-\u201Fa-zA-Z0-9"
    r" ·…—、，。：；！？（）《》“”‘’.,;:!?()'\"+/\-"
)


def extract_legacy_doc_text(raw: Column) -> Column:
    """Readable characters of a binary document, taken as UTF-16 text."""
    return strip(collapse_spaces(F.regexp_replace(_utf16(raw), f"[^{_KEPT}]", "")))


def dispatch_by_extension(files: DataFrame) -> DataFrame:
    """Adds ``ext``, ``text`` and ``error`` to ``(filename, content)``; a bad file is a row, not a failure.

    The bytes of PDF and zipped Word files are not parsed here: supply their text in
    a column ``extracted``, else they become error rows.
    """
    ext = extension(F.col("filename"))
    supplied = F.col("extracted") if "extracted" in files.columns else F.lit(None).cast("string")
    plain = utf8_lenient(F.col("content"))
    # Only the bytes of such files are sent to Python; zipped documents are not readable that way.
    zipped = F.coalesce(F.substring("content", 1, 4) == F.lit(b"PK\x03\x04"), F.lit(False))
    legacy = extract_legacy_doc_text(F.when(F.col("ext").isin(*WORD_FILES) & ~zipped, F.col("content")))
    text = (
        F.when(F.col("ext").isin(*HTML), strip_html(plain))
        .when(F.col("ext").isin(*WORD_FILES), F.coalesce(supplied, legacy))
        .when(F.col("ext") == PDF, supplied)
        .when(F.col("ext").isin(*SUPPORTED), plain)
    )
    shown = F.when(F.col("ext") == "", F.lit("(无扩展名)")).otherwise(F.col("ext"))
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    error = (
        F.when(
            ~F.col("ext").isin(*SUPPORTED),
            F.concat(F.lit("暂不支持的文档类型："), shown, F.lit(f"（本期支持 {'/'.join(SUPPORTED)}）")),
        )
        .when(blank & (F.col("ext") == PDF), F.lit(NO_PDF_TEXT))
        .when(blank & F.col("ext").isin(*WORD_FILES), F.lit(NO_WORD_TEXT))
        .when(blank, F.lit(NO_TEXT))
    )
    return files.withColumn("ext", ext).withColumn("text", text).withColumn("error", error)
