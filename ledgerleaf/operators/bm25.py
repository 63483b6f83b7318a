"""Okapi BM25: a forward index per chunk, corpus statistics and scores."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerleaf.functions.text import tokenize
from ledgerleaf.session import cut_lineage

# Fixed values of the ranking function.
K1, B = 1.5, 0.75
# Below U+0860, a word of ``tokenize`` is a run of these (tested on every code point).
WORDS = re.compile(r"\w+")
NEWER = r"[^\x{0}-\x{85F}]"


_COUNTS = T.StructType([
    T.StructField("dl", T.IntegerType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))
])
COUNTS_ARROW = pa.struct([("dl", pa.int32()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32()))])


#: Which code points below U+0860 are part of a word.
_IN_WORD = np.array([WORDS.match(chr(c)) is not None for c in range(0x860)])
_SLICE_ROWS, _SLICE_BYTES = 1024, 4_000_000


def _cut_words(lowered: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts without characters from U+0860 on, in one array, and the row of each."""
    # ``concat_arrays`` copies a slice, so that its buffers begin with its first row.
    texts = pa.concat_arrays([pc.fill_null(lowered, "").cast(pa.large_string()), pa.array([""], pa.large_string())])
    ends = np.frombuffer(texts.buffers()[1], np.int64)[: len(lowered) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: ends[-1]]
    inside = np.concatenate([_IN_WORD[:128], np.zeros(128, bool)])[data]
    two, three = np.flatnonzero((data & 0xE0) == 0xC0), np.flatnonzero(data == 0xE0)
    inside[two] = inside[two + 1] = _IN_WORD[((data[two] & 0x1F).astype(np.int64) << 6) | (data[two + 1] & 0x3F)]
    inside[three] = inside[three + 1] = inside[three + 2] = _IN_WORD[((data[three + 1] & 0x3F).astype(np.int64) << 6) | (data[three + 2] & 0x3F)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = ends[:-1][ends[:-1] < len(data)]
    first[rows] = inside[rows]  # a word ends with its row
    begins, letters = np.flatnonzero(first), data[inside]
    offsets = np.append(np.flatnonzero(first[inside]), len(letters)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(letters))
    return words, np.repeat(np.arange(len(lowered)), np.diff(np.searchsorted(begins, ends)))


def _count_words(lowered: pa.Array, given: pa.Array) -> pa.Array:
    """Word counts of each row: of its words where they are given, else of those in its text."""
    size = len(lowered)
    words, row = _cut_words(pc.if_else(given.is_valid(), "", lowered))
    words = pa.concat_arrays([words, given.flatten().cast(pa.string())])
    row = np.concatenate([row, pc.list_parent_indices(given).to_numpy(zero_copy_only=False)]).astype(np.int64)
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    kinds = max(len(order), 1)
    # Sorted by row and word, equal words of a row lie together.
    keys = np.sort(row * kinds + rank[coded.indices.to_numpy(zero_copy_only=False)])
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    of_row, of_word = np.divmod(keys[heads], kinds)
    offsets = pa.array(np.searchsorted(of_row, np.arange(size + 1)), pa.int32())
    terms = coded.dictionary.take(pa.array(order[of_word]))
    tfs = pa.array(np.diff(np.append(heads, len(keys))), pa.int32())
    lengths = pa.array(np.bincount(row, minlength=size), pa.int32())
    found = [lengths, pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, tfs)]
    return pa.StructArray.from_arrays(found, fields=list(COUNTS_ARROW))


@F.arrow_udf(_COUNTS)
def _counted(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Word counts of a row: of its words where they are given, else of those that ``WORDS`` finds in its text."""
    for lowered, given in columns:
        made, at = [pa.array([], COUNTS_ARROW)], 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(lowered), 0).to_numpy(zero_copy_only=False))
        while at < len(lowered):  # some rows and megabytes at a time
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE_BYTES))
            size = min(max(full - at, 1), _SLICE_ROWS)
            made.append(_count_words(lowered.slice(at, size), given.slice(at, size)))
            at += size
        yield pa.concat_arrays(made)


def index_terms(df: DataFrame, text: str = "content") -> DataFrame:
    """Adds ``dl`` (words), ``terms`` (distinct, sorted) and ``tfs`` (their counts).

    Counting happens inside the row. Texts in the older alphabets, whose letters
    every Unicode version knows, are cut into words where they are counted;
    the others by Spark's ``tokenize``, so that all have its words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    newer = F.lower(body).rlike(NEWER)
    counts = _counted(F.when(~newer, F.lower(body)), F.when(newer, tokenize(body)))
    return df.withColumn("_counts", counts).select(*df.columns, *(F.col(f"_counts.{c}").alias(c) for c in ("dl", "terms", "tfs")))


def bm25_index(chunks: DataFrame, text: str = "content") -> DataFrame:
    """Postings ``(term, chunk_id, tf, dl)``; write them bucketed by term to reuse them."""
    indexed = index_terms(chunks, text).select("chunk_id", "dl", "terms", "tfs")
    return indexed.select(
        "chunk_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("entry")
    ).select(F.col("entry.terms").alias("term"), "chunk_id", F.col("entry.tfs").alias("tf"), "dl")


def bm25_term_stats(postings: DataFrame) -> DataFrame:
    """``(term, df, total_tf)``; a map-side combine keeps frequent words cheap."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, mult)``: a word asked twice counts twice."""
    words = queries.select("query_id", F.explode(tokenize(F.col("query_text"))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("mult"))


def bm25_score(
    queries: DataFrame, corpus: DataFrame, candidates: DataFrame | None = None, n: int | None = None,
    avgdl: float | None = None, stats: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, chunk_id, score)`` of the ``candidates`` (query_id, chunk_id), else of every chunk that holds a query word.

    Chunks not listed score 0. The statistics are those of ``corpus`` as given,
    so filter it first; known ones (``n``, ``avgdl``, ``stats`` with term and df)
    can be passed in. Without candidates there is a row for each pair that shares
    a word, which grows with both sides: give candidates where only some count.
    Such pairs are scored where the chunk is read, by blocks of queries, so none
    is shuffled and a frequent word is no task of its own. Chunk ids are unique.
    """
    from ledgerleaf.operators.recall import MAX_LOCAL, score_shared  # which builds on this module

    indexed = corpus if "terms" in corpus.columns else index_terms(corpus)
    asked = query_terms(queries)
    if stats is None:
        # One pass: the null word carries the totals, and the tasks add up their own rows.
        every = F.concat(F.array(F.lit(None).cast("string")), F.col("terms"))
        # Broadcast: as large as the queries' vocabulary.
        words = F.broadcast(queries.select(F.explode(tokenize(F.col("query_text"))).alias("asked")).distinct())
        held = indexed.select("dl", F.explode(every).alias("term")).join(words, F.col("term") == F.col("asked"), "left").where("term IS NULL OR asked IS NOT NULL")
        stats = cut_lineage(held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("dl")))
        total = stats.where("term IS NULL").first()
        known = (total["df"], total["dl"] / total["df"]) if total else (0, 0.0)
        stats = stats.where("term IS NOT NULL").select("term", "df")
    elif n is None or avgdl is None:
        size = indexed.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
        known = size["n"], size["avgdl"]
    if n is None or avgdl is None:
        n, avgdl = known[0], float(known[1] or 1.0)
    size, mean = F.lit(float(n)), F.lit(avgdl)
    part = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
    weights = asked.join(stats, "term").select("query_id", "term", (F.col("mult") * idf(size, F.col("df"))).alias("weight"))
    if candidates is not None:
        # A query's words are as many as its text holds; the sum is taken inside the row.
        of_query = weights.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights"))
        # The corpus stays where it is, unless there are too many candidates for that.
        candidates = cut_lineage(candidates.select("query_id", "chunk_id"))
        listed = F.broadcast(candidates) if candidates.count() <= MAX_LOCAL else candidates
        pairs = indexed.select("chunk_id", "dl", "terms", "tfs").join(listed, "chunk_id").join(of_query, "query_id")
        tf = F.map_from_arrays("terms", "tfs")
        shared = F.array_intersect(F.map_keys("weights"), "terms")
        score = F.aggregate(
            F.transform(shared, lambda t: F.element_at("weights", t) * part(F.element_at(F.col("counts"), t), F.col("dl"))), F.lit(0.0), lambda a, x: a + x
        )
        return pairs.withColumn("counts", tf).select("query_id", "chunk_id", score.alias("score"))
    return score_shared(weights, indexed, avgdl)
