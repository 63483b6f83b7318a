"""Merging recall routes, weighted fusion, reranking and the passage context."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerleaf.functions.text import fixed_point
from ledgerleaf.operators.recall import MAX_LOCAL, recall
from ledgerleaf.session import cut_lineage

RECALL_FACTOR = 3  # fixed value: each route recalls this many times top_k
METADATA = ("title", "agency", "doc_type", "domain", "version", "doc_id", "chapter", "content", "effective_date")
EMPTY_CONTEXT = "（暂无检索结果）"


def union_recall(vec: DataFrame, bm25: DataFrame, keys: tuple[str, ...] = ("query_id", "chunk_id")) -> DataFrame:
    """Both routes side by side, one row per chunk, both scores kept."""
    return vec.join(bm25, list(keys), "full").select(*keys, "vec_score", "bm25_score")


def _pivot_routes(found: DataFrame) -> DataFrame:
    """The same union when both routes arrive in one table: one aggregate, no join."""
    score = lambda route: F.max(F.when(F.col("route") == route, F.col("score")))
    return found.groupBy("query_id", "corpus", "chunk_id").agg(
        score("vector").alias("vec_score"), score("bm25").alias("bm25_score")
    )


def _rescale(value: Column, low: Column, high: Column) -> Column:
    flat = F.when(high > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(high == low, flat).otherwise((value - low) / (high - low))


def minmax_normalize(df: DataFrame, columns: tuple[str, ...], by: str = "query_id") -> DataFrame:
    """Scale columns to 0..1 within each ``by`` group; missing scores count as 0 first.

    The bounds come from an aggregate with map-side combine that is joined back,
    so a group of any size is never gathered in one task.
    """
    filled = df.fillna(0.0, list(columns))
    bounds = filled.groupBy(by).agg(
        *[f(c).alias(f"_{tag}_{c}") for c in columns for tag, f in (("lo", F.min), ("hi", F.max))]
    )
    joined = filled.join(bounds, by)
    scaled = {c: _rescale(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in columns}
    return joined.withColumns(scaled).drop(*bounds.columns[1:])


def fuse(candidates: DataFrame, vec_weight: float = 0.7) -> DataFrame:
    """Adds ``score``: the weighted sum of both scaled routes."""
    scaled = minmax_normalize(candidates, ("vec_score", "bm25_score"))
    return scaled.withColumn(
        "score", F.round(vec_weight * F.col("vec_score") + (1 - vec_weight) * F.col("bm25_score"), 10)
    )


def _ranked(fused: DataFrame, top_k: int) -> DataFrame:
    """First ``top_k`` per query; ties go to the public corpus, then the smaller id."""
    order = W.partitionBy("query_id").orderBy(
        F.desc("score"), F.when(F.col("corpus") == "public", 0).otherwise(1), F.asc("chunk_id")
    )
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


Reranker = Callable[[str, pd.DataFrame], "list[float]"]


def rerank(candidates: DataFrame, queries: DataFrame, reranker: Reranker, top_k: int) -> DataFrame:
    """Re-scores the candidates of each query with a user function.

    ``reranker(query_text, rows)`` returns one score per row. A query has at most
    ``top_k * 3`` candidates, and is left as it is with no more than ``top_k``.
    """
    texted = candidates.join(queries.select("query_id", "query_text"), "query_id")
    schema = candidates.schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        if len(rows) > top_k:
            scores = reranker(rows["query_text"].iloc[0], rows.drop(columns="query_text"))
            rows = rows.assign(_s=list(scores)).sort_values("_s", ascending=False, kind="stable")
            rows["rank"] = range(1, len(rows) + 1)
        return rows[schema.names]

    return texted.groupBy("query_id").applyInPandas(run, schema).filter(F.col("rank") <= top_k)


def _with_metadata(ranked: DataFrame, public: DataFrame, personal: DataFrame | None) -> DataFrame:
    """Passage columns for the ranked chunks; each corpus is read once, its texts for ranked ids only.

    The ranking is written once, although each corpus looks its chunks up in it;
    its size decides how the ids get to the corpus.
    """
    ranked = cut_lineage(ranked)
    small = ranked.count() <= MAX_LOCAL
    frames = [("public", public)] + ([("personal", personal)] if personal is not None else [])
    out = None
    for name, corpus in frames:
        have = [c if c in corpus.columns else F.lit("").alias(c) for c in METADATA]
        side = corpus.select("chunk_id", *have)
        own = ranked.filter(F.col("corpus") == name)
        hits = side.join(F.broadcast(own) if small else own, "chunk_id")
        out = hits if out is None else out.unionByName(hits)
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in METADATA}
    out = out.withColumns(text)
    return out.select(
        "query_id", "rank", "corpus", "chunk_id", F.round("score", 4).alias("score"),
        F.when(F.col("title") != "", F.col("title")).otherwise(F.col("doc_id")).alias("source"), *METADATA,
    )


def hybrid_search(
    queries: DataFrame,
    public: DataFrame,
    personal: DataFrame | None = None,
    top_k: int = 5,
    vec_weight: float = 0.7,
    keep_undated: bool = False,
    reranker: Reranker | None = None,
) -> DataFrame:
    """Ranked passages for a batch of queries.

    ``queries``: ``query_id, query_text, query_vec`` and optionally ``domain``,
    ``effective_after`` (public corpus only) and ``user_id``. With ``personal``
    given, each query with a user also sees that user's chunks; candidates of
    both corpora are scaled and ranked together.
    """

    found = recall(queries, public, personal, top_k * RECALL_FACTOR, keep_undated=keep_undated)
    fused = fuse(_pivot_routes(found), vec_weight)
    kept = top_k * RECALL_FACTOR if reranker else top_k
    ranked = _ranked(fused, kept).select("query_id", "corpus", "chunk_id", "score", "rank")
    passages = _with_metadata(ranked, public, personal)
    return rerank(passages, queries, reranker, top_k) if reranker else passages


def hybrid_search_full(
    queries: DataFrame, public: DataFrame, top_k: int = 5, vec_weight: float = 0.7, keep_undated: bool = True
) -> DataFrame:
    """No candidate cut: both scores of all filtered chunks are scaled, then ranked.

    Two scans: the first finds each query's score bounds, the second keeps the
    best fused scores per task. Undated chunks pass the date bound by default.
    """

    found = recall(queries, public, k=top_k, keep_undated=keep_undated, full=True, vec_weight=vec_weight)
    return _with_metadata(found.drop("route"), public, None)


def personal_corpus(docs: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Searchable chunks of finished documents, in the shape of the public corpus.

    ``docs(id, user_id, filename, status, uploaded_at)``, ``chunks(id, doc_id,
    user_id, text, chapter)``, ``embeddings(chunk_id, embedding)``.
    """
    done = docs.filter(F.col("status") == "done").select(
        F.col("id").alias("doc_id"), F.col("filename").alias("title"), F.col("uploaded_at").alias("effective_date")
    )
    texts = chunks.select(
        F.col("id").alias("chunk_id"), "doc_id", "user_id", F.col("text").alias("content"),
        F.coalesce("chapter", F.lit("")).alias("chapter"),
    )
    return (
        texts.join(embeddings.select("chunk_id", "embedding"), "chunk_id")
        .join(done, "doc_id")
        .withColumn("doc_type", F.lit("personal"))
    )


# ---------------------------------------------------------------- context text
def format_passage(no: Column, p: str = "") -> Column:
    """One passage with its provenance line; ``p`` prefixes the column names."""
    c = lambda name: F.coalesce(F.col(p + name), F.lit(""))
    score = F.coalesce(F.col(p + "score"), F.lit(0.0))
    head = F.concat_ws(
        "｜",
        F.when(c("title") != "", F.concat(F.lit("来源《"), c("title"), F.lit("》"))).when(
            c("source") != "", F.concat(F.lit("来源："), c("source"))
        ),
        F.when(c("agency") != "", F.concat(F.lit("机构："), c("agency"))),
        F.when(c("domain") != "", F.concat(F.lit("领域："), c("domain"))),
        F.when(c("effective_date") != "", F.concat(F.lit("生效："), c("effective_date"))),
        F.when(~c("version").isin("", "1"), F.concat(F.lit("版本："), c("version"))),
        F.when(score != 0, F.concat(F.lit("相关度："), fixed_point(score, 2))),
    )
    number = F.concat(F.lit("["), no.cast("string"), F.lit("]"))
    return F.concat_ws(
        "\n",
        F.when(head != "", F.concat(number, F.lit(" "), head)).otherwise(number),
        F.when(c("chapter") != "", F.concat(F.lit("章节："), c("chapter"))),
        c("content"),
    )


def rag_context(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """``(query_id, context)``: a query's passages in rank order as one text.

    A query has ``top_k`` passages, so the list gathered per query is short.
    """
    blocks = passages.select("query_id", F.struct("rank", format_passage(F.col("rank")).alias("text")).alias("block"))
    texts = blocks.groupBy("query_id").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    joined = queries.select("query_id").join(texts, "query_id", "left")
    return joined.select(
        "query_id", F.coalesce(F.array_join("blocks.text", "\n\n"), F.lit(EMPTY_CONTEXT)).alias("context")
    )
