"""Exact recall of the best chunks for a table of queries, as one plan.

Queries stay a table. They are gathered into blocks of bounded size and the
corpus into packs of rows; every pack meets every block once, in a grid that
Spark lays over its tasks (packs of one corpus partition x some blocks). A task
keeps, per query, only its best ``k`` chunks of each route: a matrix product for
the vector route and a sparse product for BM25. So ``k`` rows per query and task
are shuffled, however large the corpus is, no (query, chunk) pair leaves a task,
and the number of jobs does not depend on the number of queries.

BM25 statistics and score bounds are earlier rounds over the same grid, whose
sums are joined to the blocks.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerleaf.functions.text import domain_tags, strip, tokenize
from ledgerleaf.operators.bm25 import B, K1, index_terms
from ledgerleaf.session import cut_lineage

MAX_QUERIES = 512  # per block
MAX_TEXT = 1_000_000  # characters of query text per block
PACK_ROWS = 1024  # rows of the corpus in one pack
MAX_LOCAL = 50_000  # ranked rows that are broadcast to the corpus; more of them are joined by a shuffle
PAIR_ROWS = 65_536  # scored pairs in one batch
RANK_DIGITS = 10  # scores closer than this are ties, decided by chunk id


# ---------------------------------------------------------------- filters
def metadata_prefilter(
    chunks: DataFrame, domain: str | None = None, effective_after: str | None = None, keep_undated: bool = False
) -> DataFrame:
    """Exact domain tag and lower date bound; a predicate exists only when asked for."""
    if domain is not None:
        chunks = chunks.filter(F.array_contains(domain_tags(F.col("domain")), domain))
    if effective_after is not None:
        dated = F.col("effective_date") >= effective_after
        if keep_undated:
            dated = dated | (strip(F.coalesce(F.col("effective_date"), F.lit(""))) == "")
        chunks = chunks.filter(dated)
    return chunks


class _Pair(NamedTuple):
    """One query against one scope: a filtered public corpus, or a user's chunks."""

    query_id: object
    scope: int
    vector: np.ndarray
    words: Counter


# ---------------------------------------------------------------- the grid
def query_blocks(queries: DataFrame) -> DataFrame:
    """``(block, asked)``: the queries in lists of about ``MAX_QUERIES`` at most, written once."""
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("query_text")).alias("chars")).first()
    count = max(1, math.ceil(size["n"] / MAX_QUERIES), math.ceil((size["chars"] or 0) / MAX_TEXT))
    for name in ("domain", "effective_after", "user_id"):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast("string"))
    asked = F.struct(
        "query_id", F.col("query_vec").cast("array<double>").alias("vector"), tokenize(F.col("query_text")).alias("words"),
        "domain", "effective_after", F.col("user_id").cast("string").alias("user_id"),
    )
    dealt = queries.select(F.pmod(F.monotonically_increasing_id(), F.lit(count)).cast("int").alias("block"), asked.alias("asked"))
    # The list is bounded by the number of blocks chosen above.
    return cut_lineage(dealt.groupBy("block").agg(F.collect_list("asked").alias("asked")))


def corpus_packs(corpus: DataFrame, vectors: bool, words: bool) -> DataFrame:
    """``(pack)``: up to ``PACK_ROWS`` rows of the corpus as one Arrow message, with the columns that scoring reads."""
    for name in ("domain", "effective_date", "user_id"):
        if name not in corpus.columns:
            corpus = corpus.withColumn(name, F.lit("").cast("string"))
    columns = [F.col("chunk_id"), domain_tags(F.col("domain")).alias("tags"), F.col("effective_date").alias("date")]
    columns += [(strip(F.coalesce(F.col("effective_date"), F.lit(""))) == "").alias("undated"), F.col("user_id").cast("string").alias("user_id")]
    columns += [F.col("embedding")] if vectors else []
    columns += [F.col("dl"), F.col("terms"), F.col("tfs")] if words else []

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_ROWS):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, PACK_ROWS))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["pack"])

    return corpus.select(*columns).mapInArrow(pack, "pack binary")


class _Asked:
    """A block as a task uses it: its pairs, and which rows of a pack each scope holds."""

    def __init__(self, rows: list[dict], personal: bool, keep_undated: bool) -> None:
        self.personal, self.keep_undated = personal, keep_undated
        if personal:
            rows = [r for r in rows if r["user_id"] is not None]
            self.scopes = list(dict.fromkeys(r["user_id"] for r in rows))
            scope_of = lambda r: self.scopes.index(r["user_id"])
        else:
            self.scopes = list(dict.fromkeys((r["domain"], r["effective_after"]) for r in rows))
            scope_of = lambda r: self.scopes.index((r["domain"], r["effective_after"]))
        self.pairs = [
            _Pair(r["query_id"], scope_of(r), np.asarray(r["vector"] if r["vector"] is not None else [], dtype=np.float64), Counter(r["words"] or []))
            for r in rows
        ]

    def rows_of(self, pack: pa.RecordBatch) -> dict[int, np.ndarray]:
        if self.personal:
            owner = pc.index_in(pack.column("user_id"), value_set=pa.array(self.scopes, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
            return {int(s): np.flatnonzero(owner == s) for s in np.unique(owner[owner >= 0])}
        tags, found = pack.column("tags"), {}
        for number, (tag, after) in enumerate(self.scopes):
            inside = np.ones(pack.num_rows, dtype=bool)
            if tag is not None:
                hit = pc.equal(tags.flatten(), tag).to_numpy(zero_copy_only=False).astype(bool)
                inside = np.bincount(pc.list_parent_indices(tags).to_numpy()[hit], minlength=pack.num_rows) > 0
            if after is not None:
                dated = pc.greater_equal(pack.column("date"), after).fill_null(False).to_numpy(zero_copy_only=False)
                if self.keep_undated:
                    dated = dated | pack.column("undated").to_numpy(zero_copy_only=False)
                inside &= dated
            if inside.any():
                found[number] = np.flatnonzero(inside)
        return found


def _met(batches: Iterator[pa.RecordBatch], prepare: Callable[[dict], object]) -> Iterator[tuple[int, object, pa.RecordBatch]]:
    """Every (block number, what ``prepare`` makes of the block, pack) of a task's part of the grid."""
    ready: dict[int, object] = {}
    for batch in batches:
        blocks = batch.column("block").to_pylist()
        others = [c for c in batch.schema.names if c not in ("pack", "block")]
        for i, number in enumerate(blocks):
            if number not in ready:
                ready[number] = prepare({c: batch.column(c)[i].as_py() for c in others})
            with pa.ipc.open_stream(batch.column("pack")[i].as_buffer()) as message:
                for pack in message:
                    yield number, ready[number], pack


# ---------------------------------------------------------------- statistics
class _ScopeStats(NamedTuple):
    n: int
    avgdl: float
    df: dict[str, int]


def _word_numbers(batch: pa.RecordBatch, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each asked word in the batch: its row, its number, its position among all words."""
    words = batch.column("terms")
    number = pc.index_in(words.flatten(), value_set=pa.array(vocabulary, pa.string()))
    number = number.fill_null(-1).to_numpy(zero_copy_only=False)
    place = np.flatnonzero(number >= 0)
    return pc.list_parent_indices(words).to_numpy()[place], number[place].astype(np.int64), place


def _scope_stats(grid: DataFrame, personal: bool, keep_undated: bool) -> DataFrame:
    """``(block, stats)``: chunk count, total length and document frequencies of each block's scopes.

    Tasks count their own rows; what is summed up has at most one row per block,
    scope and asked word (the null word carries the scope's totals).
    """

    def prepare(row: dict):
        asked = _Asked(row["asked"], personal, keep_undated)
        by_scope: dict[int, set[str]] = defaultdict(set)
        for pair in asked.pairs:
            by_scope[pair.scope].update(pair.words)
        vocabulary = sorted(set().union(*by_scope.values())) if by_scope else []
        place = {w: i for i, w in enumerate(vocabulary)}
        return asked, vocabulary, {s: np.array(sorted(place[w] for w in ws), dtype=np.int64) for s, ws in by_scope.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list[int]] = {}
        df_in: dict[tuple[int, int], np.ndarray] = {}
        known: dict[int, tuple] = {}
        for block, made, pack in _met(batches, prepare):
            asked, vocabulary, wanted = known.setdefault(block, made)
            row_of, number, _place = _word_numbers(pack, vocabulary)
            dl = pack.column("dl").to_numpy(zero_copy_only=False)
            for scope, rows in asked.rows_of(pack).items():
                inside = np.zeros(pack.num_rows, dtype=bool)
                inside[rows] = True
                counts = np.bincount(number[inside[row_of]], minlength=len(vocabulary))[wanted[scope]]
                at = block, scope
                old = totals.get(at, [0, 0])
                totals[at] = [old[0] + len(rows), old[1] + int(dl[rows].sum())]
                df_in[at] = df_in[at] + counts if at in df_in else counts
        for (block, scope), df in df_in.items():
            _asked, vocabulary, wanted = known[block]
            seen = np.flatnonzero(df)
            size = len(seen) + 1
            n, dl = totals[block, scope]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * size, pa.int32()),
                    pa.array([scope] * size, pa.int32()),
                    pa.array([None, *(vocabulary[i] for i in wanted[scope][seen])], pa.string()),
                    pa.array([n, *df[seen].tolist()], pa.int64()),
                    pa.array([dl] + [0] * len(seen), pa.int64()),
                ],
                names=["block", "scope", "word", "n", "dl"],
            )

    counted = grid.mapInArrow(run, "block int, scope int, word string, n long, dl long")
    summed = counted.groupBy("block", "scope", "word").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
    # One entry for each scope and asked word of a block.
    return summed.groupBy("block").agg(F.collect_list(F.struct("scope", "word", "n", "dl")).alias("stats"))


def _stats_of(rows: list[dict] | None) -> dict[int, _ScopeStats]:
    df: dict[int, dict[str, int]] = defaultdict(dict)
    for r in rows or []:
        if r["word"] is not None:
            df[r["scope"]][r["word"]] = r["n"]
    return {r["scope"]: _ScopeStats(r["n"], r["dl"] / r["n"], df[r["scope"]]) for r in rows or [] if r["word"] is None}


# ---------------------------------------------------------------- the scan
def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, score descending then id ascending."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= bound)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))


class TopK:
    """The k best (score, id) seen so far by one task for one query and route."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.empty(0), None

    def least(self) -> float:
        """What a score must reach to count."""
        return self.scores[-1] if len(self.scores) == self.k else -math.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k:
            keep = np.flatnonzero(scores >= self.scores[-1])
            scores, ids = scores[keep], ids[keep]
        if not len(scores):
            return
        if self.ids is not None:
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = _best(scores, ids, self.k)
        self.scores, self.ids = scores[order], ids[order]


class _Scorer:
    """Both scores of every pair over one pack."""

    def __init__(self, pairs: list[_Pair], stats: dict[int, _ScopeStats], vectors: bool, words: bool) -> None:
        self.pairs, self.vectors, self.words = pairs, vectors, words
        self.by_scope: dict[int, list[int]] = defaultdict(list)
        for no, pair in enumerate(pairs):
            if pair.scope in stats:
                self.by_scope[pair.scope].append(no)
        self.vocabulary = sorted({w for p in pairs for w in p.words}) if words else []
        place = {w: i for i, w in enumerate(self.vocabulary)}
        self.avgdl = {s: st.avgdl or 1.0 for s, st in stats.items()}
        self.weights = []
        for pair in pairs:
            st = stats.get(pair.scope)
            weight = {}
            for word, mult in pair.words.items() if st else ():
                df = st.df.get(word, 0)
                if df:
                    weight[place[word]] = mult * math.log(1 + (st.n - df + 0.5) / (df + 0.5))
            self.weights.append(weight)
        norms = [float(np.linalg.norm(p.vector)) for p in pairs]
        self.units = [p.vector / n if n > 0 else p.vector for p, n in zip(pairs, norms)]

    def __call__(self, batch: pa.RecordBatch, scopes: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """Yields (pair number, row numbers, vector scores, word scores)."""
        count = batch.num_rows
        if self.vectors:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            matrix = flat.reshape(count, -1)
            length = np.linalg.norm(matrix, axis=1)
            matrix = matrix / np.where(length > 0, length, 1.0)[:, None]
        if self.words:
            row_of, term_no, place_of = _word_numbers(batch, self.vocabulary)
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)[place_of].astype(np.float64)
            dl = batch.column("dl").to_numpy(zero_copy_only=False).astype(np.float64)
            # Entries of one word lie together, so a query touches only its own words.
            by_term = np.argsort(term_no, kind="stable")
            start = np.searchsorted(term_no[by_term], np.arange(len(self.vocabulary) + 1))
            row_by_term = row_of[by_term]
        for scope, rows in scopes.items():
            members = self.by_scope.get(scope)
            if not members:
                continue
            sims = None
            if self.vectors:
                sims = matrix[rows] @ np.stack([self.units[no] for no in members]).T
            if self.words:
                part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row_of] / self.avgdl[scope]))
                part = part[by_term]
            for place, no in enumerate(members):
                lexical = None
                if self.words:
                    spans = [(start[t], start[t + 1], w) for t, w in self.weights[no].items()]
                    sums = np.zeros(count)
                    if spans:
                        at = np.concatenate([row_by_term[a:b] for a, b, _w in spans])
                        sums = np.bincount(at, np.concatenate([part[a:b] * w for a, b, w in spans]), minlength=count)
                    lexical = np.round(sums[rows], RANK_DIGITS)
                similar = np.round(sims[:, place], RANK_DIGITS) if sims is not None else None
                yield no, rows, similar, lexical


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("chunk_id")
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    return np.array(column.to_pylist(), dtype=str)


def _prepared(personal: bool, keep_undated: bool, vectors: bool, words: bool) -> Callable[[dict], tuple]:
    def prepare(row: dict) -> tuple:
        asked = _Asked(row["asked"], personal, keep_undated)
        # Without the word route only the scopes are needed, and no statistics.
        stats = _stats_of(row["stats"]) if words else {p.scope: _ScopeStats(1, 1.0, {}) for p in asked.pairs}
        ranges = {r["pair"]: (r["low_v"], r["high_v"], r["low_b"], r["high_b"]) for r in row.get("ranges") or []}
        return asked, _Scorer(asked.pairs, stats, vectors, words), ranges

    return prepare


def _local_top(prepare: Callable[[dict], tuple], k: int, full: bool, vec_weight: float, query_type: pa.DataType, id_type: pa.DataType):
    """The task function: best k per pair and route, or per pair by fused score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[tuple[int, int, str], TopK] = {}
        pairs: dict[int, list[_Pair]] = {}
        for block, (asked, scorer, ranges), pack in _met(batches, prepare):
            pairs[block] = asked.pairs
            ids = _ids(pack)
            for no, rows, similar, lexical in scorer(pack, asked.rows_of(pack)):
                if full:
                    low_v, high_v, low_b, high_b = ranges[no]
                    fused = vec_weight * _scale(similar, low_v, high_v) + (1 - vec_weight) * _scale(lexical, low_b, high_b)
                    routes = {"fused": np.round(fused, RANK_DIGITS)}
                else:
                    routes = {"vector": similar, "bm25": lexical}
                for route, scores in routes.items():
                    if scores is not None:
                        tops.setdefault((block, no, route), TopK(k)).add(scores, ids[rows])
        for (block, no, route), top in tops.items():
            size = len(top.scores)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * size, pa.int32()),
                    pa.array([no] * size, pa.int32()),
                    pa.array([pairs[block][no].query_id] * size, query_type),
                    pa.array([route] * size, pa.string()),
                    pa.array(top.ids.tolist(), id_type),
                    pa.array(top.scores, pa.float64()),
                ],
                names=["block", "pair", "query_id", "route", "chunk_id", "score"],
            )

    return run


def _scale(values: np.ndarray, low: float, high: float) -> np.ndarray:
    if high == low:
        return np.full(len(values), 1.0 if high > 0 else 0.0)
    return (values - low) / (high - low)


def _local_range(prepare: Callable[[dict], tuple]):
    """The task function: lowest and highest score per pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list[float]] = {}
        for block, (asked, scorer, _ranges), pack in _met(batches, prepare):
            for no, _rows, similar, lexical in scorer(pack, asked.rows_of(pack)):
                new = [similar.min(), similar.max(), lexical.min(), lexical.max()]
                old = seen.get((block, no), new)
                seen[block, no] = [min(old[0], new[0]), max(old[1], new[1]), min(old[2], new[2]), max(old[3], new[3])]
        if seen:
            keys = [pa.array(list(c), pa.int32()) for c in zip(*seen)]
            table = keys + [pa.array(list(c), pa.float64()) for c in zip(*seen.values())]
            yield pa.RecordBatch.from_arrays(table, names=["block", "pair", "low_v", "high_v", "low_b", "high_b"])

    return run


_RANGES = "block int, pair int, low_v double, high_v double, low_b double, high_b double"


def _score_corpus(
    blocks: DataFrame, corpus: DataFrame, personal: bool, k: int, vectors: bool, words: bool, keep_undated: bool,
    full: bool, vec_weight: float,
) -> DataFrame:
    """The best ``k`` per query and route in one corpus."""
    if words and "terms" not in corpus.columns:
        corpus = index_terms(corpus)
    if personal:
        # Only chunks of users who ask.
        users = blocks.select(F.explode("asked.user_id").alias("user_id")).where("user_id is not null").distinct()
        corpus = corpus.withColumn("user_id", F.col("user_id").cast("string")).join(users, "user_id", "left_semi")
    packs = corpus_packs(corpus, vectors, words)
    if words:
        blocks = blocks.join(_scope_stats(packs.crossJoin(blocks), personal, keep_undated), "block", "left")
    prepare = _prepared(personal, keep_undated, vectors, words)
    if full:
        spans = packs.crossJoin(blocks).mapInArrow(_local_range(prepare), _RANGES).groupBy("block", "pair").agg(
            F.min("low_v").alias("low_v"), F.max("high_v").alias("high_v"), F.min("low_b").alias("low_b"), F.max("high_b").alias("high_b"),
        )
        # One entry for each pair of a block.
        listed = spans.groupBy("block").agg(F.collect_list(F.struct(*spans.columns[1:])).alias("ranges"))
        blocks = blocks.join(listed, "block", "left")
    query_type, id_type = blocks.schema["asked"].dataType.elementType["query_id"].dataType, corpus.schema["chunk_id"].dataType
    schema = T.StructType([
        *T.StructType.fromDDL("block int, pair int").fields, T.StructField("query_id", query_type), T.StructField("route", T.StringType()),
        T.StructField("chunk_id", id_type), T.StructField("score", T.DoubleType()),
    ])
    local = packs.crossJoin(blocks).mapInArrow(
        _local_top(prepare, k, full, vec_weight, to_arrow_type(query_type), to_arrow_type(id_type)), schema
    )
    order = W.partitionBy("block", "pair", "route").orderBy(F.desc("score"), F.asc("chunk_id"))
    best = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    name = "personal" if personal else "public"
    return best.select("query_id", F.lit(name).alias("corpus"), "route", "chunk_id", "score", "rank")


def recall(
    queries: DataFrame,
    public: DataFrame | None,
    personal: DataFrame | None = None,
    k: int = 15,
    vectors: bool = True,
    words: bool = True,
    keep_undated: bool = False,
    full: bool = False,
    vec_weight: float = 0.7,
) -> DataFrame:
    """Best ``k`` chunks per query, corpus (public / personal) and route (vector / bm25).

    With ``full``, the one route is ``fused``: both scores of all chunks in scope,
    scaled by their bounds and weighted. Queries without a user see no personal
    chunks. One plan for all queries; filter the corpus beforehand
    (``metadata_prefilter``) where all of them share a filter, so that it
    reaches the scan.
    """
    blocks = query_blocks(queries)
    found = [
        _score_corpus(blocks, corpus, corpus is personal, k, vectors, words, keep_undated, full, vec_weight)
        for corpus in (public, personal) if corpus is not None
    ]
    return reduce(DataFrame.unionByName, found)


# ---------------------------------------------------------------- all pairs that share a word
class _Weights:
    """The weights of a block of queries as a task uses them: those of a query lie together."""

    def __init__(self, rows: list[dict]) -> None:
        rows = sorted(rows, key=lambda r: r["query"])
        self.vocabulary = sorted({r["term"] for r in rows})
        place = {w: i for i, w in enumerate(self.vocabulary)}
        self.ids = {r["query"]: r["query_id"] for r in rows}
        self.words: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for r in rows:
            self.words[r["query"]].append((place[r["term"]], r["weight"]))


def score_shared(weights: DataFrame, indexed: DataFrame, avgdl: float) -> DataFrame:
    """``(query_id, chunk_id, score)`` of every pair that shares a weighted word, from ``weights`` (query_id, term, weight).

    Over the grid of packs and blocks; a pair is complete in the task that reads
    its chunk, and a task holds one pack and one batch of pairs at a time.
    """
    weights = cut_lineage(weights)
    numbers = cut_lineage(weights.groupBy("query_id").agg(F.count(F.lit(1)).alias("words")).withColumn("query", F.monotonically_increasing_id()))
    size = numbers.agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")).first()
    count = max(1, math.ceil(size["n"] / MAX_QUERIES), math.ceil((size["words"] or 0) * 8 / MAX_TEXT))
    listed = weights.join(numbers, weights["query_id"].eqNullSafe(numbers["query_id"])).select(
        F.pmod("query", F.lit(count)).cast("int").alias("block"), F.struct("query", weights["query_id"], "term", "weight").alias("w")
    )
    # The list is bounded by the number of blocks chosen above.
    blocks = cut_lineage(listed.groupBy("block").agg(F.collect_list("w").alias("asked")))
    query_type, id_type = weights.schema["query_id"].dataType, indexed.schema["chunk_id"].dataType
    arrow_query, arrow_id = to_arrow_type(query_type), to_arrow_type(id_type)
    names = ["query_id", "chunk_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _block, asked, pack in _met(batches, lambda row: _Weights(row["asked"])):
            row_of, number, place = _word_numbers(pack, asked.vocabulary)
            by_word = np.argsort(number, kind="stable")
            start = np.searchsorted(number[by_word], np.arange(len(asked.vocabulary) + 1))
            row_of = row_of[by_word]
            tf = pack.column("tfs").flatten().to_numpy(zero_copy_only=False)[place[by_word]].astype(np.float64)
            dl = pack.column("dl").to_numpy(zero_copy_only=False).astype(np.float64)
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row_of] / avgdl))
            made, held = [], 0
            for query, words in asked.words.items():
                at = np.concatenate([row_of[start[t]:start[t + 1]] for t, _w in words])
                sums = np.bincount(at, np.concatenate([part[start[t]:start[t + 1]] * w for t, w in words]), minlength=pack.num_rows)
                rows = np.flatnonzero(np.bincount(at, minlength=pack.num_rows))
                if not len(rows):
                    continue
                ids = pa.repeat(pa.scalar(asked.ids[query], arrow_query), len(rows))
                made.append(pa.RecordBatch.from_arrays([ids, pack.column("chunk_id").take(pa.array(rows)).cast(arrow_id), pa.array(sums[rows])], names=names))
                held += len(rows)
                if held >= PAIR_ROWS:
                    yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
                    made, held = [], 0
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]

    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("chunk_id", id_type), T.StructField("score", T.DoubleType())])
    packs = corpus_packs(indexed.select("chunk_id", "dl", "terms", "tfs"), vectors=False, words=True)
    return packs.crossJoin(blocks).mapInArrow(run, schema)


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Exact cosine search: ``(query_id, chunk_id, score, rank)``, score to 4 digits."""
    best = recall(queries, chunks, k=k, words=False)
    return best.select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` by BM25 on the filtered corpus; chunks that score 0 may fill the list."""
    best = recall(queries, chunks, k=k, vectors=False)
    return best.select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


def personal_recall(queries: DataFrame, personal: DataFrame, k: int = 15) -> DataFrame:
    """Both routes over the chunks of each query's own user."""
    return recall(queries, None, personal, k=k)


def personal_vector_search(queries: DataFrame, personal: DataFrame, k: int = 5) -> DataFrame:
    best = recall(queries, None, personal, k=k, words=False)
    return best.select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")
