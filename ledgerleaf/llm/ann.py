"""Nearest neighbours by inner product: hierarchical k-means tree, best bin first.

A vector x of length up to M becomes (x, sqrt(M^2 - |x|^2)); the largest inner
product with a query is then the smallest distance to (query, 0), so a k-means
tree serves. The tree is fitted on a bounded sample; every vector is filed in
its leaf. A query walks the tree with a priority queue, nearest centre first;
how many leaves it visits is calibrated: on held-out queries whose true
neighbours are found by brute force, visits widen until the recall is reached.

Equal vectors are filed once, with as many of their ids (the smallest) as a
result can hold, so a very common vector is one row. Leaves stand on shelves of
bounded size, large leaves are cut over several, and the queries that visit a
shelf are cut into parts, so no task holds more than one of each; of a shelf,
each query is compared with the leaves it visits and gives ``k`` rows on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerleaf.llm.common import stored

#: Vectors the tree is fitted on, and held-out queries it is calibrated with; both at most.
SAMPLE, HELD_OUT = 20_000, 200
LEAF_ROWS, BRANCHES = 400, 8
SHELF_ROWS, PART_QUERIES = 16_384, 2048
RECALL = 0.97


class Tree(NamedTuple):
    centers: np.ndarray  # one row for each node but the root
    children: list  # of each node, the root last: rows of ``centers``; empty for leaves
    leaf: list  # of each node: its leaf number, or -1
    longest: float  # square of the largest length

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1


def usable(vector: Column, dimension: int) -> Column:
    """No null, zero or non-finite vector, and none of another dimension."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) == dimension) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1)))
    return np.column_stack([x, rest])


def _ask(q: np.ndarray, longest: float) -> np.ndarray:
    """Queries as points: their length does not change the order, so it is set to the longest."""
    scale = np.sqrt(longest / np.maximum((q * q).sum(axis=1), 1e-300))
    return np.column_stack([q * scale[:, None], np.zeros(len(q))])


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)


def _split(x: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray]:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        own = _distances(x, centers).argmin(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=k)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers, _distances(x, centers).argmin(axis=1)


def fit_tree(sample: np.ndarray, longest: float, leaves: int) -> Tree:
    """Hierarchical k-means on a sample: nodes are split until they hold their share of it."""
    x, rng = _lift(sample, longest), np.random.default_rng(11)
    share = max(2 * BRANCHES, int(np.ceil(len(x) / max(1, leaves))))
    centers: list[np.ndarray] = []
    children: list[list[int]] = []
    todo, root = [], []

    def grow(rows: np.ndarray, into: list[int]) -> None:
        found, own = _split(x[rows], min(BRANCHES, len(rows)), rng)
        parts = [rows[own == c] for c in range(len(found))]
        for center, part in zip(found, parts):
            if not len(part):
                continue
            into.append(len(centers))
            centers.append(center)
            children.append([])
            if share < len(part) < len(rows):
                todo.append((part, children[-1]))

    if leaves > 1 and len(x) > share:
        grow(np.arange(len(x)), root)
    else:
        root.append(0)
        centers.append(x.mean(axis=0) if len(x) else np.zeros(sample.shape[1] + 1))
        children.append([])
    while todo:
        grow(*todo.pop())
    numbers = iter(range(len(centers)))
    leaf = [next(numbers) if not c else -1 for c in children]
    return Tree(np.array(centers), [*children, root], leaf, longest)


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of every vector: the nearest centre, level by level."""
    distance = _distances(_lift(x, tree.longest), tree.centers)
    out = np.empty(len(x), np.int32)
    todo = [(tree.children[-1], np.arange(len(x)))]
    while todo:
        nodes, rows = todo.pop()
        nearest = np.array(nodes)[distance[np.ix_(rows, nodes)].argmin(axis=1)]
        for node in set(nearest.tolist()):
            mine = rows[nearest == node]
            if tree.leaf[node] >= 0:
                out[mine] = tree.leaf[node]
            else:
                todo.append((tree.children[node], mine))
    return out


def visits(tree: Tree, distance: np.ndarray, counts: np.ndarray, at_least: int, rows: int) -> list[int]:
    """Leaves of one query, best bin first: ``at_least`` leaves that hold ``rows`` rows or more."""
    heap = [(distance[n], n) for n in tree.children[-1]]
    heapq.heapify(heap)
    out, held = [], 0
    while heap and (len(out) < at_least or held < rows):
        _, node = heapq.heappop(heap)
        if tree.leaf[node] >= 0:
            out.append(tree.leaf[node])
            held += counts[tree.leaf[node]]
        else:
            for child in tree.children[node]:
                heapq.heappush(heap, (distance[child], child))
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(array.flatten(), np.float64).reshape(-1, dimension)


def _file(tree, dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaf_of(tree.value, _matrix(batch.column("vector"), dimension)) if batch.num_rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), *batch.columns], ["leaf", *batch.schema.names])

    return run


def _brute(asked, dimension: int, k: int):
    """Best ``k`` filed vectors of a task for each held-out query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = asked.value
        best = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int32))] * len(ids)
        for batch in batches:
            scores = q @ _matrix(batch.column("vector"), dimension).T
            own, leaf = np.asarray(batch.column("rid")), np.asarray(batch.column("leaf"))
            for i in range(len(ids)):
                s = np.append(best[i][0], scores[i])
                r, at = np.append(best[i][1], own), np.append(best[i][2], leaf)
                top = np.lexsort((r, -s))[:k]
                best[i] = (s[top], r[top], at[top])
        for i, (s, r, at) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), ids[i])), pa.array(r), pa.array(at, pa.int32()), pa.array(s)], ["query_id", "rid", "leaf", "score"])

    return run


def _calibrate(filed: DataFrame, held: list, tree: Tree, shared_tree, counts: np.ndarray, dimension: int, k: int, recall: float) -> int:
    """The number of leaf visits at which held-out queries reach ``recall`` against brute force."""
    ids, q = np.array([r["rid"] for r in held], np.int64), np.array([r["vector"] for r in held], np.float64)
    asked = filed.sparkSession.sparkContext.broadcast((ids, q))
    found = filed.mapInArrow(_brute(asked, dimension, k + 1), "query_id long, rid long, leaf int, score double").where("rid <> query_id")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "rid")
    truth: dict[int, list[int]] = {}
    for row in found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).collect():  # at most HELD_OUT * k rows
        truth.setdefault(row["query_id"], []).append(row["leaf"])
    distance = _distances(_ask(q, tree.longest), tree.centers)
    reached = np.zeros(tree.leaves + 1)
    for i, query in enumerate(ids.tolist()):
        place = {leaf: p for p, leaf in enumerate(visits(tree, distance[i], counts, tree.leaves, 0))}
        for leaf in truth.get(query, []):
            reached[place[leaf] + 1] += 1 / len(truth[query])
    if not truth:
        return 1
    return int(np.argmax(np.cumsum(reached) / len(truth) >= min(recall, 1.0) - 1e-9)) or 1


def shelves(rows: np.ndarray) -> list[list[int]]:
    """The shelves of every leaf: several small leaves share one, a large one has several of its own."""
    out: list[list[int]] = []
    last, held = -1, SHELF_ROWS
    for n in rows.tolist():
        if n > SHELF_ROWS:
            own = -(-n // SHELF_ROWS)
            out.append(list(range(last + 1, last + 1 + own)))
            last, held = last + own, SHELF_ROWS
            continue
        if held + n > SHELF_ROWS:
            last, held = last + 1, 0
        held += n
        out.append([last])
    return out


def _walk(tree, counts: np.ndarray, places: list[list[int]], at_least: int, rows: int, dimension: int):
    """Queries -> one row for each shelf they visit, with the leaves they visit there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            distance = _distances(_ask(_matrix(batch.column("vector"), dimension), tree.value.longest), tree.value.centers)
            row, shelf, leaves = [], [], []
            for i in range(batch.num_rows):
                seen: dict[int, list[int]] = {}
                for leaf in visits(tree.value, distance[i], counts, at_least, rows):
                    for place in places[leaf]:
                        seen.setdefault(place, []).append(leaf)
                row += [i] * len(seen)
                shelf += seen
                leaves += seen.values()
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shelf, pa.int32()), pa.array(leaves, pa.list_(pa.int32())), batch.column("query_id").take(take), batch.column("vector").take(take)],
                ["shelf", "leaves", "query_id", "vector"],
            )

    return run


def _compare(dimension: int, k: int):
    """A part of a shelf's queries against its vectors -> the best ``k`` ids of each query."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def run(queries: pa.Table, shelf: pa.Table) -> pa.Table:
        if not queries.num_rows or not shelf.num_rows:
            return empty
        q, x = _matrix(queries.column("vector"), dimension), _matrix(shelf.column("vector"), dimension)
        own, ids = np.asarray(queries.column("query_id")), shelf.column("ids").to_pylist()
        leaf = np.asarray(shelf.column("leaf"))
        visitors: dict[int, list[int]] = {}
        for i, leaves in enumerate(queries.column("leaves").to_pylist()):
            for at in leaves:
                visitors.setdefault(at, []).append(i)
        near: list[list[np.ndarray]] = [[] for _ in range(len(q))]
        for at, asking in visitors.items():
            rows = np.flatnonzero(leaf == at)
            if not len(rows):
                continue
            # Every row that is not below the k-th by more than rounding goes on, so ties are settled exactly; one more for the query itself.
            width = min(k + 1, len(rows))
            slack = 1e-12 * dimension * float(np.abs(x[rows]).max())
            for first in range(0, len(asking), 256):
                some = asking[first:first + 256]
                scores = q[some] @ x[rows].T
                edge = np.partition(scores, len(rows) - width, axis=1)[:, len(rows) - width] - slack * np.abs(q[some]).max(axis=1)
                for i, row, least in zip(some, scores, edge):
                    near[i].append(rows[row >= least])
        out_q, out_v, out_s = [], [], []
        for i, found in enumerate(near):
            if not found:
                continue
            rows = np.concatenate(found)
            exact = (x[rows] * q[i]).sum(axis=1)
            # Ids of equal scores are ranked together; a row holds the smallest ids of its vector.
            ranked: list[tuple[float, int]] = []
            for at in np.argsort(-exact, kind="stable").tolist():
                if len(ranked) >= k and -exact[at] > ranked[k - 1][0]:
                    break
                ranked += [(-exact[at], v) for v in ids[rows[at]] if v != own[i]]
                if len(ranked) > 4 * k:
                    ranked = sorted(ranked)[:k]
                else:
                    ranked.sort()
            for score, v in sorted(ranked)[:k]:
                out_q.append(own[i])
                out_v.append(v)
                out_s.append(-score)
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score of the ``k`` best rows for each row that ``queries`` marks.

    Score: inner product in double precision; equal scores in the order of
    vec_id. A query's own id is no candidate. Null, zero or non-finite vectors,
    vectors without id and those not of the most frequent dimension take no
    part; repeated rows count once each id, and of an id with several vectors the
    smallest asks; with fewer candidates than ``k`` all
    are returned; an empty table gives an empty result. Tree, calibration and
    counts run at once.
    """
    spark = vectors.sparkSession
    sizes = vectors.where("embedding IS NOT NULL AND size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count()
    most = sizes.orderBy(F.desc("count"), "d").first()
    dimension = most["d"] if most else 1
    clean = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), dimension)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vector")
    )
    clean = stored(clean, "vectors")
    # Of equal vectors, the k + 1 smallest ids are all that a result can name; cut before the shuffle.
    first = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    distinct = clean.withColumn("place", first).where(F.col("place") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    filed = stored(distinct.select(F.col("ids")[0].alias("rid"), "ids", "vector"), "distinct-vectors")
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    whole = filed.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).first()
    out = "query_id long, rank int, vec_id long, score double"
    if not whole["n"]:
        return spark.createDataFrame([], out)
    # Samples of bounded size, by digest of the id.
    chosen = filed.orderBy(F.xxhash64("rid", F.lit(1)), "rid").limit(sample).select("vector").collect()
    held = filed.orderBy(F.xxhash64("rid", F.lit(2)), "rid").limit(HELD_OUT).select("rid", "vector").collect()
    leaves = max(1, min(whole["n"] // LEAF_ROWS, len(chosen) // (2 * BRANCHES)))
    tree = fit_tree(np.array([r["vector"] for r in chosen], np.float64), whole["longest"], leaves)
    shared_tree = spark.sparkContext.broadcast(tree)
    filed = stored(filed.mapInArrow(_file(shared_tree, dimension), "leaf int, rid long, ids array<long>, vector array<double>"), "leaves")
    rows, held_ids = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves, np.int64)
    for row in filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids")).collect():  # one row a leaf
        rows[row["leaf"]], held_ids[row["leaf"]] = row["n"], row["ids"]
    at_least = _calibrate(filed, held, tree, shared_tree, held_ids, dimension, k, recall)
    places = shelves(rows)
    # Of a repeated id, the smallest vector asks.
    asked = clean.where(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    walks = stored(
        asked.mapInArrow(_walk(shared_tree, held_ids, places, at_least, k + 1, dimension), "shelf int, leaves array<int>, query_id long, vector array<double>"), "walks"
    )
    parts = {r["shelf"]: -(-r["n"] // PART_QUERIES) for r in walks.groupBy("shelf").agg(F.count(F.lit(1)).alias("n")).collect()}
    # One row a leaf and one a shelf; shelves are as many as leaves, or as blocks of the large ones.
    of_leaf = spark.createDataFrame([(leaf, own[0], len(own)) for leaf, own in enumerate(places)], "leaf int, shelf int, blocks int")
    of_shelf = spark.createDataFrame(list(parts.items()), "shelf int, parts int")
    mine = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    candidates = filed.join(F.broadcast(of_leaf), "leaf").withColumn("shelf", F.col("shelf") + mine).join(F.broadcast(of_shelf), "shelf")
    sides = (
        walks.join(F.broadcast(of_shelf), "shelf").select("shelf", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), "leaves", "query_id", "vector"),
        candidates.select("shelf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "leaf", "rid", "ids", "vector"),
    )
    near = sides[0].groupBy("shelf", "part").cogroup(sides[1].groupBy("shelf", "part")).applyInArrow(_compare(dimension, k), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
