"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from ledgerleaf.llm import ann
from ledgerleaf.llm.queries import op3_kmeans_tree


def brute(rows, k):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            s = (x * q).sum(axis=1)
            out[i] = [(ids[j], s[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def recall_of(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(found.get(q, set()) & {v for v, _ in w}) / len(w) for q, w in want.items()])


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = op3_kmeans_tree(spark, sf).collect()
    want = brute(rows, 20)
    assert recall_of(got, want) >= 0.9
    assert len(got) == 20 * len(want)
    x = dict(rows)
    for r in got:
        assert abs(r.score - float(np.dot(np.array(x[r.query_id], np.float64), np.array(x[r.vec_id], np.float64)))) < 1e-12
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(v == sorted(v) and len(v) == 20 for v in by_query.values())


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300, 400)]  # a group of equal vectors
    good = list(rows)
    rows += [(400, None), (420, [0.0] * 4), (440, [float("nan"), 1.0, 1.0, 1.0]), (460, [None, 1.0, 1.0, 1.0]), (480, [float("inf")] * 4), (500, [1.0]), (None, [1.0] * 4), rows[5]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(vectors, F.col("vec_id") % 20 == 0, recall=1.0).collect()
    want = brute(good, 20)
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(q, n + 1, v) for q, w in want.items() for n, (v, _) in enumerate(w)}


def test_small_and_empty(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(vectors, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 2, 1.0), (2, 1, 0.5)]
    assert ann.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_many_equal_scores_go_to_the_smaller_ids(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(0, 2, 12)]) for i in range(4000)]
    rows = [(i, v) for i, v in rows if any(v)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(vectors, F.col("vec_id") % 20 == 0, recall=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 20)
    assert {q: [(n, v, s) for n, v, s in sorted(found)] for q, found in got.items()} == {q: [(n + 1, v, s) for n, (v, s) in enumerate(w)] for q, w in want.items()}


def test_of_a_repeated_id_the_smallest_vector_asks(spark):
    rows = [(0, [2.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 3.0])]
    for order in (rows, rows[::-1]):
        vectors = spark.createDataFrame(order, "vec_id long, embedding array<double>")
        got = ann.nearest(vectors, F.col("vec_id") % 20 == 0, recall=1.0).collect()
        assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 2, 3.0), (2, 1, 0.0)]
