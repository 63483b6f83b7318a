"""Ball k-means codes against plain k-means in whole numbers."""

import math

import numpy as np
import pytest

from ledgerleaf.llm import balls


def plain(rows, parts, entries, rounds):
    """Every part against every entry; rows are (vec_id, vector) that take part."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, len(r[1]), r[1]))
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows], np.int64)
    x = x.reshape(len(rows), parts, -1)
    books = x[:entries].swapaxes(0, 1).copy()
    for k in range(rounds + 1):
        apart = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        codes = apart.argmin(2)
        if k < rounds:
            for p in range(parts):
                for e in set(codes[:, p].tolist()):
                    books[p, e] = [int(s) // int((codes[:, p] == e).sum()) for s in x[codes[:, p] == e, p].sum(0)]
    return [(i, v, bytes(c.tolist()), int(e)) for (i, v), c, e in zip(rows, codes, apart.min(2).sum(1))], books


def key(r):
    return repr(r)


@pytest.mark.parametrize("spread, entries, rounds", [(1.0, 64, 2), (0.01, 7, 5), (5.0, 64, 4)])
def test_equals_plain_k_means(spark, spread, entries, rounds):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(9, 32)) * spread
    rows = [(i, (middles[i % 9] + rng.normal(size=32) * 0.1).tolist()) for i in range(1500)]
    rows += [(i, rows[3][1]) for i in range(1500, 1900)]  # a very common vector
    vectors = spark.createDataFrame([(i, v, i % 3) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(5)
    made = balls.ball_codes(vectors, parts=8, entries=entries, rounds=rounds)
    want, books = plain(rows, 8, entries, rounds)
    assert (made.codebooks == books).all()
    assert sorted((r.vec_id, bytes(r.code), r.error) for r in made.rows.collect()) == sorted((i, c, e) for i, _, c, e in want)


def test_cores_and_settled_balls_skip_work():
    centers = np.array([[[0, 0], [100, 0], [101, 0], [5000, 0]]])
    made = balls.balls_of(centers, np.array([[30 * 30, 1, 2, 10]]), np.array([[1, 1, 0, 0]]))
    # The ball of entry 0 reaches no other; entry 3 did not move and has no neighbour.
    assert (made.rings[0, 0] == balls.FAR).all() and (made.rings[0, 3] == balls.FAR).all()
    # Entries 1 and 2 stand close together: each is the other's only neighbour.
    assert made.rings[0, 1].tolist() == [1, balls.FAR, balls.FAR] and made.nearest[0, 1, 0] == 2
    entry, apart = balls.assign_near(np.array([[0, 3], [100, 1], [101, 0]]), np.array([0, 2, 1]), made, 0)
    assert entry.tolist() == [0, 1, 2] and apart.tolist() == [9, 1, 0]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), -0.004 * i, i / 7, 1e-9], i % 2 or None) for i in range(70)]
    good += [(3, [9.0, 9.0, 9.0, 9.0], 1), good[5], (None, [1.0, -1.0, 2.0, -2.0], None), (None, [0.0] * 4, 5), (2, [-1e5, 1e5, 0.0, -0.0], 1)]
    bad = [(90, None, 1), (91, [nan, 1.0, 1.0, 1.0], 1), (92, [inf, 1.0, 1.0, 1.0], 1), (93, [None, 1.0, 1.0, 1.0], None), (94, [], 1), (95, [1.0] * 3, 1), (96, [1.0] * 8, 1)]
    names = "vec_id long, embedding array<double>, label int"
    vectors = spark.createDataFrame(good + bad, names).selectExpr("*", "'a' AS code", "1 AS error", "'b' AS part", "2 AS x", "3 AS of", "4 AS label_error")
    made = balls.ball_codes(vectors, parts=2, entries=64, rounds=2)
    want, books = plain([(i, v) for i, v, _ in good], 2, 64, 2)
    assert (made.codebooks == books).all()
    got = balls.with_label_error(made.rows)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error"]
    rows = got.collect()
    assert sorted(((r.vec_id, bytes(r.code), r.error) for r in rows), key=key) == sorted(((i, c, e) for i, _, c, e in want), key=key)
    for label in (None, 1, 5):
        own = [r for r in rows if r.label == label]
        assert own and {r.label_error for r in own} == {sum(r.error for r in own)}
    assert sum(r.error for r in rows) > 0


def test_small_and_empty(spark):
    few = spark.createDataFrame([(4, [1.0, 2.0], 1), (2, [0.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    made = balls.ball_codes(few, parts=2)
    assert made.codebooks.tolist() == [[[0], [256]], [[0], [512]]]
    assert sorted((r.vec_id, bytes(r.code), r.error) for r in made.rows.collect()) == [(2, b"\0\0", 0), (4, b"\1\1", 0)]
    empty = balls.ball_codes(few.limit(0), parts=2)
    assert balls.with_label_error(empty.rows).count() == 0 and empty.codebooks.shape == (2, 0, 0)
    with pytest.raises(ValueError):
        balls.ball_codes(few, entries=300)
