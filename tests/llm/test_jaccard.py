"""Near duplicates against a brute-force join of all shingle sets."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerleaf.llm import jaccard
from ledgerleaf.llm.graphs import components


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                label[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(n, seed, words):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefg") for _ in range(pick.randrange(1, 6)))
    line = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(n):
        if texts and pick.random() < 0.6:
            own = pick.choice(texts).split(" ")
            for _ in range(pick.randrange(0, 5)):
                at = pick.randrange(len(own))
                own[at:at + pick.randrange(0, 2)] = [word()] * pick.randrange(0, 2)
            texts.append(" ".join(own))
        else:
            texts.append(" ".join([*(word() for _ in range(pick.randrange(1, words))), line if pick.random() < 0.7 else "", *(word() for _ in range(pick.randrange(0, words)))]))
    return texts


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in jaccard.near_duplicate_components(docs).collect()), key=repr) == brute(rows)


def test_against_brute_force(spark):
    texts = near_copies(250, 3, 60)
    odd = [(None, texts[0]), (1, texts[1]), (1, texts[1]), (7, "ONE two"), (8, "one TWO"), (9, None), (10, " \n"), (11, ""), (12, "É é"), (13, "é é"), (14, "A"), (15, "word " * 3000)]
    check(spark, [(i + 20, t) for i, t in enumerate(texts)] + odd)


def test_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "STAR", 2)
    monkeypatch.setattr(jaccard, "POINT_TILE", 6)
    monkeypatch.setattr(jaccard, "SET_TILE", 3)
    check(spark, list(enumerate(near_copies(220, 8, 25))))


def test_without_stars(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_central_pairs", lambda shared: shared.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b")))
    monkeypatch.setattr(jaccard, "POINT_TILE", 5)
    monkeypatch.setattr(jaccard, "SET_TILE", 4)
    monkeypatch.setattr(jaccard, "OWN", 1)
    check(spark, list(enumerate(near_copies(220, 9, 40))))


def test_tree_join_loses_no_pair():
    rng = np.random.default_rng(1)
    base = rng.poisson(4, (40, 64))
    points = np.concatenate([base + rng.poisson(0.2, base.shape) for _ in range(8)])
    n = points.sum(axis=1)
    order = np.argsort(n, kind="stable")
    points, n = points[order].astype(np.int32), n[order]
    label, side = np.arange(len(n)), rng.integers(0, 3, len(n))
    got = set(zip(*(x.tolist() for x in jaccard.tree_join(points, n, label, side))))
    want = {(i, j) for j in range(len(n)) for i in range(j) if (side[i] != side[j] or side[i] == 2) and 7 * np.minimum(points[i], points[j]).sum() >= 3 * (n[i] + n[j])}
    assert got == want and want


def test_components_of_a_long_path(spark):
    order = list(range(300))
    random.Random(4).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:]), (1000, 1001)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(300), 0), 1000: 1000, 1001: 1000}


def test_keep_one(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(5, a, "x"), (3, a.upper(), "y"), (4, b, "z"), (4, b, "z"), (None, b + " u", "z"), (6, None, "n"), (7, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = sorted(map(tuple, jaccard.keep_one_of_each(docs).collect()), key=lambda r: r[0])
    assert kept == [(3, a.upper(), "y"), (4, b, "z"), (6, None, "n"), (7, "", "n")]
    assert jaccard.keep_one_of_each(docs.limit(0)).count() == 0
