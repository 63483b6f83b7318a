"""Removal of repeated passages against a brute-force scan of all windows."""

import hashlib
import random

import numpy as np

from ledgerleaf.llm import suffixes
from ledgerleaf.llm.queries import op7_suffix_shards


def brute(docs):
    """docs: (key, text) in order -> key: (n_bytes, n_removed, n_spans, sha)."""
    first, out = {}, {}
    for key, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for at in range(len(data) - 99):
            window = data[at:at + 100]
            if first.setdefault(window, (key, at)) != (key, at):
                gone[at:at + 100] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(data) else 0
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[key] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def some_documents(n, seed):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdé") for _ in range(pick.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(pick.randrange(8, 60))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(pick.randrange(0, 40))) if pick.random() < 0.6 else pick.choice(passages) for _ in range(pick.randrange(0, 6))]
        docs.append((i, " ".join(parts)))
    docs += [(n, "x" * 350), (n + 1, "ab" * 200), (n + 2, None), (n + 3, ""), (n + 4, docs[0][1]), (n + 5, "y" * 99 + "x" * 101 + "\x00" * 250)]
    return docs


def rows_of(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_against_brute_force(spark):
    docs = some_documents(300, 5)
    assert rows_of(suffixes.removal_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))) == brute(docs)


def test_dealt_anchors_and_small_slices(spark, monkeypatch):
    docs = some_documents(120, 9)
    monkeypatch.setattr(suffixes, "SHARD_RUNS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows_of(suffixes.removal_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))) == brute(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_text(spark):
    pick = random.Random(2)
    text = "".join(pick.choice("abcdefgh ") for _ in range(1_300_000))
    docs = [(1, text), (2, text[600_000:600_500] + "z" * 30), (3, text[1_048_000:1_049_500])]
    assert rows_of(suffixes.removal_report(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_repeated_and_null_ids(spark):
    a, b = "p" * 10 + "".join(map(str, range(200))), "q" * 150
    rows = [(1, a), (1, a), (None, a), (2, b)]
    got = sorted(suffixes.removal_report(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_removed > 100) for r in got] == [(1, False), (1, False), (2, True), (None, True)]
    assert suffixes.removal_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert rows_of(op7_suffix_shards(spark, sf)) == brute(docs)
