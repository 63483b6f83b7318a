"""Stored postings with block maxima against the ranking of every chunk; the grid's number of jobs."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions.vectors import embed
from ledgerleaf.operators import postings as ps, recall as rc
from ledgerleaf.operators.bm25 import bm25_score, index_terms


@pytest.fixture(scope="module")
def corpus(spark):
    pick = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    # A few frequent words, a long tail, and many equal texts.
    texts = [" ".join(pick.choice(words[: 1 + int(400 * pick.random() ** 4)]) for _ in range(pick.randrange(1, 60))) for _ in range(4000)]
    texts += ["w0 w1 w2"] * 300 + [""] * 20
    rows = [(i, t) for i, t in enumerate(texts)]
    return index_terms(spark.createDataFrame(rows, "chunk_id int, content string").repartition(5))


@pytest.fixture(scope="module")
def stored(corpus, tmp_path_factory):
    return ps.store_postings(corpus, str(tmp_path_factory.mktemp("postings")))


def ask(spark, *texts):
    q = spark.createDataFrame(list(enumerate(texts)), "query_id int, query_text string")
    return q.withColumn("query_vec", F.array(F.lit(1.0)))


def test_equals_the_ranking_of_every_chunk(spark, corpus, stored):
    pick = random.Random(9)
    asked = ask(spark, *(" ".join(f"w{int(400 * pick.random() ** 2)}" for _ in range(n)) for n in (1, 2, 3, 5, 8, 20, 60) * 3), "w0 w0 w1", "unknown", "", None, "w399 unknown")
    for k in (1, 7):
        got = sorted(map(tuple, ps.blockmax_topk(asked, stored, k).collect()))
        want = sorted(map(tuple, rc.bm25_topk(asked, corpus, k).collect()))
        assert got == want


def test_few_blocks_are_opened(spark, stored):
    asked = ask(spark, "w0 w1 w300", "w0 w350")
    row = ps.opened_blocks(asked, stored, 5).agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("opened").cast("int")).alias("opened")).first()
    assert 0 < row["opened"] < row["all"] / 2
    # Only the folders of asked words are read.
    plan = ps._in_folders(stored, ps._asked(ask(spark, "w1"), stored))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "folder" in plan.split("PartitionFilters")[1][:80]


def test_blocks_hold_every_posting_once(corpus, stored):
    blocks = stored.blocks.select("term", "top", F.explode(F.arrays_zip("ids", "parts")).alias("e"))
    assert blocks.where("e.parts > top").count() == 0
    entries = corpus.select(F.sum(F.size("terms"))).first()[0]
    assert blocks.count() == entries == blocks.select("term", "e.ids").distinct().count()
    sizes = stored.blocks.select(F.max(F.size("ids")), F.min(F.size("ids"))).first()
    assert sizes[0] <= ps.BLOCK_POSTINGS and sizes[1] > 0


def test_candidates_only(spark, corpus):
    asked = ask(spark, "w0 w5 w5", "w300")
    whole = {(r.query_id, r.chunk_id): r.score for r in bm25_score(asked, corpus).collect()}
    some = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (0, 4319)], "query_id int, chunk_id int")
    got = {(r.query_id, r.chunk_id): r.score for r in bm25_score(asked, corpus, some).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 3), (0, 4319)}
    assert all(abs(s - whole.get(p, 0.0)) < 1e-9 for p, s in got.items())


def test_empty_corpus(spark, corpus, tmp_path):
    empty = ps.store_postings(corpus.limit(0), str(tmp_path))
    assert ps.blockmax_topk(ask(spark, "w1"), empty).count() == 0


def test_jobs_do_not_grow_with_the_queries(spark, corpus, monkeypatch):
    monkeypatch.setattr(rc, "MAX_QUERIES", 4)
    small = embed(corpus.limit(200), text="content")
    context, counts = spark.sparkContext, []
    for n in (3, 40):
        asked = embed(ask(spark, *[f"w{i} w{i + 1}" for i in range(n)]).drop("query_vec"), text="query_text", out="query_vec")
        context.setJobGroup(f"grid-{n}", "")
        rows = rc.recall(asked, small, k=2).collect()
        counts.append(len(context.statusTracker().getJobIdsForGroup(f"grid-{n}")))
        assert len(rows) == n * 4
    context.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 1  # whether Spark broadcasts a side may differ


def test_few_rows_leave_the_packs(spark, stored):
    asked = ask(spark, *["w0 w1 w2 w3 w4"] * 8)
    packs = stored.blocks.select("pack").distinct().count()
    rows = ps._matches(asked, stored, 5).groupBy("query_id").count().collect()
    assert len(rows) == 8 and all(5 <= r["count"] <= 5 * packs for r in rows)
