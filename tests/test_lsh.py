"""Search by random projections against the exact scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import lsh
from ledgerleaf.operators.recall import vector_topk
from ledgerleaf.plans import search_queries


def pairs(df):
    return {(r.query_id, r.chunk_id): r.score for r in df.collect()}


def recall_of(found, exact):
    return len(set(found) & set(exact)) / len(exact)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    at = f"/root/testdata/{sf}"
    found, exact = pairs(search_queries.vector_top_lsh(spark, at)), pairs(search_queries.vector_top(spark, at))
    assert recall_of(found, exact) >= 0.9
    assert all(exact[p] == s for p, s in found.items() if p in exact)


def test_fewer_chunks_are_scored_and_large_buckets_are_cut(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 32))
    rows = [(i, (middles[i % 40] + 0.2 * rng.normal(size=32)).tolist()) for i in range(3000)]
    rows += [(i, rows[0][1]) for i in range(3000, 4000)] + [(5000, None), (5001, [0.0] * 32)]
    chunks = spark.createDataFrame(rows, "chunk_id int, embedding array<double>")
    asked = spark.createDataFrame([(i, "", rows[i * 7][1]) for i in range(50)] + [(99, "", None)], "query_id int, query_text string, query_vec array<double>")
    exact = pairs(vector_topk(asked.where("query_vec IS NOT NULL"), chunks.where("embedding IS NOT NULL"), k=10))
    whole = pairs(lsh.vector_topk_lsh(asked, chunks, k=10))
    assert recall_of(whole, exact) >= 0.9
    assert pairs(lsh.vector_topk_lsh(asked, chunks, k=10, part_rows=50)) == whole
    # Wrong signs aside, a query meets a fraction of the chunks.
    met = pairs(lsh.vector_topk_lsh(asked, chunks, k=10_000, tables=2))
    assert len(met) < 0.6 * 50 * 4000
    assert lsh.vector_topk_lsh(asked.limit(0), chunks).count() == 0 == lsh.vector_topk_lsh(asked, chunks.limit(0)).count()


def test_probes_differ_in_one_sign(spark):
    df = spark.createDataFrame([([0.3, -1.0, 2.0],)], "v array<double>")
    planes = lsh.directions(3, tables=2, bits=4)
    row = df.select(lsh.buckets(F.col("v"), planes).alias("own"), lsh.buckets(F.col("v"), planes, True).alias("all")).first()
    for t in (0, 1):
        own = [b.bucket for b in row.own if b.table == t]
        probes = [b.bucket for b in row["all"] if b.table == t]
        assert len(own) == 1 and probes[0] == own[0] and sorted(p ^ own[0] for p in probes[1:]) == [1, 2, 4, 8]
