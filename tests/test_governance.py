"""Edge cases of the governance operators; the registered queries compare them with SQL."""

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import governance as gov
from ledgerleaf.plans import governance_queries


def test_pass_at_k_leaves_short_problems_out(spark):
    rows = [("a", "p", True), ("a", "p", False), ("a", "p", False), ("a", "q", True), ("b", "r", False), ("b", "r", False)]
    got = {r.label: (r.problems, r.short, r.pass_at_k) for r in gov.pass_at_k(spark.createDataFrame(rows, "label string, problem string, correct boolean"), 2).collect()}
    assert got["a"][:2] == (1, 1) and got["a"][2] == pytest.approx(2 / 3)
    assert got["b"] == (1, 0, 0.0)


def test_weights_and_budget_without_previous_or_priority(spark):
    rates = spark.createDataFrame([("a", 1.0, 0.5), ("b", 0.0, 1.0)], "label string, p_current double, p_reference double")
    weights = {r.label: r for r in gov.difficulty_weights(rates, gamma=0.0).collect()}
    assert weights["a"].weight == 0.05 and weights["b"].raw == 2.0
    assert weights["a"].normalized + weights["b"].normalized == pytest.approx(2)
    none = spark.createDataFrame([("a", 0.0)], "label string, priority double")
    assert gov.allocate_budget(none, 10.0).first().share == 0.0


def test_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, None), (3, "A  b"), (4, "a b"), (5, "idiot!")], "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1)], "doc_id long, toxic int")
    assert {r.doc_id for r in gov.dedup(docs).collect()} == {1, 2, 3, 5}
    assert {r.doc_id for r in gov.detox_filter(docs, labels, ("idiot",)).collect()} == {1, 2, 3}
    bench = spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string")
    assert {r.doc_id for r in gov.decontaminate(docs, bench).collect()} == {1, 2, 5}


def test_lengths(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, None)], "id int, units array<string>")
    kept, dropped = gov.filter_overlong(df, F.size("units"), 2)
    assert {r.id for r in kept.collect()} == {2, 3} and dropped.first().dropped == 1
    assert [r.t for r in df.select(gov.truncate_left(F.col("units"), 2).alias("t")).collect()][0] == ["b", "c"]


def test_rollback_asks_for_new_data_after_three_drops(spark):
    rows = [("a", i, m, i * 10) for i, m in enumerate([5.0, 4.0, 3.0, 2.0, 3.0])]
    got = gov.rollback(spark.createDataFrame(rows, "label string, round int, metric double, allocation int")).orderBy("round").collect()
    assert [r.regenerate for r in got] == [False, False, False, True, False]
    assert [r.effective for r in got] == [0, 0, 10, 20, 40]


def test_terms_that_labels_mark_reach_unlabelled_documents(spark):
    rows = [(i, f"text {i % 7} {'SCUM!' if i % 4 == 0 else 'good'} everywhere") for i in range(200)] + [(900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.where("doc_id < 100").selectExpr("doc_id", "CAST(doc_id % 4 = 0 AS INT) AS toxic")
    terms = gov.toxic_terms(docs, labels)
    assert [tuple(r) for r in terms.collect()] == [("scum", 25, 0)]
    left = {r.doc_id for r in gov.detox_unlabelled(gov.detox_filter(docs, labels, ("idiot",)), labels, terms).collect()}
    assert left == {i for i in range(200) if i % 4} | {900}


def test_recall_of_terms_on_labels_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    fitted, held_out = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    asked = docs.join(held_out, "doc_id")
    left = gov.detox_unlabelled(asked, fitted, gov.toxic_terms(docs, fitted))
    share = {r.toxic: r["count"] for r in left.groupBy("toxic").count().collect()}
    total = {r.toxic: r["count"] for r in asked.groupBy("toxic").count().collect()}
    print("left", share, "of", total)
    assert 1 - share[1] / total[1] >= 0.65 and 1 - share[0] / total[0] <= 0.01


def test_near_copies_go(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long), (2, long + " more"), (3, long.upper()), (4, "another text of its own that nobody has"), (5, None), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    of = lambda query: {r.doc_id for r in query(spark, str(tmp_path)).collect()}
    assert of(governance_queries.deduped_documents) == {1, 2, 4, 5, 6}
    assert of(governance_queries.near_deduped_documents) == {1, 4, 5, 6}


def test_overlaps_through_the_bitmap_against_sets(spark, monkeypatch):
    pick = __import__("random").Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(pick.choice(words) for _ in range(pick.randrange(0, 40))) for _ in range(150)] + [None, "", "w1", "W1  w2"]
    bench = [" ".join(pick.choice(words[:8]) for _ in range(30)) for _ in range(20)] + [texts[4], texts[9], "w1", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    held = spark.createDataFrame(list(enumerate(bench)), "item_id int, text string")

    def windows(text, n):
        w = text.lower().split() or [""]
        return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))}

    for n, most in ((3, 22), (8, 22), (2, 6)):  # the last with a bitmap that lets nearly all through
        monkeypatch.setattr(gov, "MOST_POWER", most)
        monkeypatch.setattr(gov, "LEAST_POWER", min(most, 12))
        known = set().union(*(windows(t, n) for t in bench if t is not None))
        got = {r.doc_id: r.overlap for r in gov.benchmark_overlap(docs, held, n).collect()}
        assert got == {i: 0 if t is None else len(windows(t, n) & known) for i, t in enumerate(texts)}
    assert gov.benchmark_overlap(docs, held.limit(0)).where("overlap > 0").count() == 0


def test_consistency_of_one_hot_query(spark, monkeypatch):
    pick = __import__("random").Random(5)
    rows = [("hot", m, " ".join(pick.choice("abcdefgh") for _ in range(pick.randrange(1, 6)))) for m in range(300)]
    rows += [("one", 0, "x"), ("two", 0, "A  b"), ("two", 1, "a b"), (None, 0, "p q"), (None, 1, "p"), ("gap", 0, None), ("gap", 1, "z"), ("gap", 2, "z y")]
    monkeypatch.setattr(gov, "TILE", 7)
    got = {r.query: r for r in gov.ensemble_consistency(spark.createDataFrame(rows, "query string, model int, answer string")).collect()}

    def mean(texts):
        sets = [set(t.lower().split()) for t in texts if t is not None]
        pairs = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
        return sum(pairs) / len(pairs) if pairs else None

    for q in {r[0] for r in rows}:
        texts = [t for k, _, t in rows if k == q]
        assert got[q].models == len(texts) and got[q].similarity == (None if mean(texts) is None else pytest.approx(mean(texts)))
    assert got["two"].vote == 1.0 and got["gap"].vote == pytest.approx(1 / 3)


def test_all_marking_terms_count(spark):
    words = " ".join("t" + "".join(chr(97 + int(d)) for d in f"{i:04d}") for i in range(1200))
    docs = spark.createDataFrame([(i, words) for i in range(10)] + [(10, words.split()[-1]), (11, "fine"), (12, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, toxic int")
    terms = gov.toxic_terms(docs, labels)
    assert terms.count() == 1200
    assert {r.doc_id for r in gov.detox_unlabelled(docs.where("doc_id >= 10"), labels, terms).collect()} == {11, 12}


def _same_as_sql(spark, folder, name, **tables):
    import duckdb

    from ledgerleaf.plans import governance_queries as gq

    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    query = gq.QUERIES[name](spark, str(folder))
    found = sorted(map(tuple, query.collect()))
    assert found == sorted(con.execute(f"SELECT {', '.join(query.columns)} FROM ({gq.ORACLE[name]})").fetchall())
    return found


def test_detoxed_documents_leave_out_listed_words(spark, tmp_path):
    docs = spark.createDataFrame([(1, "You MORON!"), (2, "fine"), (3, None), (4, "stupid, but judged"), (5, "toxic")], "doc_id long, text string")
    labels = spark.createDataFrame([(4, 0), (5, 1)], "doc_id long, toxic int")
    assert _same_as_sql(spark, tmp_path, "detoxed_documents", documents=docs, labels=labels) == [(2,), (3,)]


def test_rounds_end_at_the_second_they_end(spark, tmp_path):
    end = 1704240000  # a multiple of five days; the half second before it is still the round before
    rows = [("click", end - 0.1, 3.0), ("click", end - 0.8, 5.0), ("click", end + 0.0, 2.0), ("click", end + 0.5, 4.0)]
    events = spark.createDataFrame(rows, "event_type string, at double, value double").selectExpr(
        "event_type", "CAST(timestamp_micros(CAST(at * 1000000 AS BIGINT)) AS TIMESTAMP_NTZ) AS ts", "value"
    )
    found = _same_as_sql(spark, tmp_path, "rolled_back", events=events)
    assert [(r[2], r[3], r[4]) for r in found] == [(4.0, 2, False), (3.0, 2, True)]
