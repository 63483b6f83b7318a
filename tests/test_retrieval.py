import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions.vectors import check_dimension, embed, keyword_embedder
from ledgerleaf.operators import recall as rc
from ledgerleaf.operators.bm25 import bm25_score, index_terms
from ledgerleaf.operators.fusion import (
    EMPTY_CONTEXT, hybrid_search, hybrid_search_full, personal_corpus, rag_context, union_recall,
)
from ledgerleaf.plans.corpus import build_corpus

DOC = "doc_id string, title string, doc_type string, agency string, domain string, effective_date string, version string, text string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, i, "internal", "", d, e, "1", t) for i, d, e, t in rows], DOC)


def ask(spark, text, embedder=None, **more):
    q = spark.createDataFrame([(1, text)], "query_id int, query_text string")
    for name, value in more.items():
        q = q.withColumn(name, F.lit(value))
    return embed(q, embedder, text="query_text", out="query_vec")


def ids(df):
    return [r.doc_id for r in sorted(df.collect(), key=lambda r: r["rank"])]


def marker(texts):
    return [[1.0] + [0.0] * 7 if "MARKER_XYZ" in t else [0.0] * 7 + [1.0] for t in texts]


def test_ranking(spark):
    corpus = build_corpus(docs(
        spark, ("d1", "Banking", "", "存款保险限额 50 万，同一存款人合并计算。"), ("d2", "Securities", "", "股票交易印花税为成交金额的 0.05%。")
    ))
    hits = hybrid_search(ask(spark, "存款保险保多少"), corpus, top_k=2)
    assert ids(hits)[0] == "d1"


def test_filters(spark):
    corpus = build_corpus(docs(
        spark, ("b", "Banking, Trust", "2010-01-01", "贷款"), ("s", "Securities", "2020-01-01", "股票"), ("u", "Bank", "", "无日期")
    ))
    assert ids(hybrid_search(ask(spark, "贷款", domain="Banking"), corpus)) == ["b"]
    assert ids(hybrid_search(ask(spark, "贷款", effective_after="2015-01-01"), corpus)) == ["s"]
    assert set(ids(hybrid_search_full(ask(spark, "贷款", effective_after="2015-01-01"), corpus))) == {"s", "u"}
    assert hybrid_search(ask(spark, "贷款", domain="None"), corpus).count() == 0


def test_words_rescue_what_vectors_miss(spark):
    filler = [(f"f{i}", "", "", f"普通 内容 第{i}段") for i in range(300)]
    special = ("m", "", "", "# 特殊条款\nMARKER_XYZ 创业板开通条件要求资产日均十万且交易满二十四个月。 创业板开通条件")
    corpus = build_corpus(docs(spark, *filler, special), marker)
    assert "m" in ids(hybrid_search(ask(spark, "创业板开通条件", marker), corpus, top_k=3, vec_weight=0.1))


def test_citation_is_printed(spark):
    row = ("reg", "商业银行理财业务管理办法", "regulation", "国家金融监督管理总局", "Banking", "2024-01-01", "2", "# 第一章\n理财产品")
    corpus = build_corpus(spark.createDataFrame([row], DOC))
    asked = ask(spark, "理财")
    text = rag_context(asked, hybrid_search(asked, corpus, top_k=3)).first().context
    for part in ("[1] 来源《商业银行理财业务管理办法》", "机构：国家金融监督管理总局", "领域：Banking", "生效：2024-01-01", "版本：2", "章节：# 第一章"):
        assert part in text
    nothing = rag_context(asked, hybrid_search(asked, corpus.limit(0), top_k=3)).first().context
    assert nothing == EMPTY_CONTEXT


def test_union_keeps_both_scores(spark):
    vec = spark.createDataFrame([(1, 1, 0.9), (1, 3, 0.5)], "query_id int, chunk_id int, vec_score double")
    bm = spark.createDataFrame([(1, 2, 0.8), (1, 3, 0.4)], "query_id int, chunk_id int, bm25_score double")
    assert sorted(map(tuple, union_recall(vec, bm).collect())) == [(1, 1, 0.9, None), (1, 2, None, 0.8), (1, 3, 0.5, 0.4)]


def test_dimension_is_checked(spark):
    mixed = spark.createDataFrame([([0.1] * 8,), ([0.0] * 4,)], "embedding array<double>")
    with pytest.raises(ValueError):
        check_dimension(mixed)
    with pytest.raises(Exception, match="dimension"):
        check_dimension(mixed, 8).collect()


def test_scoped_search_isolates_users(spark):
    words = keyword_embedder(["养老", "创业板", "保险", "银行"])
    public = build_corpus(docs(spark, ("reg-001", "", "", "养老金融监管要求")), words)
    d = spark.createDataFrame(
        [("p1", 1, "plan.md", "done", "2024"), ("p2", 2, "memo.md", "done", "2024"), ("p3", 1, "bad.md", "error", "2024")],
        "id string, user_id int, filename string, status string, uploaded_at string",
    )
    c = spark.createDataFrame(
        [("p1:c0", "p1", 1, "我的养老规划", ""), ("p2:c0", "p2", 2, "养老 备忘", ""), ("p3:c0", "p3", 1, "养老 坏", "")],
        "id string, doc_id string, user_id int, text string, chapter string",
    )
    e = embed(c, words).select(F.col("id").alias("chunk_id"), "embedding")
    personal = personal_corpus(d, c, e)
    search = lambda **kw: set(ids(hybrid_search(ask(spark, "养老", words, **kw), public, personal)))
    assert search(user_id=1) == {"reg-001", "p1"}
    assert search(user_id=2) == {"reg-001", "p2"}
    assert search() == {"reg-001"}
    assert set(ids(hybrid_search(ask(spark, "养老", words, user_id=1), public))) == {"reg-001"}
    kinds = {r.doc_type for r in hybrid_search(ask(spark, "养老", words, user_id=1), public, personal).collect()}
    assert kinds == {"internal", "personal"}


def random_corpus(spark, n, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string")


def brute_bm25(texts, query):
    toks = [t.split() for t in texts]
    avg = sum(map(len, toks)) / len(toks)
    out = []
    for t in toks:
        c, s = Counter(t), 0.0
        for w in query.split():
            df = sum(w in x for x in toks)
            if df:
                s += math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(t) / avg))
        out.append(s)
    return out


def test_bm25_matches_brute_force(spark):
    texts, corpus = random_corpus(spark, 60, 1)
    query = "alpha beta beta omega"
    q = spark.createDataFrame([(7, query)], "query_id int, query_text string").withColumn("query_vec", F.array(F.lit(1.0)))
    want = brute_bm25(texts, query)
    got = {r.chunk_id: r.score for r in bm25_score(q, corpus).collect()}
    assert all(abs(got.get(i, 0.0) - s) < 1e-9 for i, s in enumerate(want))
    top = [(r.chunk_id, r.score) for r in sorted(rc.bm25_topk(q, index_terms(corpus), k=10).collect(), key=lambda r: r["rank"])]
    best = sorted(range(60), key=lambda i: (-round(want[i], 10), i))[:10]
    assert top == [(i, round(want[i], 4)) for i in best]


def test_zero_scores_fill_the_list(spark):
    _texts, corpus = random_corpus(spark, 5, 2)
    q = spark.createDataFrame([(1, "unknown")], "query_id int, query_text string").withColumn("query_vec", F.array(F.lit(1.0)))
    rows = rc.bm25_topk(q, corpus, k=3).collect()
    assert sorted((r["rank"], r.chunk_id, r.score) for r in rows) == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]


def test_zero_vectors_score_zero(spark):
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "chunk_id int, embedding array<double>")
    q = spark.createDataFrame([(1, "", [1.0, 1.0])], "query_id int, query_text string, query_vec array<double>")
    assert {r.chunk_id: r.score for r in rc.vector_topk(q, corpus).collect()} == {1: 0.0, 2: 0.7071}


def test_blocks_give_the_same_as_one_batch(spark, monkeypatch):
    _texts, corpus = random_corpus(spark, 40, 3)
    corpus = embed(index_terms(corpus), text="content")
    words = "alpha beta gamma delta eps zeta eta".split()
    q = spark.createDataFrame([(i, f"{words[i % 7]} {words[i // 7]}") for i in range(20)], "query_id int, query_text string")
    q = embed(q, text="query_text", out="query_vec")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(rc.recall(q, corpus, k=4))
    monkeypatch.setattr(rc, "MAX_QUERIES", 3)
    assert key(rc.recall(q, corpus, k=4)) == whole
    one = key(rc.recall(q.filter("query_id = 5"), corpus, k=4))
    assert one == [r for r in whole if r[0] == 5]


def test_words_are_those_of_tokenize_in_every_alphabet(spark):
    from ledgerleaf.functions.text import tokenize

    characters = spark.range(1, 0x30000).where("id NOT BETWEEN 55296 AND 57343").selectExpr(
        "CAST(id AS STRING) AS chunk_id", "concat('a', decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32'), 'B a ', decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')) AS content"
    )
    indexed = index_terms(characters).withColumn("words", tokenize(F.col("content")))
    wrong = "dl <> size(words) OR terms <> array_sort(array_distinct(words)) OR tfs <> transform(terms, t -> size(filter(words, w -> w = t)))"
    assert indexed.where(wrong).count() == 0
    empty = index_terms(spark.createDataFrame([("1", None), ("2", ""), ("3", "?!")], "chunk_id string, content string")).collect()
    assert [(r.dl, r.terms, r.tfs) for r in empty] == [(0, [], [])] * 3


def test_a_batch_of_texts_is_embedded_in_slices(spark):
    def longest(texts):
        return [[float(len(texts))] for _ in texts]

    made = embed(spark.range(1000).coalesce(1).selectExpr("CAST(id AS STRING) AS text"), longest, batch=300).collect()
    assert sorted({r.embedding[0] for r in made}) == [100.0, 300.0]
    assert [tuple(r.embedding) for r in embed(spark.createDataFrame([("ab",), (None,), ("",)], "text string")).collect()][1:] == [(0.0,) * 32] * 2
