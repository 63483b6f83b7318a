"""Keyword search by the index of trigrams against the scan."""

import random

import pytest

from ledgerleaf.operators import trigrams as tg
from ledgerleaf.operators.history import keyword_search

SCHEMA = "conv_id long, user_id string, conv_scene string, idx int, role string, content string, created_at long"


@pytest.fixture(scope="module")
def messages(spark):
    pick = random.Random(1)
    parts = ["a", "b", "ab", "ABA", "é", "中文", "👍", " ", "\n", "x", "İ"]
    rows = [(i // 5, f"u{i % 3}", "qa", i % 5, "user", "".join(pick.choice(parts) for _ in range(pick.randrange(30))), 1_700_000_000_000 + i) for i in range(3000)]
    rows += [(900, "u1", "qa", 0, "user", None, 0), (901, "u1", "qa", 0, "user", "", 0), (902, "u1", "qa", 0, "user", "rare needle here " + "word " * 50_000, 5)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def index(messages, tmp_path_factory):
    return tg.store_trigrams(messages, str(tmp_path_factory.mktemp("grams")))


@pytest.mark.parametrize("query", ["aba", "abab", "中文👍", "b\na", "x x", "needle", "NEEDLE h", "ab", "", "nowhere", "é中文", "aba中文aba"])
def test_same_hits_as_the_scan(messages, index, query):
    for filters in ({}, {"start": 1_700_000_000, "limit": 500}, {"scene": "other"}):
        got = list(map(tuple, tg.indexed_search(index, "u1", query, **filters).collect()))
        assert got == list(map(tuple, keyword_search(messages, "u1", query, **filters).collect()))


def test_rare_words_read_few_messages(index):
    found = tg.candidates(index, "needle")
    assert found.count() == 1
    assert "_no" in found._jdf.queryExecution().toString().split("PushedFilters")[1][:80]


def test_lists_hold_every_trigram_once(messages, index):
    held = index.blocks.selectExpr("gram", "explode(nos) AS no")
    assert held.count() == held.distinct().count() == messages.select(tg.grams_of(messages["content"]).alias("g")).selectExpr("sum(size(g))").first()[0]


def test_empty_table(messages, tmp_path):
    assert tg.indexed_search(tg.store_trigrams(messages.limit(0), str(tmp_path)), "u1", "aba").count() == 0
