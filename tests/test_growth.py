"""Steps whose cost must not grow faster than their input."""

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerleaf.operators import bm25, governance, neardup
from ledgerleaf.plans import ingest

FILES = "id string, user_id string, filename string, content binary, uploaded_at string"


def test_pairs_that_share_a_word_are_scored_where_the_chunk_is_read(spark, monkeypatch):
    from ledgerleaf.operators import recall as grid

    monkeypatch.setattr(grid, "MAX_QUERIES", 2)  # several blocks
    monkeypatch.setattr(grid, "PAIR_ROWS", 3)  # several batches of a pack
    texts = {1: "the cat", 2: "the dog the", 3: "", 4: None, 5: "ends", 6: "养老 the", 7: "the"}
    asked = {10: "the the cat", 11: "nothing here", 12: "dog 养老", 13: "the", 14: ""}
    corpus = spark.createDataFrame(list(texts.items()), "chunk_id long, content string")
    scores = bm25.bm25_score(spark.createDataFrame(list(asked.items()), "query_id long, query_text string"), corpus)
    assert "Aggregate" not in scores._jdf.queryExecution().toString()  # no pair is shuffled
    words = {i: (t or "").split() for i, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for q, text in asked.items():
        for c, held in words.items():
            for w in text.split():
                df, tf = sum(w in h for h in words.values()), held.count(w)
                if tf:
                    got = math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(held) / mean))
                    want[q, c] = want.get((q, c), 0) + got
    rows = scores.collect()
    assert len(rows) == len(want) and {(r.query_id, r.chunk_id): round(r.score, 9) for r in rows} == {k: round(v, 9) for k, v in want.items()}


def test_words_are_cut_as_the_pattern_does():
    letters = [chr(c) for c in range(0x860)]
    texts = ["a".join(letters[i:i + 7]) + c for i, c in enumerate(letters)] + ["", None, " ", "a b a", "a", "b"]
    given = pa.array([None] * (len(texts) - 2) + [["z", "y", "z"], []], pa.list_(pa.string()))
    got = bm25._count_words(pa.array(texts), given).to_pylist()
    for text, words, row in zip(texts, given.to_pylist(), got):
        counts = Counter(bm25.WORDS.findall(text or "") if words is None else words)
        assert row == {"dl": counts.total(), "terms": sorted(counts), "tfs": [counts[w] for w in sorted(counts)]}


def test_no_graph_is_extracted_unless_it_is_taken(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(ingest, "extract_graph", lambda *_a: taken.append(1) or ("nodes", "edges"))
    made = ingest.ingest_documents(spark.createDataFrame([("a", "u", "a.txt", bytearray(b"text"), "1")], FILES))
    assert made["documents"].first()["status"] == "done" and made["chunks"].count() == made["embeddings"].count() == 1
    assert not taken and list(made) == ["documents", "chunks", "embeddings", "nodes", "edges"]
    assert (made["nodes"], made["edges"], len(taken)) == ("nodes", "edges", 1)


def test_windows_and_bands_are_those_of_the_words(spark):
    texts = ["a b c d e f", "A  b\tc d e\n f ", "ａ b　c d e f", "x a b c d e", "a b", "a", " \n ", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    plan = rows.select("id", neardup.text_windows(F.col("text")).alias("set")).select("id", "set", neardup.band_keys(F.col("set")).alias("bands"))
    assert "array_min" not in plan._jdf.queryExecution().toString()  # hashed in arrays, not one by one
    got = {r.id: r for r in plan.collect()}
    assert set(got[0].set) == set(got[1].set) == set(got[2].set) and len(set(got[0].set)) == 2
    assert len(set(got[0].set) & set(got[3].set)) == 1 and [len(got[i].set) for i in (3, 4, 5, 6, 7)] == [2, 1, 1, 0, 0]
    assert got[0].bands == got[1].bands and len(set(got[0].bands)) == neardup.BANDS and not set(got[4].bands) & set(got[5].bands)


def test_normalised_texts_have_single_blanks(spark):
    texts = ["a b", "a  b", "a\tb", "\n a \x0b\f\r b \n", "a \tb", "ＡＢ　ｃ", " ", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.t for r in rows.select("id", governance.normalize_text(F.col("text")).alias("t")).collect()}
    assert [got[i] for i in range(9)] == ["a b"] * 5 + ["ab c", "", "", None]


def test_embedder_counts_letters():
    from ledgerleaf.functions.vectors import char_hash_embedder

    texts = ["abc", "", "养老 \U0001F600é"]
    want = [[sum(ord(c) * 31 % 7 == d for c in t) for d in range(7)] for t in texts]
    assert char_hash_embedder(7)(texts).tolist() == want
