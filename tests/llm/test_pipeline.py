"""The pipeline: every stage's decisions take effect and its columns hold; encoding round-trips."""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from ledgerleaf.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    def varied(i, n=150):
        pick = random.Random(i)
        return " ".join("".join(pick.choice("abcdefgh") for _ in range(pick.randrange(2, 9))) for _ in range(n)) + "."

    line = "all rights reserved by nobody"
    rows = [(i, f"{varied(i)}\n{line}", f"s{i % 12}") for i in range(120)]
    rows += [(500, varied(1) + " one more", "s1"), (501, varied(900).upper().replace(" ", "!! "), "s0"), (502, "short", "s2"), (503, None, "s2"), (504, varied(3), None)]
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    (_, rules), (_, lines), (_, near), (_, mix), (_, encode) = pipeline.STAGES
    good = rules(spark, docs, "")
    assert good.columns == COLUMNS and {r.doc_id for r in good.collect()} == {*range(120), 500, 504}
    clean = lines(spark, good, "").cache()
    assert clean.columns == COLUMNS
    assert sum("all rights" in r.text for r in clean.collect()) == 1 and all(r.n_chars == len(r.text) for r in clean.collect())
    one = near(spark, clean, "").cache()
    assert one.columns == COLUMNS and {r.doc_id for r in one.collect()} == set(range(120))
    mixed = mix(spark, one, "").cache()
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert mixed.columns == COLUMNS and max(counts.values()) <= 3 and set(counts) <= set(range(120)) and len(set(counts.values())) > 1
    encoded = encode(spark, mixed, "").collect()
    library = Tokenizer.from_file(tokenizer_path())
    texts = {r.doc_id: r.text for r in one.collect()}
    assert len(encoded) == mixed.count()
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in encoded)


def test_empty_table(spark, docs):
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0, name


def test_run_on_odd_rows(spark, tmp_path):
    pick = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    prose = lambda n: " ".join(pick.choice(words) for _ in range(n)) + "."
    good = [(i, "\n".join(prose(40) for _ in range(4)), "en", f"s{i % 12}", 0) for i in range(60)]
    rows = good + [
        (100, None, "en", "s1", None), (101, "", None, "s1", 0), (102, " \n\t", "en", None, 0), (None, "\n".join(prose(50) for _ in range(3)), "en", None, 0),
        (None, good[3][1], None, "s2", 0), good[5], good[5], (103, "\n".join(prose(60) for _ in range(1500)), "en", None, 0), (5, "\n".join(prose(45) for _ in range(3)), "en", "s3", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.selectExpr("*", "'x' AS mix_copies", "1 AS lines_removed", "'y' AS n_tokens", "2 AS node", "'z' AS kept", "3 AS k")
    extra.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert got and got[0].__fields__ == ["doc_id", "source", "n_tokens", "ids"]
    assert all(r.n_tokens == len(r.ids) > 0 for r in got) and not {100, 101, 102} & {r.doc_id for r in got}
    # Without the extra columns, and in another order of rows, the result is the same.
    docs.repartition(5, "source").write.parquet(str(tmp_path / "plain" / "documents.parquet"))
    again = pipeline.run(spark, str(tmp_path / "plain")).collect()
    key = lambda r: (r.doc_id or -1, r.source or "", r.ids)
    assert sorted(got, key=key) == sorted(again, key=key)
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
