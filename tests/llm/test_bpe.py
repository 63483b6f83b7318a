"""Encoding by a table of words against the tokenizers library itself."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerleaf.llm import bpe
from ledgerleaf.llm.queries import op9_word_table_bpe, tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(decoded)


def random_texts(n):
    pick = random.Random(7)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", " ", "　", "\u0085", "a", "é", "中", "文", "١", "²", "Ⅷ", "!", "#",
             "<|endoftext|>", "<|", "ſ", "‍", "👍", "\x00", "\r\n", "ab12", "don't", "'S", "x"]
    return ["".join(pick.choice(parts) for _ in range(pick.randrange(0, 30))) for _ in range(n)]


def test_splitter_agrees_with_the_library(library):
    classes = bpe.character_classes(library.to_str())
    for text in random_texts(3000):
        text = text.replace("<|endoftext|>", "")
        if not text:
            continue
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        mask = bpe.word_starts(points, np.array([0]), classes)
        assert np.flatnonzero(mask).tolist() == sorted({s for _, (s, e) in library.pre_tokenizer.pre_tokenize_str(text)}), repr(text)


def test_odd_rows(spark, library):
    texts = [None, "", " ", "\n\n", "word " * 60_000, *random_texts(400), *["same text"] * 50]
    rows = [(i % 300 if i % 7 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int").repartition(3)
    got = sorted(map(tuple, bpe.digest(docs, tokenizer_path(), keep=("doc_id", "words"), block_bytes=20_000).collect()), key=lambda r: r[1])
    assert got == [(d, w, *expected(library, t)) for d, t, w in rows]
    assert bpe.digest(docs.limit(0), tokenizer_path()).count() == 0


def test_kept_columns_with_names_of_results(spark):
    docs = spark.createDataFrame([(1, "a b", 9, "x")], "doc_id long, text string, n_tokens int, block string")
    assert bpe.encode(docs, tokenizer_path(), keep=("doc_id", "n_tokens", "block")).first().asDict() == {"doc_id": 1, "block": "x", "n_tokens": 2, "ids": [64, 275]}


def test_ids_and_decoding(spark, library):
    rows = list(enumerate(random_texts(200)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    encoded = bpe.encode(docs, tokenizer_path())
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}
    decoded = {r.doc_id: r.text for r in bpe.decode(encoded, tokenizer_path(), "doc_id").collect()}
    assert decoded == dict(rows)


def test_registered_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in op9_word_table_bpe(spark, sf).collect()}
    assert got == {d: expected(library, t) for d, t in texts.items()}
