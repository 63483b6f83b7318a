"""Alignment of two tokenizers against a plain walk over all bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerleaf.llm import bpe, crosstok
from ledgerleaf.llm.queries import op12_shared_cuts, tokenizer_path

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Text -> (A ids, B ids, groups, links), from the libraries themselves."""
    library = Tokenizer.from_file(tokenizer_path())
    library.encode_special_tokens = True
    pieces = bpe.enumerate_pieces(library.to_str())
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def b_bytes(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    def ranges(sizes):
        ends = np.cumsum(sizes).tolist()
        return list(zip([0, *ends], ends))

    def align(text):
        nothing = [], [], [], []
        if not text:
            return nothing
        a, b = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        whole = (" " + text).encode()
        if b"".join(pieces[i] for i in a) != whole or b"".join(b_bytes(i) for i in b) != whole:
            return nothing
        ra, rb = ranges([len(pieces[i]) for i in a]), ranges([len(b_bytes(i)) for i in b])
        common = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, left, right = [], list(zip(a, ra))[::-1], list(zip(b, rb))[::-1]
        for end in common:
            group = [], []
            for side, waiting in zip(group, (left, right)):
                while waiting and waiting[-1][1][1] <= end:
                    side.append(waiting.pop()[0])
            groups.append(group)
        links, low = [], 0
        for i, (s, e) in zip(a, ra):
            while rb[low][1] <= s:
                low += 1
            k = low
            while k < len(rb) and rb[k][0] < e:
                links.append((i, b[k]))
                k += 1
        return a, b, groups, links

    return align


def expected(plain, texts):
    aligned = [plain(t) for t in texts]
    counts = Counter(pair for *_, links in aligned for pair in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for a, b, groups, links in aligned:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(shown.encode()).hexdigest() if a else "",
        ))
    return out


def odd_texts(n):
    pick = random.Random(2)
    parts = ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁", " ", "  ", "\n", "\t", "a", "the", "tokens", "naïve", "中文", "👍🏽", "é", "12", "'re", "!?", "\x00", "﻿"]
    return ["".join(pick.choice(parts) for _ in range(pick.randrange(0, 25))) for _ in range(n)]


def test_cuts_and_overlaps_against_sets():
    rng = np.random.default_rng(4)
    for _ in range(300):
        size = int(rng.integers(1, 200))
        ends = [np.unique(np.append(rng.choice(size, int(rng.integers(0, size)), replace=False) + 1, size)) for _ in range(2)]
        a, b = crosstok.shared_cuts(*ends)
        common = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        assert ends[0][a].tolist() == common and ends[1][b].tolist() == common
        x, y = ends
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        want = [(i, j) for i in range(len(x)) for j in range(len(y)) if starts[0][i] < y[j] and starts[1][j] < x[i]]
        assert list(zip(*(k.tolist() for k in crosstok.overlaps(x, y)))) == want


def test_odd_rows(spark, plain):
    texts = [None, "", " ", "\n", "word " * 30_000, "x" * 50_000, *odd_texts(300), *["the same text of many"] * 40, "a▁b"]
    rows = [(i % 200 if i % 9 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumns({"n_a": F.lit("x"), "block": F.lit("y"), "pairs": F.lit(1)}).repartition(3)
    got = crosstok.align(docs, tokenizer_path(), MODEL, keep=("doc_id", "row", "block", "n_a"), block_bytes=5_000)
    assert got.columns == ["doc_id", "row", "block", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    made = sorted(map(tuple, got.collect()), key=lambda r: r[1])
    assert made == [(d, k, "y", *e) for (d, _, k), e in zip(rows, expected(plain, texts))]
    assert crosstok.align(docs.limit(0), tokenizer_path(), MODEL).count() == 0


def test_both_encoders_of_ranks_agree(plain):
    made = crosstok.ByteLevel(open(tokenizer_path()).read())
    texts = odd_texts(500)
    fast = made.encode(texts)
    made._fast = None
    assert [x.tolist() for x in fast] == [x.tolist() for x in made.encode(texts)]


def test_registered_query(spark, plain):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: e for (d, _), e in zip(rows, expected(plain, [t for _, t in rows]))}
    assert {r.doc_id: tuple(r)[1:] for r in op12_shared_cuts(spark, sf).collect()} == want
