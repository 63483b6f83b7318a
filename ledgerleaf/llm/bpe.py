"""Byte-level BPE over a table of distinct words.

Texts are split into words in Spark tasks and written as blocks: the distinct
words of the block, and the documents as positions in that list. Each distinct
word of the corpus is encoded once; the ids return to the blocks by a join on
the word and to the documents by position. Where texts are decoded, a dictionary
of the vocabulary gives the pieces of each word; ``decode`` joins ids with it.

A block is bounded in bytes (one longer text makes a block of its own), so
memory does not depend on the corpus or on how often a word or text occurs.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import json
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from tokenizers import Tokenizer

from ledgerleaf.session import scratch_path

BLOCK_BYTES = 44 << 20
PART_BYTES = 1 << 19
#: How hard blocks are compressed; they are written once and read twice.
LEVEL = 12

#: First character of a listed word: of a special token, of any other word.
SPECIAL, ORDINARY = "s", "o"

# Character classes of the splitter.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@functools.lru_cache(maxsize=4)
def character_classes(tokenizer_json: str) -> np.ndarray:
    """Class of every code point, as the tokenizer's own splitter sees it, so Unicode versions agree.

    Python's categories group the code points; the splitter keeps each group in
    one word except where it differs, and what it sets apart is asked singly.
    """
    split = Tokenizer.from_str(tokenizer_json).pre_tokenizer.pre_tokenize_str
    classes = np.full(0x110000, OTHER, np.uint8)
    classes[0x20] = SPACE
    groups: dict[int, list[int]] = {LETTER: [], NUMBER: [], OTHER: []}
    for c in range(0x110000):
        if c != 0x20 and not 0xD800 <= c < 0xE000:
            groups[{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)].append(c)
    for points in groups.values():
        for _, (start, end) in split("".join(map(chr, points))):
            asked = chr(points[start])
            joins = [kind for before, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)) if len(split(before + asked)) == 1]
            classes[points[start:end]] = joins[0] if joins else SPACE
    return classes


def word_starts(codes: np.ndarray, firsts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Mask of the word starts in ``codes``, texts that begin at ``firsts`` laid end to end.

    The splitter's rules: 's 't 're 've 'm 'll 'd; letters, digits or signs with
    one space in front; white space but its last character; white space.
    """
    n = len(codes)
    kind = classes[codes]
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    run = np.ones(n, bool)
    run[1:] = kind[1:] != kind[:-1]
    run |= first[:n]
    blank = codes == 0x20
    space = kind == SPACE
    # A run of white space that a word of the same text follows gives up its last character.
    gives = np.zeros(n, bool)
    gives[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    starts = run | gives
    # A single space given up goes to the word behind it.
    led = np.zeros(n, bool)
    led[1:] = (gives & blank)[:-1]
    starts &= ~led
    # Contractions: an apostrophe at the start of a word, alone in its run.
    at = np.flatnonzero((codes == 0x27) & run & ~led)
    if len(at):
        padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
        limit = np.flatnonzero(first)[np.searchsorted(np.flatnonzero(first), at, side="right")]
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (at + 1 < limit)
        pair = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b)) & (at + 2 < limit)
        for hit, length in ((short, 2), (pair, 3)):
            begin = at[hit]
            starts[begin + 1] = False
            end = begin + length
            inner = end[end < n]
            # Inside a text the rest of the letters begins anew; otherwise the run's own start stands.
            starts[inner] |= ~space[inner] & (kind[inner] == LETTER)
    return starts


def word_digests(codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit digests of the words ``codes[begins : begins + lengths]``."""
    place = np.arange(len(codes)) - np.repeat(begins, lengths)
    factor = np.cumprod(np.full(int(lengths.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    sums = np.add.reduceat(mixed * factor[place], begins)
    sums ^= sums >> np.uint64(32)
    return (sums + lengths.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)


def _pieces_of(texts: list[str], special: list[str]) -> tuple[list[str], list[int]]:
    """Texts cut at special tokens: the pieces, and the number of pieces of each text.

    Odd pieces of a text are the special tokens themselves.
    """
    if not special or not any(s in t for s in special for t in texts):
        return texts, [1] * len(texts)
    cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
    parts = [cut.split(t) for t in texts]
    return [p for part in parts for p in part], [len(p) for p in parts]


def release_memory() -> None:
    """Hands back what a worker no longer uses; it serves other tasks afterwards."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


class _Block:
    """Distinct words of a block and its documents as positions among them."""

    def __init__(self, classes: np.ndarray, special: list[str]):
        self.classes, self.special = classes, special
        self.known = np.empty(0, np.uint64)  # digests, sorted
        self.number = np.empty(0, np.int32)  # their positions
        self.words: list[str] = []
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, texts: list[str]) -> None:
        pieces, per_text = _pieces_of(texts, self.special)
        marked = np.zeros(len(pieces), bool)
        at = 0
        for k in per_text:
            marked[at + 1:at + k:2] = True
            at += k
        joined = "".join(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if not joined:
            self.counts.append(np.zeros(len(texts), np.int64))
            self.codes.append(np.empty(0, np.int32))
            return
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        firsts = (ends - sizes)[sizes > 0]
        starts = word_starts(points, firsts, self.classes)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        inside = marked[owner]
        starts[inside] = False
        starts[(ends - sizes)[marked]] = True
        begins = np.flatnonzero(starts)
        lengths = np.diff(np.append(begins, len(points)))
        digests = word_digests(points, begins, lengths)
        # A special token and an ordinary word of the same characters are different words.
        digests[marked[owner[begins]]] ^= np.uint64(0x5555555555555555)
        distinct, where, back = np.unique(digests, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.known, distinct)
        found = np.zeros(len(distinct), bool)
        if len(self.known):
            slot = np.minimum(slot, len(self.known) - 1)
            found = self.known[slot] == distinct
        numbers = np.empty(len(distinct), np.int32)
        numbers[found] = self.number[slot[found]] if len(self.known) else 0
        new = np.flatnonzero(~found)
        numbers[new] = np.arange(len(self.words), len(self.words) + len(new), dtype=np.int32)
        for k in where[new]:
            b = begins[k]
            self.words.append((SPECIAL if marked[owner[b]] else ORDINARY) + joined[b:b + lengths[k]])
        if len(new):
            self.known = np.concatenate([self.known, distinct[new]])
            self.number = np.concatenate([self.number, numbers[new]])
            order = np.argsort(self.known, kind="stable")
            self.known, self.number = self.known[order], self.number[order]
        self.codes.append(numbers[back.reshape(-1)])
        text_of = np.repeat(np.arange(len(texts)), per_text)
        self.counts.append(np.bincount(text_of[owner[begins]], minlength=len(texts)))

    def record(self, number: int, docs: pa.StructArray) -> pa.RecordBatch:
        # Frequent words get small numbers, which compress well, as does each byte of them by itself;
        # equally frequent ones stand in the order of their letters.
        seen = np.zeros(len(self.words), np.int64)
        for codes in self.codes:
            seen += np.bincount(codes, minlength=len(self.words))
        listed = np.array(sorted(range(len(self.words)), key=self.words.__getitem__), np.int64)
        order = listed[np.argsort(-seen[listed], kind="stable")]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        counts = np.concatenate(self.counts).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([[self.words[i] for i in order]], pa.list_(pa.string())),
                # Part by part, so that no array of all positions is copied.
                pa.array([[zstandard.compress(rank[codes].view(np.uint8).reshape(-1, 4).T.tobytes(), LEVEL) for codes in self.codes]], pa.list_(pa.binary())),
                pa.array([counts], pa.list_(pa.int64())),
                pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
            ],
            ["block", "words", "places", "counts", "docs"],
        )


def _positions(places: pa.Array) -> np.ndarray:
    """The positions of a block's words from their compressed parts."""
    parts = [np.frombuffer(zstandard.decompress(x.as_py()), np.uint8).reshape(4, -1) for x in places]
    out = np.empty(sum(p.shape[1] for p in parts), np.int32)
    at = 0
    for i, part in enumerate(parts):
        out[at:at + part.shape[1]] = np.ascontiguousarray(part.T).view(np.int32).reshape(-1)
        at, parts[i] = at + part.shape[1], None
    return out


def _to_blocks(classes, special: list[str], block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        block, keys, size = _Block(table, special), [], 0
        # Numbers in a row compress well, as there is one for each word and block.
        number = TaskContext.get().partitionId() << 32

        def flush():
            return block.record(number, pa.concat_arrays(keys))

        for batch in batches:
            text, docs = batch.column("text").fill_null(""), batch.column("docs")
            weights = np.asarray(pc.binary_length(text)).astype(np.int64)
            at = 0
            while at < len(text):
                # A part: some texts, so that the arrays of code points stay small.
                upto = max(at + 1, at + int(np.searchsorted(np.cumsum(weights[at:]), PART_BYTES, side="right")))
                part = int(weights[at:upto].sum())
                if keys and size + part > block_bytes:
                    yield flush()
                    number += 1
                    block, keys, size = _Block(table, special), [], 0
                block.add(text.slice(at, upto - at).to_pylist())
                keys.append(docs.slice(at, upto - at))
                size += part
                at = upto
        if keys:
            yield flush()
        del block, keys
        release_memory()

    return run


def _encoder(tokenizer_json: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(word, block, at), equal words in a row -> (block, at, ids); each word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_str(tokenizer_json)
        kind = id_kind(tokenizer.get_vocab_size())
        last: tuple[str | None, bytes] = (None, b"")
        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            ids: dict[str, bytes] = {last[0]: last[1]} if last[0] is not None else {}
            for special in (False, True):
                # In an ordinary word, the characters of a special token are ordinary too.
                tokenizer.encode_special_tokens = not special
                fresh = [w for w in words if (w[0] == SPECIAL) == special and w not in ids]
                for word, encoding in zip(fresh, tokenizer.encode_batch_fast([w[1:] for w in fresh], add_special_tokens=False)):
                    ids[word] = np.array(encoding.ids, kind).tobytes()
            packed = pa.array([ids[w] for w in words], pa.binary()).take(coded.indices)
            if words:
                last = (words[-1], ids[words[-1]])
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("at"), packed], ["block", "at", "ids"])
        del tokenizer
        release_memory()

    return run


def vocabulary(spark: SparkSession, tokenizer_json: str) -> DataFrame:
    """(id, piece): the bytes behind every id, special tokens included."""
    return spark.createDataFrame(list(enumerate_pieces(tokenizer_json).items()), "id int, piece binary")


def enumerate_pieces(tokenizer_json: str) -> dict[int, bytes]:
    spec = json.loads(tokenizer_json)
    # The byte alphabet: printable bytes stand for themselves, the others follow from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    of_char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    pieces = {i: bytes(of_char[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    return pieces | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def id_kind(size: int) -> type:
    """The smallest type that holds all ids of a vocabulary."""
    return np.uint16 if size <= 1 << 16 else np.uint32


def _texts_from_words(pieces, emit: Callable) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block and the ids of its words -> its documents, by position."""

    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        if not block.num_rows:
            return emit(None, [], np.empty(0, np.uint32), np.zeros(1, np.int64), {})
        release_memory()  # of the block before
        piece = pieces.value
        kind = id_kind(max(piece) + 1)
        # All ids in one array, and where each word's begin; as single arrays they would take ten times the memory.
        packed = words.column("ids").combine_chunks().take(pa.array(np.argsort(np.asarray(words.column("at")))))
        offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]
        ids = np.frombuffer(packed.buffers()[2] or b"", kind)
        bounds = offsets.astype(np.int64) // np.dtype(kind).itemsize
        places = _positions(block.column("places").chunk(0).flatten())
        counts = np.asarray(block.column("counts").chunk(0).values)
        ends = np.cumsum(counts)
        docs = block.column("docs").chunk(0).flatten()
        return emit(docs, [places[e - n:e] for e, n in zip(ends.tolist(), counts.tolist())], ids, bounds, piece)

    return run


def _digests(docs, places, ids, bounds, piece) -> pa.Table:
    sizes, words = np.diff(bounds), list(pairwise(bounds.tolist()))
    tokens = [int(sizes[p].sum()) for p in places]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    # One list of words at a time: first as decimal ids, then as bytes.
    shown = [b"".join([b"%d," % i for i in ids[a:b].tolist()]) for a, b in words]
    coded = [sha(b"".join([shown[i] for i in p.tolist()])[:-1]) for p in places]
    shown = [b"".join([piece[i] for i in ids[a:b].tolist()]) for a, b in words]
    texts = [sha(b"".join([shown[i] for i in p.tolist()]).decode("utf-8", "replace").encode()) for p in places]
    columns = dict(zip((f.name for f in docs.type), docs.flatten())) if docs is not None else {}
    return pa.table(columns | {"n_tokens": pa.array(tokens, pa.int64()), "ids_sha256": pa.array(coded, pa.string()), "decoded_sha256": pa.array(texts, pa.string())})


def _id_lists(docs, places, ids, bounds, _piece) -> pa.Table:
    sizes = np.diff(bounds)

    def gathered(p: np.ndarray) -> np.ndarray:
        own = sizes[p]
        step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        return ids[np.repeat(bounds[:-1][p], own) + step].astype(np.int32)

    flat = [gathered(p) for p in places]
    columns = dict(zip((f.name for f in docs.type), docs.flatten())) if docs is not None else {}
    sizes = [len(x) for x in flat]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
    return pa.table(columns | {"n_tokens": pa.array(sizes, pa.int64()), "ids": pa.ListArray.from_arrays(offsets, values)})


def _encoded(docs: DataFrame, tokenizer_json: str, keep: Sequence[str], block_bytes: int, emit: Callable, fields: str) -> DataFrame:
    spark = docs.sparkSession
    special = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]
    classes = spark.sparkContext.broadcast(character_classes(tokenizer_json))
    pieces = spark.sparkContext.broadcast(enumerate_pieces(tokenizer_json))
    keep = [c for c in keep if c.lower() not in T.StructType.fromDDL(fields).fieldNames()]
    kept = docs.select(*(f"`{c}`" for c in keep)).schema
    slim = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in keep)).alias("docs"))
    blocks = slim.mapInArrow(
        _to_blocks(classes, special, block_bytes),
        T.StructType.fromDDL("block long, words array<string>, places array<binary>, counts array<long>").add("docs", T.ArrayType(kept)),
    )
    # Written in buckets, so that the blocks wait where the ids of their words arrive.
    name, path = f"bpe_blocks_{uuid.uuid4().hex}", scratch_path(spark, "bpe-blocks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(parts, "block").option("compression", "zstd").option("parquet.compression.codec.zstd.level", LEVEL).option("path", path).saveAsTable(name)
    blocks = spark.table(name)
    words = blocks.select(F.posexplode("words").alias("at", "word"), "block")
    ids = words.repartition("word").sortWithinPartitions("word").mapInArrow(_encoder(tokenizer_json), "block long, at int, ids binary")
    out = T.StructType([*kept.fields, *T.StructType.fromDDL(fields).fields])
    return blocks.drop("words").groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_texts_from_words(pieces, emit), out)


def encode(docs: DataFrame, tokenizer_path: str, keep: Sequence[str] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents -> the columns ``keep``, n_tokens, ids; one row per row.

    A null text counts as empty and has no ids; null and repeated ids and any
    other kept columns are handed through; an empty table gives an empty result.
    The tokenizer is read on the driver and travels with the tasks.
    """
    return _encoded(docs, Path(tokenizer_path).read_text(), keep, block_bytes, _id_lists, "n_tokens long, ids array<int>")


def digest(docs: DataFrame, tokenizer_path: str, keep: Sequence[str] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As ``encode``, with the ids and the decoded text as SHA-256 instead of whole."""
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, Path(tokenizer_path).read_text(), keep, block_bytes, _digests, fields)


def decode(encoded: DataFrame, tokenizer_path: str, key: str) -> DataFrame:
    """(key, ids) -> (key, text), by a join of all ids with the vocabulary; ``key`` is unique."""
    spark = encoded.sparkSession
    table = vocabulary(spark, Path(tokenizer_path).read_text())
    pieces = (
        encoded.select(key, F.posexplode("ids").alias("at", "id"))
        # The vocabulary has as many rows as the tokenizer has ids.
        .join(F.broadcast(table), "id")
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    )
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["piece"])), "")), "UTF-8")
    return encoded.select(key).join(pieces.select(key, text.alias("text")), key, "left").withColumn("text", F.coalesce("text", F.lit("")))
