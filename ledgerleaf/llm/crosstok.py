"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both tokenizers cover the same bytes, so their tokens are two rows of end
offsets. An interval of tokens is divided near its middle: the end of the middle
token of A is looked up among B's ends by bisection; if B has no such end, the
neighbouring tokens' ends are tried, nearest first. A common end divides the
interval, and both halves go on the same way; an interval without a common end
inside is a leaf: one group. All intervals of a part of the texts are divided
level by level at once, in arrays.

Counts of id pairs are corpus-wide. Tasks write blocks: the distinct pairs of a
block with the number of its documents that hold them, and each document's links
as positions in that list. Pairs are summed over the blocks, and each block gets
the counts of its own pairs back by a join; so what is shuffled is one row for
each block and distinct pair, never one for each link.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from ledgerleaf.llm.bpe import enumerate_pieces
from ledgerleaf.llm.common import stored

#: Bytes of text in a block (a longer text makes a block of its own), and of a part of it that is divided at once.
BLOCK_BYTES, PART_BYTES = 8 << 20, 1 << 19
#: Bytes up to which the fast encoder of A is used; its memory and time for one word grow faster than the word.
FAST_BYTES = 1 << 18


class Tokens(NamedTuple):
    """Tokens of several texts, one after the other."""

    ids: np.ndarray
    ends: np.ndarray  # byte offsets, running on over the texts
    counts: np.ndarray  # tokens of each text


def split_pattern(tokenizer_json: str) -> str:
    """The words of a byte-level tokenizer, as a pattern."""
    spec = json.loads(tokenizer_json)["pre_tokenizer"]
    if spec["type"] != "ByteLevel" or not spec["use_regex"] or spec["add_prefix_space"]:
        raise ValueError("not a byte-level tokenizer without prefix space")
    # Fixed value: the words of byte-level tokenizers.
    return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A: encodes space + text. Where merges are in the order of their ids, the same vocabulary as ranks is faster."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        special = {t["id"] for t in spec["added_tokens"]}
        self.bytes = enumerate_pieces(tokenizer_json)
        ranks = {piece: i for i, piece in self.bytes.items() if i not in special}
        merges = [m.replace(" ", "", 1) if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        ordered = [spec["model"]["vocab"][m] for m in merges]
        in_order = len(ranks) == len(ordered) + 256 and ordered == list(range(256, 256 + len(ordered)))
        self._fast = tiktoken.Encoding("ranks", pat_str=split_pattern(tokenizer_json), mergeable_ranks=ranks, special_tokens={}) if in_order else None
        self._plain = Tokenizer.from_str(tokenizer_json)
        self._plain.encode_special_tokens = True  # their strings in a text are ordinary text
        self._plain.no_truncation()
        self._plain.no_padding()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._encode(" " + t) for t in texts]

    def _encode(self, text: str) -> np.ndarray:
        if self._fast and len(text) <= FAST_BYTES:
            return self._fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        return np.array(self._plain.encode(text, add_special_tokens=False).ids, np.int32)


class Pieces:
    """B: encodes the text; the model adds the space."""

    def __init__(self, model: bytes):
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = {i: self._bytes_of(i) for i in range(self._model.get_piece_size())}

    def _bytes_of(self, i: int) -> bytes:
        piece = self._model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self._model.encode(texts, num_threads=1)]


# ---------------------------------------------------------------- one part of the texts
def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the tokens of A and B that end at common offsets, in order; both end at the same offset."""
    cuts_a, cuts_b = [np.array([len(a_ends) - 1])], [np.array([len(b_ends) - 1])]
    low, high = np.array([0]), np.array([len(a_ends) - 1])  # cuts are sought among low .. high - 1
    b_low, b_high = np.array([0]), np.array([len(b_ends) - 1])
    while len(low):
        cut, at = np.full(len(low), -1), np.full(len(low), -1)
        middle, todo = (low + high) // 2, np.arange(len(low))
        for side in (0, -1, 1, -2, 2, -3, 3, -4, 4):
            if not len(todo):
                break
            probe = middle[todo] + side
            inside = (probe >= low[todo]) & (probe < high[todo])
            of, sought = todo[inside], a_ends[probe[inside]]
            found = np.searchsorted(b_ends, sought)
            hit = b_ends[found] == sought
            cut[of[hit]], at[of[hit]] = probe[inside][hit], found[hit]
            todo = todo[cut[todo] < 0]
        for i in todo[high[todo] - low[todo] > 8].tolist():  # no common end close to the middle: the nearest of all
            sought = a_ends[low[i]:high[i]]
            found = b_low[i] + np.searchsorted(b_ends[b_low[i]:b_high[i]], sought)
            hit = np.flatnonzero(b_ends[found] == sought)
            if len(hit):
                nearest = hit[np.abs(hit + low[i] - middle[i]).argmin()]
                cut[i], at[i] = low[i] + nearest, found[nearest]
        halved = np.flatnonzero(cut >= 0)  # the others are leaves
        cut, at = cut[halved], at[halved]
        cuts_a.append(cut)
        cuts_b.append(at)
        low, high = np.stack([low[halved], cut + 1], 1).ravel(), np.stack([cut, high[halved]], 1).ravel()
        b_low, b_high = np.stack([b_low[halved], at + 1], 1).ravel(), np.stack([at, b_high[halved]], 1).ravel()
        more = (low < high) & (b_low < b_high)
        low, high, b_low, b_high = low[more], high[more], b_low[more], b_high[more]
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs of overlapping tokens: one for each stretch between neighbouring ends of either."""
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    ends = ends[np.concatenate([ends[1:] != ends[:-1], [True]])]
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


def group_texts(a: Tokens, b: Tokens, cuts_a: np.ndarray, cuts_b: np.ndarray, words: list[bytes], n_a: int, n_b: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every text. ``words``: ids with each separator, see ``separated``."""
    last_a, last_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    last_a[cuts_a], last_b[cuts_b] = True, True
    before_a = np.concatenate([[0], np.cumsum(last_a)[:-1]])  # groups that end before a token
    before_b = np.concatenate([[0], np.cumsum(last_b)[:-1]])
    until_a, until_b = np.concatenate([[0], cuts_a + 1]), np.concatenate([[0], cuts_b + 1])
    order = np.empty(len(a.ids) + len(b.ids), np.int64)
    order[np.arange(len(a.ids)) + until_b[before_a]] = a.ids + n_a * last_a
    order[np.arange(len(b.ids)) + until_a[before_b + 1]] = 2 * n_a + b.ids + n_b * last_b
    bounds = np.concatenate([[0], np.cumsum(a.counts + b.counts)]).tolist()
    # The last separator of a text is not written.
    return [b"".join([words[k] for k in order[s:e].tolist()])[:-1] for s, e in zip(bounds, bounds[1:])]


def separated(n_a: int, n_b: int) -> list[bytes]:
    """Decimal ids of A before ``,``, of A before ``|``, of B before ``,``, of B before ``;``."""
    return [b"%d%s" % (i, sign) for n, signs in ((n_a, (b",", b"|")), (n_b, (b",", b";"))) for sign in signs for i in range(n)]


# ---------------------------------------------------------------- blocks
class _Block:
    """Distinct pairs of a block and its documents' links as positions among them."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # distinct pairs, positions, links of each text
        self.columns: dict[str, list] = {k: [] for k in ("n_a", "n_b", "n_groups", "groups_sha256")}
        self.keys: list[pa.Array] = []

    def record(self, number: int) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate([p for p, _, _ in self.parts]))
        places = np.concatenate([np.searchsorted(pairs, p)[at] for p, at, _ in self.parts]).astype(np.int32)
        links = np.concatenate([n for _, _, n in self.parts])
        # In how many documents a pair stands: each document counts it once.
        holders = np.zeros(len(pairs), np.int64)
        for start, end in zip((np.cumsum(links) - links).tolist(), np.cumsum(links).tolist()):
            if end > start:
                holders[np.unique(places[start:end])] += 1
        # Frequent pairs get small numbers, which compress well.
        order = np.argsort(-holders, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        planes = np.ascontiguousarray(rank[places]).view(np.uint8).reshape(-1, 4).T.tobytes()
        keys = pa.concat_arrays(self.keys)
        docs = pa.StructArray.from_arrays(
            [keys, *(pa.array(np.concatenate(self.columns[k])) for k in ("n_a", "n_b", "n_groups")), pa.array(self.columns["groups_sha256"], pa.string()), pa.array(links)],
            ["keep", "n_a", "n_b", "n_groups", "groups_sha256", "n_links"],
        )
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), listed(pa.array(pairs[order])), listed(pa.array(holders[order])), pa.array([zstandard.compress(planes)], pa.binary()), listed(docs)],
            ["block", "pairs", "holders", "places", "docs"],
        )


class _Aligner:
    """Two tokenizers, ready to align parts of the texts."""

    def __init__(self, tokenizer_json: str, model: bytes):
        self.a, self.b = ByteLevel(tokenizer_json), Pieces(model)
        self.n_a, self.n_b = max(self.a.bytes) + 1, max(self.b.bytes) + 1
        self.a_size = np.array([len(self.a.bytes.get(i, b"")) for i in range(self.n_a)])
        self.b_size = np.array([len(self.b.bytes.get(i, b"")) for i in range(self.n_b)])
        self.words = separated(self.n_a, self.n_b)

    def part(self, texts: list[str], block: _Block) -> None:
        full = [i for i, t in enumerate(texts) if t]
        fit, a_ids, b_ids = [], [], []
        for i, x, y in zip(full, self.a.encode([texts[i] for i in full]), self.b.encode([texts[i] for i in full])):
            plain = (" " + texts[i]).encode()
            if b"".join([self.a.bytes[k] for k in x.tolist()]) == plain and b"".join([self.b.bytes[k] for k in y.tolist()]) == plain:
                fit.append(i)
                a_ids.append(x)
                b_ids.append(y)
        made = {k: np.zeros(len(texts), np.int64) for k in ("n_a", "n_b", "n_groups")}
        digests, links, pairs, places = [""] * len(texts), np.zeros(len(texts), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        if fit:
            a, b = self._tokens(a_ids, self.a_size), self._tokens(b_ids, self.b_size)
            cuts_a, cuts_b = shared_cuts(a.ends, b.ends)
            for i, text in zip(fit, group_texts(a, b, cuts_a, cuts_b, self.words, self.n_a, self.n_b)):
                digests[i] = hashlib.sha256(text).hexdigest()
            left, right = overlaps(a.ends, b.ends)
            pairs, places = np.unique(a.ids[left].astype(np.int64) * self.n_b + b.ids[right], return_inverse=True)
            upto = np.cumsum(a.counts)
            made["n_a"][fit], made["n_b"][fit] = a.counts, b.counts
            made["n_groups"][fit] = np.diff(np.searchsorted(cuts_a, upto), prepend=0)
            links[fit] = np.diff(np.searchsorted(left, upto), prepend=0)
        block.parts.append((pairs, places, links))
        for k, v in made.items():
            block.columns[k].append(v)
        block.columns["groups_sha256"] += digests

    @staticmethod
    def _tokens(ids: list[np.ndarray], size: np.ndarray) -> Tokens:
        joined = np.concatenate(ids)
        return Tokens(joined, np.cumsum(size[joined]), np.array([len(x) for x in ids]))


def _to_blocks(tokenizer_json: str, model: bytes, block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block, size, made = None, _Block(), 0, 0
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            aligner = aligner or _Aligner(tokenizer_json, model)
            text, keys = batch.column("text").fill_null(""), batch.column("keep")
            weights = np.asarray(pc.binary_length(text)).astype(np.int64)
            at = 0
            while at < len(text):
                upto = max(at + 1, at + int(np.searchsorted(np.cumsum(weights[at:]), PART_BYTES, side="right")))
                part = int(weights[at:upto].sum())
                if block.keys and size + part > block_bytes:
                    yield block.record(first + made)
                    block, size, made = _Block(), 0, made + 1
                aligner.part(text.slice(at, upto - at).to_pylist(), block)
                block.keys.append(keys.slice(at, upto - at))
                size += part
                at = upto
        if block.keys:
            yield block.record(first + made)

    return run


def _scored(schema: T.StructType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block and the counts of its pairs -> its documents."""

    def run(block: pa.Table, counted: pa.Table) -> pa.Table:
        names = [f.name for f in schema.fields]
        if not block.num_rows:
            raise ValueError("counts without their block")
        listed = block.column("docs").chunk(0).flatten()
        docs = dict(zip((f.name for f in listed.type), listed.flatten()))
        links = np.asarray(docs["n_links"])
        at = np.asarray(counted.column("at"))
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = np.asarray(counted.column("count")), np.asarray(counted.column("best")).astype(np.int64)
        planes = np.frombuffer(zstandard.decompress(block.column("places")[0].as_py()), np.uint8)
        places = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).reshape(-1)
        ends = np.cumsum(links)
        total = lambda values: (s := np.concatenate([[0], np.cumsum(values[places])]))[ends] - s[ends - links]
        columns = [*docs["keep"].flatten(), *(docs[c] for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(total(best)), pa.array(total(count)), docs["groups_sha256"]]
        return pa.Table.from_arrays(columns, names)

    return run


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks -> (pair, block, at) rows, and of every pair: in how many documents it stands and whether its A id has none in more."""
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("at", "p")).select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("holders"))
    return pairs.drop("holders"), pairs.groupBy("pair").agg(F.sum("holders").alias("count"))


def align(docs: DataFrame, tokenizer_path: str, model_path: str, keep: Sequence[str] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents -> the columns ``keep``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null or empty, or whose tokens of A or B do not spell out
    space + text, have no tokens: zeros and an empty digest. Null and repeated
    ids and any other kept columns are handed through; one with the name of a
    result gives way to it. Equal texts are documents of their own and count
    each; an empty table gives an empty result. A text is aligned whole, however
    long.
    """
    results = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    keep = [k for k in keep if k.lower() not in T.StructType.fromDDL(results).fieldNames()]
    tokenizer_json, model = Path(tokenizer_path).read_text(), Path(model_path).read_bytes()
    kept = docs.select(*(f"`{c}`" for c in keep)).schema
    slim = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in keep)).alias("keep"))
    doc = T.StructType([T.StructField("keep", kept), *T.StructType.fromDDL("n_a long, n_b long, n_groups long, groups_sha256 string, n_links long").fields])
    block_schema = T.StructType.fromDDL("block long, pairs array<long>, holders array<long>, places binary").add("docs", T.ArrayType(doc))
    blocks = stored(slim.mapInArrow(_to_blocks(tokenizer_json, model, block_bytes), block_schema), "aligned-blocks")
    pairs, sums = pair_counts(blocks)
    counts = stored(sums, "pair-counts").withColumn("a", F.expr(f"pair div {max(Pieces(model).bytes) + 1}"))
    # One row for each id of A: no more than its vocabulary has.
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    judged = counts.join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = pairs.join(judged, "pair").select(F.col("block").alias("of"), "at", "count", "best")
    out = T.StructType([*kept.fields, *T.StructType.fromDDL(results).fields])
    return blocks.select("block", "places", "docs").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_scored(out), out)
