"""Exact similarity join of documents on word shingles.

Documents of equal shingle sets are one node. Which nodes can be similar at all
follows from their smallest digests: of ``n`` shingles, one of the first
``n // 4 + 1`` is shared with every node of similarity 0.75 or more. Nodes that
share such a shingle form a bucket. Inside buckets, shingles are hashed into
groups, a node's counts per group are a point, and an R-tree over the points is
joined with itself: the overlap of two nodes is at most the sum of the minima of
their coordinates, and that of two subtrees at most the sum over the tree nodes'
upper corners. Pairs that survive are verified on their whole sets.

Three measures keep buckets few and small. Prefixes are longer than needed, so
similar nodes share several of their shingles: a node that shares fewer with
others leaves, and a node may leave its most frequent shingles out, as
many as its prefix is longer, since two similar nodes still meet in the rarest
shingle they share. Each node is verified against the most central node that it
shares shingles with, so that large groups of near copies become one component;
afterwards only pairs of different components are looked for. Buckets are cut
into tiles, and pairs of tiles are compared, so no task holds a whole group.
Candidates leave a bucket as nodes, not as pairs: their sets are sent to the
bucket and verified there, and of the links found only those go out that connect
what was not yet connected. No component is lost by any of this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerleaf.llm.common import WORD_PATTERN, stored
from ledgerleaf.llm.graphs import components
from ledgerleaf.llm.shingles import finish, shingle_sets

#: Shingles in a group of a point, about; the number of groups is a power of two and grows with the set.
GROUP_SIZE = 2
LEAF, FANOUT = 32, 8
#: So many look-up rows (60 bytes each) may be broadcast; beyond it, texts are shuffled.
BROADCAST_ROWS = 500_000
#: Sets that are compared with one and the same set in one group.
STAR = 500
#: Points, and whole sets, of one side of a pair of tiles, about.
POINT_TILE, SET_TILE = 4096, 512
#: Tokens of a node that tell in which bucket a pair counts; with fewer, some pairs count several times.
OWN = 12


def _needed(n: int) -> int:
    return n // 4 + 1


def _prefix(n: int) -> int:
    return min(n, _needed(n) + 4 + n // 25)


# How many shingles of their prefixes a node of n shares with any similar one, at
# least: as many and one as the prefix of the smallest of them, lo, is longer than needed.
_LO = "((3 * n + 3) DIV 4)"
_COMMON = f"(least({_LO}, {_LO} DIV 4 + 5 + {_LO} DIV 25) - {_LO} DIV 4)"


def _node(shingles: np.ndarray) -> int:
    """Digest of a whole set; 0 stands for the empty set."""
    if not len(shingles):
        return 0
    mixed = finish(shingles ^ np.uint64(0x51ED270B))
    both = np.array([mixed.sum(dtype=np.uint64) * np.uint64(3) + np.bitwise_xor.reduce(mixed) + np.uint64(len(shingles))])
    return int(finish(both).view(np.int64)[0]) or 1


def _groups(n: int) -> int:
    return 1 << max(3, (n // GROUP_SIZE).bit_length())


def _point(shingles: np.ndarray) -> bytes:
    groups = _groups(len(shingles))
    counts = np.bincount((shingles % np.uint64(groups)).astype(np.int64), minlength=groups)
    # The first byte tells the width of the numbers in half bytes.
    if counts.max() < 16:
        return b"\x01" + (counts[0::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    return b"\x02" + counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"\x08" + counts.astype(np.uint32).tobytes()


def _width(point: bytes) -> int:
    return (len(point) - 1) * 2 // point[0]


def _counts(point: bytes) -> np.ndarray:
    own = np.frombuffer(point, np.uint32 if point[0] == 8 else np.uint8, offset=1)
    return np.stack([own & 15, own >> 4], axis=1).reshape(-1) if point[0] == 1 else own


def _folded(points: list[bytes], groups: int) -> np.ndarray:
    """Points in ``groups`` coordinates: those of more are added up, which keeps the bound."""
    out = np.empty((len(points), groups), np.int32)
    for i, point in enumerate(points):
        out[i] = _counts(point).reshape(-1, groups).sum(axis=0)
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, k, text -> doc_id, k, node, n, point (of sets that are compared at all)."""
    for batch in batches:
        sets = list(shingle_sets(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("k"), pa.array([_node(s) for s in sets], pa.int64()),
             pa.array([len(s) for s in sets], pa.int64()), pa.array([_point(s) for s in sets], pa.binary())],
            ["doc_id", "k", "node", "n", "point"],
        )


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> the prefix of every set: token, node, n; a set once a batch."""
    for batch in batches:
        tokens, nodes, sizes, seen = [], [], [], set()
        for s in shingle_sets(batch.column("text")):
            node = _node(s)
            if node and node not in seen:
                seen.add(node)
                tokens.append(s[:_prefix(len(s))])
                nodes.append(node)
                sizes.append(len(s))
        if tokens:
            repeats = [len(t) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), repeats)),
                 pa.array(np.repeat(np.array(sizes, np.int32), repeats))],
                ["token", "node", "n"],
            )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, node -> those whose token has several nodes, each node once."""
    held = None  # the last row so far, and whether it has been given out
    for batch in batches:
        t, v, n = (np.asarray(batch.column(c)) for c in ("token", "node", "n"))
        if not len(t):
            continue
        out = np.zeros(len(t), bool)
        if held is not None:
            t, v, n = np.append(held[0], t), np.append(held[1], v), np.append(held[2], n)
            out = np.append(held[3], out)
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
        t, v, n, out = t[fresh], v[fresh], n[fresh], out[fresh]
        same = np.zeros(len(t) + 1, bool)
        same[1:-1] = t[1:] == t[:-1]
        give = (same[:-1] | same[1:]) & ~out
        yield pa.RecordBatch.from_arrays([pa.array(t[give]), pa.array(v[give]), pa.array(n[give])], ["token", "node", "n"])
        held = (t[-1], v[-1], n[-1], bool(out[-1] or give[-1]))


def _enough(a: np.ndarray, b: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """100 * overlap >= 75 * union, for sets of a and b shingles."""
    return 7 * overlap >= 3 * (a + b)


def tree_join(points: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of a bucket that may be similar: R-tree self-join on count vectors.

    Rows are sorted by ``n``. Pairs of one label are left out, and pairs of one side, but for side 2.
    """
    levels = []
    high, small, large, width = points, n, n, LEAF
    while len(high) > 1:
        cuts = np.arange(0, len(high), width)
        high, small, large = np.maximum.reduceat(high, cuts), np.minimum.reduceat(small, cuts), np.maximum.reduceat(large, cuts)
        levels.append((high, small, large))
        width = FANOUT
    i = j = np.zeros(1, np.int64)
    for depth in range(len(levels) - 2, -2, -1):
        high, small, large = levels[depth] if depth >= 0 else (points, n, n)
        width = FANOUT if depth >= 0 else LEAF
        found = []
        for at in range(0, len(i), 256):
            step = np.arange(width)
            a = (i[at:at + 256, None, None] * width + step[:, None])
            b = (j[at:at + 256, None, None] * width + step[None, :])
            a, b = (x.reshape(-1) for x in np.broadcast_arrays(a, b))
            keep = (a < len(high)) & (b < len(high)) & (a <= b)
            a, b = a[keep], b[keep]
            keep = 4 * large[a] >= 3 * small[b]
            if depth < 0:
                keep &= (a < b) & (label[a] != label[b]) & ((side[a] != side[b]) | (side[a] == 2))
            a, b = a[keep], b[keep]
            for part in range(0, len(a), 20_000):
                x, y = a[part:part + 20_000], b[part:part + 20_000]
                keep = _enough(small[x], small[y], np.minimum(high[x], high[y]).sum(axis=1, dtype=np.int64))
                found.append((x[keep], y[keep]))
        i = np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)])
        j = np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)])
    return i, j


def level_join(points: list[bytes], n: np.ndarray, label: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``tree_join`` of a bucket whose points have different numbers of groups.

    Similar sets differ by a third in size at most, hence by one level; each
    level is joined with itself and the next in its own number of groups.
    """
    width = np.array([_width(p) for p in points])
    found = []
    for groups in np.unique(width).tolist():
        rows = np.flatnonzero((width == groups) | (width == 2 * groups))
        i, j = tree_join(_folded([points[r] for r in rows.tolist()], groups), n[rows], label[rows], side[rows])
        lower = (width[rows[i]] == groups) | (width[rows[j]] == groups)
        found.append((rows[i[lower]], rows[j[lower]]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int]]:
    """Rows sorted by token, part -> (table, first, end) of every group of equal ones."""
    kept: list[pa.RecordBatch] = []

    def cuts(table: pa.Table) -> list[int]:
        t, p = (np.asarray(table.column(c)) for c in ("token", "part"))
        return [0, *(np.flatnonzero((t[1:] != t[:-1]) | (p[1:] != p[:-1])) + 1).tolist()]

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        if any(kept[0].column(c)[0].as_py() != batch.column(c)[batch.num_rows - 1].as_py() for c in ("token", "part")):
            table = pa.Table.from_batches(kept)
            # The last group may go on in the next batch.
            at = cuts(table)
            for first, end in zip(at, at[1:]):
                yield table, first, end
            kept = table.slice(at[-1]).combine_chunks().to_batches()
    if kept:
        table = pa.Table.from_batches(kept)
        at = cuts(table) + [table.num_rows]
        for first, end in zip(at, at[1:]):
            yield table, first, end


def _bucket_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of buckets (rows sorted by token, part, n) -> token, node of the pairs that the tree leaves.

    A row holds the smallest tokens of its node's buckets, ``own``: a pair known
    to share a smaller one is left to that bucket.
    """
    seen, out, size, tokens = None, [], 0, []
    for table, first, end in _whole(batches):
        if table is not seen:
            seen = table
            t, v, n, label, side = (np.asarray(table.column(c)) for c in ("token", "node", "n", "label", "side"))
        if end - first < 2:
            continue
        group = table.slice(first, end - first)
        i, j = level_join(group.column("point").to_pylist(), n[first:end], label[first:end], side[first:end])
        if not len(i):
            continue
        own = {r: np.asarray(group.column("own")[r].values) for r in np.union1d(i, j).tolist()}
        token = t[first]
        once = np.array([not (np.intersect1d(own[x], own[y], assume_unique=True) < token).any() for x, y in zip(i.tolist(), j.tolist())])
        found = v[first + np.union1d(i[once], j[once])]
        out.append(found)
        tokens.append(np.full(len(found), token))
        size += len(found)
        if size > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(out))], ["token", "node"])
            out, size, tokens = [], 0, []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(out))], ["token", "node"])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of buckets with whole sets (rows sorted by token, part, n) -> links between different components."""
    for table, first, end in _whole(batches):
        group = table.slice(first, end - first)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in group.column("shingles").chunks for x in c]
        v, label, side = (np.asarray(group.column(c)) for c in ("node", "label", "side"))
        n = np.array([len(s) for s in sets], np.int64)
        top = {x: x for x in label.tolist()}

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        a, b = [], []
        i, j = level_join([_point(s) for s in sets], n, label, side)
        for x, y in zip(i.tolist(), j.tolist()):
            one, other = root(int(label[x])), root(int(label[y]))
            if one != other and 7 * len(np.intersect1d(sets[x], sets[y], assume_unique=True)) >= 3 * (n[x] + n[y]):
                top[one] = other
                a.append(v[x])
                b.append(v[y])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A column of texts, the last, replaced by their sets (packed)."""
    for batch in batches:
        packed = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], [*batch.schema.names[:-1], "shingles"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars, the center's set first, then those it may be similar to -> links."""
    now, center = None, np.empty(0, np.uint64)
    for batch in batches:
        a, b = [], []
        for at, part, node, packed in zip(batch.column("center").to_pylist(), batch.column("part").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles")):
            own = np.frombuffer(packed.as_buffer(), np.uint64)
            if node == at:
                now, center = (at, part), own.copy()
            elif now == (at, part) and 7 * len(np.intersect1d(center, own, assume_unique=True)) >= 3 * (len(center) + len(own)):
                a.append(at)
                b.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _with_sets(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (with a column node) with the set of each node, from the text of one document."""
    one = nodes.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(
        F.min(F.struct("k", F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("one")
    )
    wanted = stored(members.join(one, "node").select(*members.columns, F.col("one.k").alias("k"), F.col("one.doc_id").alias("id")), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    match = (docs["k"] == wanted["k"]) & docs["doc_id"].eqNullSafe(wanted["id"])
    texts = docs.join(F.broadcast(wanted) if few else wanted, match).select(*members.columns, "text")
    kinds = ", ".join(f"{c} {members.schema[c].dataType.simpleString()}" for c in members.columns)
    return texts.mapInArrow(_sets, f"{kinds}, shingles binary")


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Verify pairs (a, b), one of each b, on whole sets; stored.

    Pairs are gathered into stars around ``a``, large ones in parts, so a set
    travels once for each star it is in.
    """
    pairs = stored(pairs, "candidates")
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    stars = stored(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / STAR)).cast("int").alias("part")), "stars")
    members = stars.select(F.col("a").alias("center"), "part", F.col("b").alias("node")).union(
        stars.select(F.col("a").alias("center"), "part", F.col("a").alias("node")).distinct()
    )
    sets = _with_sets(docs, nodes, members)
    order = [F.col("center"), F.col("part"), F.col("node") != F.col("center"), F.col("node")]
    return stored(sets.repartition("center", "part").sortWithinPartitions(*order).mapInArrow(_verified, "a long, b long"), "links")


def _tiled(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (with token, node, label) with part, side: buckets cut into pairs of tiles; those of one component go.

    Nodes of a bucket's largest component are never compared with each other: a
    tile of them meets the tiles of the others only, and these meet all.
    """
    mixed = F.xxhash64("node")
    of_label = rows.groupBy("token", "label").agg(
        F.count(F.lit(1)).alias("c"), F.bit_xor(mixed).alias("x"), F.sum(F.shiftright(mixed, 20)).alias("s")
    )
    buckets = of_label.groupBy("token").agg(
        F.sum("c").alias("m"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("c", "label")).alias("most"),
        F.bit_xor("x").alias("x"), F.sum("s").alias("s"),
    ).where("labels > 1")
    # Buckets of the same nodes give the same pairs: one of them is enough.
    buckets = buckets.groupBy("m", "x", "s").agg(F.min(F.struct("token", "most")).alias("one"))
    count = lambda c: F.ceil(c / size).cast("long")
    buckets = buckets.select(
        "one.token", "m", F.col("one.most.label").alias("most"),
        count(F.col("m") - F.col("one.most.c")).alias("others"), count(F.col("one.most.c")).alias("tiles"),
    )
    tile = F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.expr("label = most"), F.col("tiles")).otherwise(F.col("others")))
    both = "CAST({0} * (others + tiles) + {1} AS BIGINT) AS part, {2} AS side"
    places = F.expr(f"""
        CASE WHEN m <= {size} THEN array(named_struct('part', 0L, 'side', 2))
        WHEN label = most THEN transform(sequence(0L, others - 1), p -> struct({both.format("p", "others + tile", "1")}))
        ELSE concat(
            transform(sequence(0L, others - 1), p -> struct({both.format("least(tile, p)", "greatest(tile, p)", "CASE WHEN p = tile THEN 2 WHEN p > tile THEN 0 ELSE 1 END")})),
            transform(sequence(0L, tiles - 1), p -> struct({both.format("tile", "others + p", "0")}))) END""")
    return rows.join(buckets, "token").withColumn("tile", tile).withColumn("place", F.explode(places)).select(*rows.columns, "place.part", "place.side")


def _central_pairs(shared: DataFrame) -> DataFrame:
    """Each node (b) with one central node (a) of its buckets, where they share enough to be promising.

    A node is the more central the more other nodes its shingles are shared
    with, for its size: the text that near copies were made of comes first. Of
    large sets a half to an eighth of the shingles tells that; what is missed
    here is found in the buckets.
    """
    told = shared.withColumn("times", F.expr("CASE WHEN n < 300 THEN 1 WHEN n < 600 THEN 2 WHEN n < 1200 THEN 4 ELSE 8 END")).where("pmod(token, times) = 0")
    m = told.groupBy("token").agg(F.count(F.lit(1)).alias("m"))
    weighed = told.join(m, "token").withColumn("weight", F.sum(F.col("m") * F.col("times")).over(Window.partitionBy("node")) / F.col("n"))
    leaders = weighed.groupBy("token").agg(F.max(F.struct("weight", "node", "n")).alias("top")).select("token", "top.*").toDF("token", "a_weight", "a", "a_n")
    pairs = told.join(leaders, "token").where("node <> a AND 4 * a_n >= 3 * n AND 4 * n >= 3 * a_n")
    counted = pairs.groupBy("node", "a").agg(F.sum("times").alias("c"), F.first("n").alias("n"), F.first("a_weight").alias("weight"))
    return counted.where("3 * c >= n DIV 4 + 1").groupBy("node").agg(F.max_by("a", F.struct("weight", "c", "a")).alias("a")).select("a", F.col("node").alias("b"))


def similar_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> nodes (doc_id, k, node, n, point) and, of linked nodes, (node, label)."""
    keyed = docs.select("doc_id", "text", _text_key().alias("k"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    nodes = stored(keyed.mapInArrow(_nodes, f"doc_id {id_type}, k long, node long, n long, point binary"), "nodes")
    tokens = keyed.select("text").mapInArrow(_prefixes, "token long, node long, n int")
    shared = stored(
        tokens.repartition("token").sortWithinPartitions("token", "node").mapInArrow(_shared, "token long, node long, n int"),
        "shared",
    )
    first = _links(keyed, nodes, _central_pairs(shared))
    labels = components(first)

    # What is left to look for: buckets with several components.
    named = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    rarest = Window.partitionBy("node").orderBy(F.desc("m"), F.desc("token"))
    open_rows = named.join(mixed.select("token", "m"), "token").withColumn("place", F.row_number().over(rarest))
    open_rows = stored(open_rows.where(f"place >= {_COMMON}").select("token", "node", "n", "label"), "open")
    tiles = stored(_tiled(open_rows, POINT_TILE), "tiles")
    points = nodes.join(tiles.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("point").alias("point"))
    # At most as many tokens as the node's prefix has.
    own = tiles.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("token")), 1, OWN).alias("own"))
    rows = tiles.join(points.join(own, "node"), "node").select("token", "part", "side", "node", "n", "label", "point", "own")
    found = (
        rows.repartition("token", "part").sortWithinPartitions("token", "part", "n", "node")
        .mapInArrow(_bucket_candidates, "token long, node long").distinct()
    )
    found = stored(found, "found").join(open_rows, ["token", "node"])
    sets = _with_sets(keyed, nodes, _tiled(stored(found, "candidates"), SET_TILE).select("token", "part", "side", "node", "n", "label"))
    second = sets.repartition("token", "part").sortWithinPartitions("token", "part", "n", "node").mapInArrow(_bucket_links, "a long, b long")
    return nodes, components(first.union(stored(second, "links")))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id; one row per row.

    Documents link at a Jaccard similarity of 0.75 or more of their distinct
    5-word shingles; ``component_id`` is the smallest doc_id that links reach
    (null ids are passed over). A null text or one without words links with
    nothing; a repeated row or id is a row as any other; an empty table gives
    an empty result. Sets and shingles are compared by 64-bit digests.
    """
    nodes, labels = similar_components(docs)
    named = nodes.select("doc_id", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stored(named, "named")
    lowest = named.where("node <> 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return named.join(lowest, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near duplicates: of each component the document with the smallest id.

    Null ids come after all others. Of rows equal in id and text one stays.
    Documents without words all stay. All columns are kept.
    """
    nodes, labels = similar_components(docs)
    named = nodes.where("node <> 0").select("doc_id", "k", "node").join(labels, "node", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k")).alias("first")
    chosen = named.groupBy(F.coalesce("label", "node").alias("label")).agg(first).select(F.col("first.doc_id").alias("id"), F.col("first.k").alias("k"))
    worded = F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))
    chosen = stored(chosen, "chosen")
    match = docs["doc_id"].eqNullSafe(chosen["id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == chosen["k"])
    kept = docs.where(worded).join(chosen, match, "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).union(docs.where(~worded))
