"""Near duplicates: an exact similarity join of texts, as a plan over SQL functions.

A text is the set of its five-word windows. Texts of equal sets are linked at
once; one of them stands for all. The rest takes two steps:

* MinHash bands find most links cheaply. A signature holds, for each of
  ``bands * rows`` hash functions, the smallest hash of a window; equal values in
  all rows of a band make two texts members of one bucket. Members are checked
  against the text of their bucket that shares most buckets with others, so a
  bucket of any size gives one pair a member.
* What that misses is found by shared windows, among texts of different
  components only. Of two near sets, the few smallest windows have some in
  common; a text that shares too few of these with other components is near none
  of them. Of the texts left, the windows are ordered from rare to frequent: two
  near texts meet in the rarest window they share, which lies among the first
  quarter of the one and the first seventh of the other. Every pair that meets
  there and may be near by what comes after is checked on the whole sets.

So no component is lost, whatever the signatures tell.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ledgerleaf.operators.governance import normalize_text
from ledgerleaf.session import cut_lineage

WORDS, PERCENT = 5, 75
#: At a similarity of 0.75 two texts share no band in one of 900,000 cases.
BANDS, ROWS = 24, 3
#: So many rows of ids may be broadcast; beyond it, what they are joined with is shuffled.
BROADCAST_ROWS = 500_000
#: Texts of a window's bucket, of the smaller ones, that one task compares with the others; sets of a side of a cell, about.
TILE = 512


_SLICE = 1 << 16  # windows hashed at a time
_HELD = 1 << 16  # rows of one window and label kept back
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h ^= h >> np.uint64(27)
    h *= _MIX[2]
    return h ^ (h >> np.uint64(31))


def _windows_of(digests: pa.Array, words: int) -> pa.Array:
    """The distinct windows of each array of word digests, as digests; a shorter array is one window."""
    sizes = pc.fill_null(pc.list_value_length(digests), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begins, values = np.cumsum(sizes) - sizes, digests.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    made = [np.empty(0, np.uint64)]
    for begin, size in zip(begins.tolist(), sizes.tolist()):
        width = min(words, size)
        count = size - width + 1 if size else 0
        window = np.full(count, width, np.uint64)
        for k in range(width):
            window = _mixed(window * _MIX[0] + values[begin + k:begin + k + count])
        made.append(np.unique(window))
    ends = np.cumsum([len(m) for m in made])  # the first is empty
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(made).view(np.int64)))


def _word_digests(text: Column) -> Column:
    # A blank text is one empty word; no other text that is normalised has one.
    return F.transform(F.filter(F.split(normalize_text(text), " "), lambda w: w != ""), lambda w: F.xxhash64(w))


def text_windows(text: Column, words: int = WORDS) -> Column:
    """Digests of the distinct windows of the normalised text; none for null or blank texts."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def windows(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for digests in arrays:
            yield _windows_of(digests, words)

    return windows(_word_digests(text))


def _bands_of(sets: pa.Array, bands: int, rows: int) -> np.ndarray:
    """One row of ``bands`` digests for each set; those of an empty set are 0."""
    made = np.zeros((len(sets), bands), np.uint64)
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(sets), 0).to_pylist()])
    values = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    at = 0
    while at < len(sets):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + _SLICE)))
        to = min(to, len(sets))
        full = at + np.flatnonzero(ends[at + 1:to + 1] > ends[at:to])
        starts, part = ends[full] - ends[at], values[ends[at]:ends[to]]
        for band in range(bands if len(full) else 0):
            digest = np.full(len(full), band, np.uint64)
            for row in range(rows):
                seed = _mixed(np.array([band * rows + row + 1], np.uint64) * _MIX[0])
                digest = _mixed(digest * _MIX[0] + np.minimum.reduceat(_mixed(part ^ seed), starts))
            made[full, band] = digest
        at = to
    return made


def band_keys(windows: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """One digest for each band of the MinHash signature of a set of digests."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def keys(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for sets in arrays:
            made = _bands_of(sets, bands, rows).view(np.int64).ravel()
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(made))

    return keys(windows)


def _sketches_of(digests: pa.Array, percent: int, bands: int, rows: int) -> pa.StructArray:
    """What ``text_sketch`` tells, from arrays of word digests; some ``_SLICE`` words at a time."""
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(digests), 0).to_pylist()])
    made, at = [], 0
    while at < len(digests) or not made:
        to = min(max(at + 1, int(np.searchsorted(ends, ends[at] + _SLICE))), len(digests))
        sets = _windows_of(digests.slice(at, to - at), WORDS)
        begins, values = sets.offsets.to_numpy()[:-1].astype(np.int64), sets.values.to_numpy(zero_copy_only=False).view(np.uint64)
        n = np.diff(sets.offsets.to_numpy()).astype(np.int64)
        totals = np.zeros((2, len(n)), np.uint64)
        for k, seed in enumerate(_MIX[:2]):
            if n.any():
                totals[k, n > 0] = np.add.reduceat(_mixed(values ^ seed), begins[n > 0], dtype=np.uint64)
        looked = np.where(n > 0, np.minimum(n, n - _least_common(n, percent) + _spare(n)), 0)
        upto = np.cumsum(looked)
        smallest = values[np.arange(looked.sum()) + np.repeat(begins - (upto - looked), looked)]
        lists = lambda offsets, x: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.view(np.int64)))
        made.append(pa.StructArray.from_arrays([
            pa.array(n), pa.array(totals[0].view(np.int64)), pa.array(totals[1].view(np.int64)),
            lists(np.arange(len(n) + 1) * bands, _bands_of(sets, bands, rows).ravel()), lists(np.append(0, upto), smallest),
        ], ["n", "d1", "d2", "bands", "smallest"]))
        at = to
    return pa.concat_arrays(made)


def text_sketch(text: Column, percent: int, bands: int, rows: int) -> Column:
    """Of the set of a text: its size, two digests of it, digests of its bands, and the smallest windows.

    Made in one go, so that no whole set leaves Python.
    """

    @F.arrow_udf("n long, d1 long, d2 long, bands array<long>, smallest array<long>")
    def sketches(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for digests in arrays:
            yield _sketches_of(digests, percent, bands, rows)

    return sketches(_word_digests(text))


def _least_common(n: np.ndarray | Column, percent: int) -> np.ndarray | Column:
    """How many of ``n`` windows a near set has in common with them, at least."""
    return -(-percent * n // 100) if isinstance(n, np.ndarray) else F.ceil(percent * n / 100)


def _spare(n: np.ndarray | Column) -> np.ndarray | Column:
    """How many windows two near sets share at least among their smallest ones, the more are looked at."""
    return n // 16 + 1 if isinstance(n, np.ndarray) else F.floor(n / 16) + 1


def _few(ids: DataFrame) -> DataFrame:
    """Stored rows of ids, to be broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _with_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of the texts in ``ids``, made again; stored."""
    return cut_lineage(docs.join(_few(ids), "id", "left_semi").select("id", text_windows(F.col("text")).alias("set")))


def _near_pairs(pairs: pa.Table, sets: pa.Table, percent: int) -> pa.Table:
    """Those of the pairs (a, b) whose sets (id, set) are near."""
    places = sets.column("set").combine_chunks()
    values, ends = places.values.to_numpy(zero_copy_only=False).view(np.uint64), places.offsets.to_numpy()
    own = {x: values[ends[k]:ends[k + 1]] for k, x in enumerate(sets.column("id").to_pylist())}
    partners: dict = {}
    for x, y in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
        partners.setdefault(x, []).append(y)
    near: list[tuple] = []
    for x, others in partners.items():
        sizes = np.array([len(own[y]) for y in others])
        met = np.concatenate([own[y] for y in others])
        common = np.add.reduceat(own[x][np.searchsorted(own[x], met) % len(own[x])] == met, np.cumsum(sizes) - sizes, dtype=np.int64)
        near += [(x, others[k]) for k in np.flatnonzero(100 * common >= percent * (len(own[x]) + sizes - common)).tolist()]
    kinds = pairs.schema.field("a").type, pairs.schema.field("b").type
    return pa.table({c: pa.array([p[k] for p in near], kinds[k]) for k, c in enumerate("ab")})


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the stored pairs (a, b) whose whole sets are near; stored.

    Pairs are dealt over the cells of a grid of blocks of ids, and a set travels
    once for each cell that needs it, however many pairs it is in.
    """
    blocks = max(1, ceil(min(sets.count() / TILE, sqrt(pairs.count() / TILE))))
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(blocks))
    dealt = pairs.select((block("a") * blocks + block("b")).alias("cell"), "a", "b")
    needed = cut_lineage(dealt.select("cell", F.col("a").alias("id")).unionByName(dealt.select("cell", F.col("b").alias("id"))).distinct())
    laid = sets.join(_few(needed), "id").select("cell", "id", "set")
    kind = pairs.schema["a"].dataType.simpleString()

    def near(ours: pa.Table, others: pa.Table) -> pa.Table:
        return _near_pairs(ours, others, percent)

    return cut_lineage(dealt.groupBy("cell").cogroup(laid.groupBy("cell")).applyInArrow(near, f"a {kind}, b {kind}"))


def _central_links(docs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Links of the members of each bucket of a band to its most central one."""
    members = sketches.select("id", "n", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = cut_lineage(members.join(sizes, "band"))
    weights = shared.groupBy("id").agg(F.sum("m").alias("weight"))
    heads = shared.join(weights, "id").groupBy("band").agg(F.min_by(F.struct(F.col("id").alias("head"), F.col("n").alias("of")), F.struct(-F.col("weight"), "id")).alias("top"))
    met = shared.join(heads.select("band", "top.*"), "band").where(f"id <> head AND 100 * least(n, of) >= {percent} * greatest(n, of)")
    pairs = cut_lineage(met.select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct())
    ids = cut_lineage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    return _checked(pairs, _with_sets(docs, ids), percent)


def _of_several(windows: DataFrame) -> DataFrame:
    """(label, window) of every text -> the windows that texts of different labels have, with the number of these texts."""
    held = windows.groupBy("window").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("low"), F.max("label").alias("high"))
    return held.where("low <> high").select("window", "m")


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (window, label, id) in this order -> the ids of those whose window texts of different labels have.

    One row of a text for each such window. The first and the last window may go
    on in another task and count as well, as does one with ``_HELD`` rows of a
    label: so a few texts too many are told of, none too few.
    """
    known, held, kind = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema.field("id").type
        window, label, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("window", "label", "id"))
        if held is None:
            known = window[0]
        else:
            window, label, ids = (np.concatenate(both) for both in zip(held, (window, label, ids)))
        same = window[1:] == window[:-1]
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        several = np.logical_or.reduceat(np.concatenate([[False], same & (label[1:] != label[:-1])]), starts)
        several[0] |= window[0] == known
        last = starts[-1]
        if several[-1] or len(window) - last > _HELD:
            several[-1], known, last = True, window[-1], len(window)
        sizes = np.diff(np.append(starts, len(window)))
        give = np.repeat(several, sizes)
        held = window[last:], label[last:], ids[last:]
        yield pa.RecordBatch.from_arrays([pa.array(ids[give], kind)], ["id"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(held[2], kind)], ["id"])


def _other_links(docs: DataFrame, sketches: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All links between texts of different labels (a text without one is alone)."""
    label = F.coalesce("component", "id").alias("label")
    first = sketches.join(_few(labels), "id", "left").select("id", label, F.explode("smallest").alias("window"))
    # Ranges of windows and labels, so that a frequent window is dealt over several tasks.
    ranged = first.select("window", "label", "id").repartitionByRange("window", "label").sortWithinPartitions("window", "label")
    common = ranged.mapInArrow(_meeting, f"id {docs.schema['id'].dataType.simpleString()}").groupBy("id").agg(F.count(F.lit(1)).alias("common"))
    # A near text may be smaller, and less is then looked at of both.
    enough = common.join(sketches.select("id", "n"), "id").where(F.col("common") >= _spare(_least_common(F.col("n"), percent)))
    open_ = cut_lineage(enough.join(labels, "id", "left").select("id", label, "n"))
    sets = _with_sets(docs, open_.select("id"))
    windows = sets.join(_few(open_), "id").select("id", "label", F.explode("set").alias("window"))
    # ``left``: how many shared windows a text has from this one on, from rare to frequent.
    frequent = Window.partitionBy("id").orderBy(F.desc("m"), F.desc("window"))
    placed = windows.select("id", "window").join(_of_several(windows), "window").withColumn("left", F.row_number().over(frequent))
    placed = placed.join(_few(open_), "id").where(f"100 * left >= {percent} * n")
    placed = cut_lineage(placed.select("window", "id", "label", "n", "left"))
    few = placed.where(f"(100 + {percent}) * left >= 2 * {percent} * n")  # of the smaller text of a pair
    tiles = few.groupBy("window").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    small = few.join(tiles, "window").select("window", F.pmod(F.xxhash64("id"), "tiles").cast("int").alias("tile"), *(F.col(c).alias(f"{c}_a") for c in few.columns[1:]))
    large = placed.join(tiles, "window").select("window", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), *(F.col(c).alias(f"{c}_b") for c in placed.columns[1:]))
    met = small.join(large, ["window", "tile"]).where(f"""
        label_a <> label_b AND (n_a < n_b OR n_a = n_b AND id_a < id_b) AND 100 * n_a >= {percent} * n_b
        AND (100 + {percent}) * least(left_a, left_b) >= {percent} * (n_a + n_b)""")
    pairs = cut_lineage(met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct())
    return _checked(pairs, sets, percent)


def near_links(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b), a < b: links between texts whose sets have at least ``percent`` of their union in common.

    Not all such pairs, but all components of them. Texts that are null or blank
    are linked with nothing, nor are rows without a key. ``bands`` and ``rows``
    tell how much is found by signatures; the result has the same components
    with any.
    """
    docs = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    sketches = docs.select("id", text_sketch(F.col("text"), percent, bands, rows).alias("sketch"))
    # Filtered as stored: a filter of the plan would move below and have all windows made twice.
    sketches = cut_lineage(sketches.select("id", "sketch.*")).where("n > 0")
    ones = sketches.groupBy("d1", "d2", "n").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = cut_lineage(sketches.select("d1", "d2", "n", F.col("id").alias("b")).join(ones, ["d1", "d2", "n"]).where("a <> b").select("a", "b"))
    if not copies.isEmpty():
        sketches = sketches.join(_few(copies.select(F.col("b").alias("id"))), "id", "left_anti")
    found = _central_links(docs, sketches, percent)
    return copies.unionByName(found).unionByName(_other_links(docs, sketches, components(found), percent))


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (id, component): the smallest id that each linked id reaches.

    Ids take the smallest label among themselves and their neighbours, and labels
    are replaced by their own labels, so the rounds grow with the logarithm of
    the longest path. Each round is cut off by a checkpoint.
    """
    ends = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(ends.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        upper = labels.toDF("component", "higher")
        lifted = labels.join(upper, "component").select("id", "component", "higher")
        seen = ends.join(lifted.select(F.col("id").alias("b"), "higher"), "b").groupBy("a").agg(F.min("higher").alias("offer"))
        offered = lifted.join(seen.withColumnRenamed("a", "id"), "id")
        new = cut_lineage(
            offered.select("id", F.least("higher", "offer").alias("component"))
            .unionByName(offered.select(F.col("component").alias("id"), F.col("offer").alias("component")))
            .groupBy("id").agg(F.min("component").alias("component"))
        )
        if new.join(labels.toDF("id", "before"), "id").where("component <> before").isEmpty():
            return new
        labels = new


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each component of near duplicates: that with the smallest key.

    Keys are unique; rows without a key or with a null or blank text all stay.
    """
    gone = components(near_links(docs, key, text, **how)).where("id <> component").select(F.col("id").alias(key))
    return docs.join(gone, key, "left_anti")
