"""Removal of repeated passages by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier
(smaller document, or the same document and an earlier place).

Shards are cut by content. Every window of LENGTH bytes has an anchor: the
K-gram in it with the smallest digest. Consecutive windows of one anchor are a
run. Equal windows have equal anchors, so a run needs to be compared only with
runs of the same anchor, and anchors that occur once drop out. Runs that are
equal as a whole are settled by their digests, in order; each different run goes
with its bytes into the shard of its anchor. There a suffix array over all runs
is built by prefix doubling that only touches unsettled groups (Larsson and
Sadakane), and neighbours whose common prefix reaches LENGTH are equal windows.
The common prefixes are taken word by word for all neighbours at once, where
Kasai's pass would go byte by byte. A frequent anchor is dealt over several
shards; their distinct windows, in sorted runs, are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerleaf.llm.common import stored
from ledgerleaf.llm.shingles import finish

LENGTH = 100
K = 32
SPAN = LENGTH - K + 1  # K-grams in a window
#: Bytes that are scanned at once; places in them fit 20 bits.
SLICE = 1 << 20
#: Runs of one anchor in one shard at most; more are dealt over several.
SHARD_RUNS = 8_000
#: Bytes of one suffix array, about.
SHARD_BYTES = 1 << 20

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_PLACE = np.uint64((1 << 20) - 1)


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, big-endian, zeros past the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data) + 8, np.uint64)
    for off in range(8):
        part = padded[off:off + (len(data) + 8 - off + 7) // 8 * 8]
        part = part[:len(part) // 8 * 8].view(">u8")
        own = out[off::8]
        own[:] = part[:len(own)] if len(part) >= len(own) else np.append(part, np.zeros(len(own) - len(part), np.uint64))
    return out[:len(data)]


def find_runs(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of the windows of texts laid end to end (each ends at one of ``ends``).

    ``first``, ``last``: starts of a run's windows; ``anchor``: digest of its
    K-gram; ``shift``: place of the K-gram in the first window; ``whole``: digest of the run.
    """
    empty = {c: np.empty(0, np.uint64 if c in ("anchor", "whole") else np.int64) for c in ("first", "last", "anchor", "shift", "whole")}
    n = len(data) - LENGTH + 1
    if n <= 0:
        return empty
    loads = _loads(data)
    grams = len(data) - K + 1
    digest = np.zeros(grams, np.uint64)
    for j, c in enumerate(_C):
        digest += loads[8 * j:8 * j + grams] * c
        digest ^= digest >> np.uint64(29)
    digest = finish(digest)
    low = (digest & ~_PLACE) | np.arange(grams, dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[SPAN - width:SPAN - width + n])
    at = (low & _PLACE).astype(np.int64)
    # Windows that reach over a text's end are none.
    owner = np.searchsorted(ends, np.arange(n), side="right")
    valid = np.arange(n) + LENGTH <= ends[owner]
    begin = valid.copy()
    begin[1:] &= (at[1:] != at[:-1]) | ~valid[:-1] | (owner[1:] != owner[:-1])
    first = np.flatnonzero(begin)
    if not len(first):
        return empty
    stop = np.append(first[1:], n)
    # A run ends before the next begins or where windows stop being valid.
    bad = np.flatnonzero(~valid)
    if len(bad):
        following = np.searchsorted(bad, first)
        stop = np.minimum(stop, np.where(following < len(bad), bad[np.minimum(following, len(bad) - 1)], n))
    last = stop - 1
    place = at[first]
    power = np.cumprod(np.full(len(data), _C[0]))
    inverse = np.cumprod(np.full(len(data), np.uint64(pow(int(_C[0]), -1, 1 << 64))))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(finish(data.astype(np.uint64) + np.uint64(1)) * power)])
    shift = place - first
    whole = (sums[last + LENGTH] - sums[first]) * inverse[first]
    whole = finish(whole + (last - first).astype(np.uint64) * _C[1] + shift.astype(np.uint64) * _C[2])
    return {"first": first, "last": last, "anchor": digest[place], "shift": shift, "whole": whole}


def _texts(batch: pa.RecordBatch) -> list[memoryview]:
    column = batch.column("text").fill_null("").cast(pa.large_binary())
    return [memoryview(x.as_buffer()) for x in column]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> anchor, whole, key, first, windows."""

    def scan(parts):
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        sizes = np.array([len(p) for _, _, p in parts])
        ends = np.cumsum(sizes)
        found = find_runs(data, ends)
        of = np.searchsorted(ends, found["first"], side="right")
        keys = np.array([k for k, _, _ in parts], np.int64)
        moved = np.array([o for _, o, _ in parts], np.int64) - (ends - sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array(found["anchor"].view(np.int64)), pa.array(found["whole"].view(np.int64)), pa.array(keys[of]),
             pa.array(found["first"] + moved[of]), pa.array((found["last"] - found["first"] + 1).astype(np.int32))],
            ["anchor", "whole", "key", "first", "windows"],
        )

    for batch in batches:
        parts, size = [], 0
        for key, text in zip(batch.column("key").to_pylist(), _texts(batch)):
            if len(text) < LENGTH:
                continue
            # A longer text is cut into slices that share all but one byte of a window.
            for at in range(0, len(text) - LENGTH + 1, SLICE - LENGTH + 1):
                piece = text[at:at + SLICE]
                if parts and size + len(piece) > SLICE:
                    yield scan(parts)
                    parts, size = [], 0
                parts.append((key, at, piece))
                size += len(piece)
        if parts:
            yield scan(parts)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by anchor, whole, key, first -> runs that occur earlier as a whole (``again``), and of
    anchors with different runs the first of each. All else is unique and drops out.

    Of the anchor that a batch ends with, one row is held: its last different run.
    """
    held, several = None, False  # several: the held row's anchor has other runs, and the row has been given
    for batch in batches:
        columns = [np.asarray(batch.column(c)) for c in ("anchor", "whole", "key", "first", "windows")]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.append(h, c) for h, c in zip(held, columns)]
        anchor, whole = columns[:2]
        same = anchor[1:] == anchor[:-1]
        again = np.append(False, same & (whole[1:] == whole[:-1]))
        group = np.cumsum(np.append(False, ~same))
        kinds = np.bincount(group, weights=~again)
        kinds[0] += several
        keep = again | (kinds[group] > 1)
        keep[0] &= not several
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[keep]), *(pa.array(c[keep]) for c in columns[2:]), pa.array(again[keep])], ["anchor", "key", "first", "windows", "again"]
        )
        last = int(np.flatnonzero(~again)[-1])
        held, several = [c[last:last + 1] for c in columns], bool(kinds[-1] > 1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with runs to compare -> one row for each run, with its bytes."""
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for key, text, runs in zip(batch.column("key").to_pylist(), _texts(batch), batch.column("open").to_pylist()):
            for run in runs:
                piece = bytes(text[run["first"]:run["first"] + run["windows"] + LENGTH - 1])
                out.append((run["anchor"], run["part"], key, run["first"], piece))
                size += len(piece)
            if size > 2 << 20:
                yield _rows(out)
                out, size = [], 0
        if out:
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["anchor", "part", "key", "first", "piece"])


def equal_windows(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers for the windows of ``data`` at ``starts``: equal for equal windows, in their order.

    Suffix array by prefix doubling: places are sorted by their first 8 bytes,
    then groups that are not settled by the rank 8, 16, 32 places on, until
    64 bytes are ranked; two of these ranks, overlapping, order LENGTH bytes.
    """
    n = len(data)
    needed = np.zeros(n + 1, np.int32)
    np.add.at(needed, starts, 1)
    np.add.at(needed, np.minimum(starts + LENGTH - 7, n), -1)
    places = np.flatnonzero(np.cumsum(needed[:n]) > 0)
    loads = _loads(data)[places]
    order = np.argsort(loads, kind="stable")
    ranked = loads[order]
    rank = np.zeros(n + LENGTH, np.int64)

    def number(order: np.ndarray, differs: np.ndarray, base: np.ndarray) -> None:
        """Rank of a place: where its group begins in the order."""
        heads = np.flatnonzero(differs)
        rank[places[order]] = np.repeat(base[heads], np.diff(np.append(heads, len(order))))

    differs = np.ones(len(order), bool)
    differs[1:] = ranked[1:] != ranked[:-1]
    position = np.arange(len(order))
    number(order, differs, position)
    for step in (8, 16, 32, LENGTH - 64):
        sizes = np.diff(np.append(np.flatnonzero(differs), len(order)))
        loose = np.repeat(sizes > 1, sizes)
        if not loose.any():
            break
        # Only groups of more than one place are sorted on.
        at = position[loose]
        own = order[loose]
        first, second = rank[places[own]], rank[places[own] + step]
        again = np.lexsort((second, first))
        own, first, second = own[again], first[again], second[again]
        order[at] = own
        split = np.ones(len(own), bool)
        split[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        differs[at] = split
        number(order, differs, position)
    # The common prefix of neighbours decides, word by word: equal windows are those that share LENGTH bytes.
    window = np.zeros(n, bool)
    window[starts] = True
    sorted_places = places[order]
    sorted_places = sorted_places[window[sorted_places]]
    words = np.concatenate([_loads(data), np.zeros(LENGTH, np.uint64)])
    same = np.ones(max(0, len(sorted_places) - 1), bool)
    for off in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        live = np.flatnonzero(same)
        same[live] = words[sorted_places[live] + off] == words[sorted_places[live + 1] + off]
    numbers = np.empty(n, np.int64)
    numbers[sorted_places] = np.concatenate([[0], np.cumsum(~same)]) if len(sorted_places) else []
    return numbers[starts]


def _windows(piece: list[bytes], key: np.ndarray, first: np.ndarray):
    """All windows of the pieces: places in the joined bytes, key and start of each."""
    sizes = np.fromiter(map(len, piece), np.int64, len(piece))
    counts = sizes - LENGTH + 1
    begin = np.cumsum(sizes) - sizes
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(begin, counts) + step, np.repeat(key, counts), np.repeat(first, counts) + step


def _spans(key: np.ndarray, start: np.ndarray) -> pa.Table:
    """Windows to remove -> key, first, last of runs of consecutive starts."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(key))[:len(heads)] - 1
    return pa.table({"key": pa.array(key[heads], pa.int64()), "first": pa.array(start[heads], pa.int64()), "last": pa.array(start[tails], pa.int64())})


def _first_of_each(data: np.ndarray, place: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Mask of the windows that no equal window of the shard comes before."""
    number = equal_windows(data, place)
    order = np.lexsort((start, key, number))
    first = np.ones(len(order), bool)
    first[1:] = number[order][1:] != number[order][:-1]
    mask = np.zeros(len(order), bool)
    mask[order[first]] = True
    return mask


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by shard (anchor, part) -> windows that occur earlier in their shard, as spans; of dealt
    anchors also each distinct window (``window``, its bytes) that is first in its shard."""
    pending: list[pa.RecordBatch] = []
    size = 0

    def solve(table: pa.Table):
        table = table.combine_chunks()
        piece = table.column("piece").to_pylist()
        if not piece:
            return
        anchor, part, key, first = (np.asarray(table.column(c)) for c in ("anchor", "part", "key", "first"))
        # Shards of several anchors make one array; only equal anchors have equal windows of the same place in their run.
        data = np.frombuffer(b"".join(piece), np.uint8)
        place, keys, starts = _windows(piece, key, first)
        counts = np.fromiter(map(len, piece), np.int64, len(piece)) - LENGTH + 1
        parts, anchors = np.repeat(part, counts), np.repeat(anchor, counts)
        for own in np.unique(parts).tolist():
            mine = np.flatnonzero(parts == own)
            is_first = _first_of_each(data, place[mine], keys[mine], starts[mine])
            again = mine[~is_first]
            spans = _spans(keys[again], starts[again])
            n = spans.num_rows
            yield _shard_rows(spans.column("key"), spans.column("first"), spans.column("last"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()))
            if own >= 0:
                out = mine[is_first]
                for some in np.array_split(out, max(1, len(out) // 50_000)):
                    windows = [data[p:p + LENGTH].tobytes() for p in place[some].tolist()]
                    yield _shard_rows(pa.array(keys[some]), pa.array(starts[some]), pa.array(starts[some]), pa.array(anchors[some]), pa.array(windows, pa.binary()))

    def shards_of(batch):
        return np.asarray(batch.column("anchor")), np.asarray(batch.column("part"))

    for batch in batches:
        if not batch.num_rows:
            continue
        pending.append(batch)
        size += batch.nbytes
        if size < SHARD_BYTES:
            continue
        table = pa.Table.from_batches(pending)
        a, p = (np.asarray(table.column(c)) for c in ("anchor", "part"))
        ends = np.flatnonzero((a[1:] != a[:-1]) | (p[1:] != p[:-1])) + 1
        if len(ends):
            # What is complete is solved; the last shard may go on.
            cut = int(ends[-1])
            yield from solve(table.slice(0, cut))
            table = table.slice(cut)
            pending = table.combine_chunks().to_batches()
            size = table.nbytes
    if pending:
        yield from solve(pa.Table.from_batches(pending))


def _shard_rows(key, first, last, anchor, window) -> pa.RecordBatch:
    flat = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (key, first, last, anchor, window)]
    return pa.RecordBatch.from_arrays(flat, ["key", "first", "last", "anchor", "window"])


def _merge(group: pa.Table) -> pa.Table:
    """Windows of one anchor and range, from several shards -> those that come earlier in another shard.

    Each shard's windows are a sorted run; runs are merged one after the other by binary search.
    """
    part, key, first = (np.asarray(group.column(c)) for c in ("part", "key", "first"))
    raw = np.frombuffer(b"".join(group.column("window").to_pylist()), np.uint8).reshape(-1, LENGTH)
    # Two digests stand for a window: one to sort and search by, one to confirm.
    code = np.zeros(len(raw), np.uint64)
    check = np.zeros(len(raw), np.uint64)
    for j in range(LENGTH):
        code = code * _C[0] + raw[:, j] + np.uint64(1)
        check = check * _C[1] + raw[:, j] + np.uint64(1)
    code, check = finish(code), finish(check)
    seen = np.empty(0, np.uint64)
    best = np.empty(0, np.int64)  # row of the earliest window so far
    late = np.zeros(len(raw), bool)
    for own in np.unique(part).tolist():
        rows = np.flatnonzero(part == own)
        rows = rows[np.argsort(code[rows], kind="stable")]
        slot = np.searchsorted(seen, code[rows])
        hit = np.zeros(len(rows), bool)
        inside = slot < len(seen)
        hit[inside] = (seen[slot[inside]] == code[rows[inside]]) & (check[best[slot[inside]]] == check[rows[inside]])
        met, theirs = rows[hit], best[slot[hit]]
        earlier = (key[met] < key[theirs]) | ((key[met] == key[theirs]) & (first[met] < first[theirs]))
        late[np.where(earlier, theirs, met)] = True
        best[slot[hit]] = np.where(earlier, met, theirs)
        seen, best = np.insert(seen, slot[~hit], code[rows[~hit]]), np.insert(best, slot[~hit], rows[~hit])
    return _spans(key[late], first[late])


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text, spans (starts of removed windows) -> key, n_bytes, n_removed, n_spans, kept."""
    for batch in batches:
        sizes, removed, spans, kept = [], [], [], []
        for text, own in zip(_texts(batch), batch.column("spans").to_pylist()):
            cuts: list[list[int]] = []
            for span in sorted((s["first"], s["last"] + LENGTH) for s in own or []):
                if cuts and span[0] <= cuts[-1][1]:
                    cuts[-1][1] = max(cuts[-1][1], span[1])
                else:
                    cuts.append(list(span))
            rest, at = [], 0
            for begin, end in cuts:
                rest.append(text[at:begin])
                at = end
            rest.append(text[at:])
            sizes.append(len(text))
            removed.append(sum(e - b for b, e in cuts))
            spans.append(len(cuts))
            kept.append(b"".join(rest))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), *(pa.array(c, pa.int64()) for c in (sizes, removed, spans)), pa.array(kept, pa.large_binary()).cast(pa.binary())],
            ["key", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _results(batches):
        digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("kept")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(digests)], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(key, text) with distinct ordered keys -> key, first, last: starts of windows that also start earlier."""
    runs = keyed.mapInArrow(_runs, "anchor long, whole long, key long, first long, windows int")
    settled = stored(
        runs.repartition("anchor").sortWithinPartitions("anchor", "whole", "key", "first")
        .mapInArrow(_settle, "anchor long, key long, first long, windows int, again boolean"),
        "runs",
    )
    whole = settled.where("again").select("key", "first", (F.col("first") + F.col("windows") - 1).alias("last"))
    different = settled.where("NOT again")
    frequent = different.groupBy("anchor").count().where(F.col("count") > SHARD_RUNS)
    # -1: the anchor's only shard. Else the runs are dealt by document.
    dealt = different.join(frequent, "anchor", "left").withColumn(
        "part", F.when(F.col("count").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.ceil(F.col("count") / SHARD_RUNS)))
    )
    of_doc = dealt.groupBy("key").agg(F.collect_list(F.struct("anchor", "first", "windows", F.col("part").cast("int").alias("part"))).alias("open"))
    pieces = keyed.join(of_doc, "key").mapInArrow(_pieces, "anchor long, part int, key long, first long, piece binary")
    solved = stored(
        pieces.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "key", "first")
        .mapInArrow(_shard, "key long, first long, last long, anchor long, window binary"),
        "shards",
    )
    inside = solved.where("window IS NULL").select("key", "first", "last")
    # Ranges of windows by digest: as many as keep a merge as small as a shard.
    exported = solved.where("window IS NOT NULL").join(frequent, "anchor").select(
        "anchor", "key", "first", "window", F.pmod(F.xxhash64("key"), F.ceil(F.col("count") / SHARD_RUNS)).cast("int").alias("part"),
        F.pmod(F.xxhash64("window"), F.ceil(F.col("count") * SPAN / SHARD_RUNS)).cast("int").alias("range"),
    )
    across = exported.groupBy("anchor", "range").applyInArrow(_merge, "key long, first long, last long")
    return whole.union(inside).union(across)


def keyed_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents with ``key``, a number in document order, and (key, doc_id) where the id itself can't be it.

    Null ids come last. Rows equal in id and text are one document. Where ids
    are whole numbers without nulls and repetitions, they are the keys.
    """
    whole = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    counts = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("m")).first()
    unique = whole and counts["n"] == counts["m"] and docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    if unique:
        return docs.select(F.col("doc_id").cast("long").alias("key"), "text"), None
    from ledgerleaf.operators.ordering import number_rows

    tagged = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)).alias("t1"), F.xxhash64(F.coalesce("text", F.lit("")), F.lit(2)).alias("t2"))
    known = tagged.groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("rows"))
    numbered = stored(number_rows(known, [F.col("doc_id").asc_nulls_last(), F.col("t1"), F.col("t2")], "key"), "document-keys")
    matched = tagged.alias("d").join(
        numbered.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.t1") == F.col("k.t1")) & (F.col("d.t2") == F.col("k.t2"))
    )
    # Equal rows are one document here; their number brings them back.
    texts = matched.select("key", F.col("d.text").alias("text")).dropDuplicates(["key"])
    return texts, numbered.select("key", "doc_id", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy")).drop("copy")


def _cleaned(docs: DataFrame, run, fields: str) -> DataFrame:
    keyed, ids = keyed_documents(docs)
    spans = repeated_spans(keyed).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    done = keyed.join(spans, "key", "left").mapInArrow(run, f"key long, n_bytes long, n_removed long, n_spans long, {fields}")
    named = done.withColumn("doc_id", F.col("key").cast(docs.schema["doc_id"].dataType)) if ids is None else done.join(ids, "key")
    return named.select("doc_id", "n_bytes", "n_removed", "n_spans", fields.split(" ")[0])


def removal_report(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per row.

    A null text is empty. Rows equal in id and text are one document: they do
    not repeat each other and share one result; of a repeated id, texts are
    ordered by digest. An empty table gives an empty result.
    """
    return _cleaned(docs, _digested, "kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """As ``removal_report`` with the remaining bytes (``kept``) instead of their digest."""
    return _cleaned(docs, _results, "kept binary")
