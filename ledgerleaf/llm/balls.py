"""Vector codes by ball k-means: each part of a vector is replaced by its nearest codebook entry.

Components become whole numbers, so every distance and mean is exact. A vector
is cut into equal parts; each part position has a codebook of its own. The
parts of an entry form its ball. With D the squared distance of two entries and
r the ball's radius, another entry can only win a part of the ball where
D <= 4 r^2: those are the ball's neighbours, in order of D. A part at squared
distance d from its entry needs only the neighbours with D <= 4 d:

* none of them: the part lies in the stable core and nothing is compared;
* else it lies in a ring, found by bisection, and is compared with the nearest
  neighbours up to that ring. Balls that did not move, nor their neighbours,
  are settled and skipped.

A radius is known from the last assignment plus how far the entry moved since,
so no pass is spent on it. Each pass is one scan: tasks assign their rows, write
them with their codes, and add one row of sums for each entry they used; a round
gathers ``parts * entries`` rows, whatever the table's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerleaf.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components must stay below this in size, so that sums of squares fit in 64 bits.
LARGEST = float(1 << 20)
BLOCK_ROWS = 4096
#: Sums of labels are broadcast up to so many rows (some 20 bytes each).
BROADCAST_LABELS = 200_000
FAR = np.iinfo(np.int64).max


class Balls(NamedTuple):
    centers: np.ndarray  # parts, entries, components
    nearest: np.ndarray  # of each entry: the others, nearest first
    rings: np.ndarray  # of each entry: their squared distances; FAR where no part of the ball can care


class Codes(NamedTuple):
    rows: DataFrame  # vec_id, label, code, error
    codebooks: np.ndarray  # parts, entries, components


def _root_above(square: int) -> int:
    return 0 if square <= 0 else math.isqrt(square - 1) + 1


def balls_of(centers: np.ndarray, reach: np.ndarray, shift: np.ndarray) -> Balls:
    """Neighbours of every ball. ``reach``: squared radius before the entries moved by ``shift`` (squared)."""
    parts, entries, _ = centers.shape
    nearest = np.zeros((parts, entries, max(entries - 1, 1)), np.int64)
    rings = np.full(nearest.shape, FAR)
    for p in range(parts):
        apart = ((centers[p][:, None, :] - centers[p][None, :, :]) ** 2).sum(-1)
        for e in range(entries):
            order = np.argsort(apart[e], kind="stable")
            order = order[order != e]
            near = apart[e][order]
            limit = 4 * (_root_above(int(reach[p, e])) + _root_above(int(shift[p, e]))) ** 2
            among = near <= limit
            settled = not shift[p, e] and not shift[p, order[among]].any()
            nearest[p, e, : len(order)] = order
            if not settled:
                rings[p, e, : len(order)] = np.where(among, near, FAR)
    return Balls(centers, nearest, rings)


def assign_all(parts: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First assignment of one part position: (entry, squared distance), ties to the lower entry."""
    apart = np.zeros((len(parts), len(centers)), np.int64)
    for k in range(parts.shape[1]):
        apart += (parts[:, k, None] - centers[None, :, k]) ** 2
    entry = apart.argmin(1)
    return entry, apart[np.arange(len(parts)), entry]


def assign_near(parts: np.ndarray, entry: np.ndarray, balls: Balls, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Assignment of part position ``p`` from the last one: cores stay, rings are compared."""
    centers, nearest, rings = balls.centers[p], balls.nearest[p], balls.rings[p]
    apart = ((parts - centers[entry]) ** 2).sum(1)
    ring = np.flatnonzero(rings[entry, 0] <= 4 * apart)
    if not len(ring):
        return entry, apart
    own, bound = entry[ring], 4 * apart[ring]
    low, high = np.ones(len(ring), np.int64), np.full(len(ring), rings.shape[1])
    while (open_ := low < high).any():
        middle = (low + high) // 2
        inside = open_ & (rings[own, np.minimum(middle, rings.shape[1] - 1)] <= bound)
        low, high = np.where(inside, middle + 1, low), np.where(open_ & ~inside, middle, high)
    # One row for each (part, candidate).
    firsts = np.cumsum(low) - low
    of = np.repeat(np.arange(len(ring)), low)
    candidate = nearest[own[of], np.arange(len(of)) - firsts[of]]
    found = ((parts[ring[of]] - centers[candidate]) ** 2).sum(1)
    least = np.minimum.reduceat(found, firsts)
    first = np.minimum.reduceat(np.where(found == least[of], candidate, FAR), firsts)
    better = (least < apart[ring]) | ((least == apart[ring]) & (first < own))
    entry, at = entry.copy(), ring[better]
    entry[at], apart[at] = first[better], least[better]
    return entry, apart


def _binary(codes: np.ndarray) -> pa.Array:
    n, width = codes.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(codes).tobytes())])


_SUMS = "part int, entry int, members long, sums array<long>, reach long"


def _pass(book: np.ndarray | Balls, schema: T.StructType, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Assigns every row; unless it is the last pass, adds the sums of the entries."""
    balls = book if isinstance(book, Balls) else None
    centers = balls.centers if balls else book
    parts, entries, width = centers.shape
    names = [f.name for f in schema.fields]
    kinds = pa.schema([(n, pa.int64() if n == "error" else pa.binary()) for n in ("code", "error")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = np.zeros((parts, entries), np.int64)
        sums, reach = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        sample: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sample = batch
            vectors = np.asarray(batch.column("x").flatten()).reshape(-1, parts, width).astype(np.int64)
            before = None
            if balls:
                before = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            codes, error = np.empty((len(vectors), parts), np.uint8), np.zeros(len(vectors), np.int64)
            for at in range(0, len(vectors), BLOCK_ROWS):
                rows = slice(at, at + BLOCK_ROWS)
                for p in range(parts):
                    x = vectors[rows, p]
                    entry, apart = assign_near(x, before[rows, p].astype(np.int64), balls, p) if balls else assign_all(x, centers[p])
                    codes[rows, p] = entry
                    error[rows] += apart
                    if not last:
                        members[p] += np.bincount(entry, minlength=entries)
                        for k in range(width):  # exact: far below 2^53 for one block
                            sums[p, :, k] += np.bincount(entry, weights=x[:, k], minlength=entries).astype(np.int64)
                        np.maximum.at(reach[p], entry, apart)
            made = {"code": _binary(codes), "error": pa.array(error)}
            nulls = lambda n: pa.nulls(batch.num_rows, _arrow_of(n))
            yield pa.RecordBatch.from_arrays(
                [made[n] if n in kinds.names else batch.column(n) if n in batch.schema.names else nulls(n) for n in names], names
            )
        if last or sample is None:
            return
        part, entry = np.nonzero(members)
        put = {
            "part": pa.array(part.astype(np.int32)), "entry": pa.array(entry.astype(np.int32)), "members": pa.array(members[part, entry]),
            "sums": pa.array(sums[part, entry].tolist(), pa.list_(pa.int64())), "reach": pa.array(reach[part, entry]),
        }
        kind = lambda n: kinds.field(n).type if n in kinds.names else sample.schema.field(n).type
        yield pa.RecordBatch.from_arrays([put[n] if n in put else pa.nulls(len(part), kind(n)) for n in names], names)

    return run


def _arrow_of(name: str) -> pa.DataType:
    return {"part": pa.int32(), "entry": pa.int32(), "sums": pa.list_(pa.int64())}.get(name, pa.int64())


def _moved(assigned: DataFrame, centers: np.ndarray) -> Balls:
    """The codebooks after a round: floors of the means; entries without parts stay."""
    width = centers.shape[2]
    sums = (
        assigned.where("part is not null").groupBy("part", "entry")
        .agg(F.sum("members").alias("n"), F.max("reach").alias("reach"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)))
    )
    new, reach = centers.copy(), np.zeros(centers.shape[:2], np.int64)
    for row in sums.collect():  # at most parts * entries rows
        new[row["part"], row["entry"]] = [row[f"s{k}"] // row["n"] for k in range(width)]
        reach[row["part"], row["entry"]] = row["reach"]
    return balls_of(new, reach, ((new - centers) ** 2).sum(-1))


def whole_components(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """vec_id, label, x: components as floor(scale * component); vectors that can't take part are left out."""
    fit = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < LARGEST))
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("int"))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & fit).select("vec_id", "label", x.alias("x"))


def ball_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """(vec_id, embedding, label) -> codes and error of every vector that takes part, and the codebooks.

    Left out: vectors that are null, empty, hold a null or non-finite component
    or one of 2^20 or more in size, or whose length is not a multiple of
    ``parts`` or not that of the vector with the smallest vec_id. Codebooks begin
    as the parts of the ``entries`` smallest vec_ids (null last, repeated ids in
    the order of their vectors; every row counts), fewer if there are fewer rows.
    Ties go to the lower entry. Repeated rows and null ids or labels are handed
    through, other columns are not read. An empty table gives no rows and empty
    codebooks. ``code`` has one byte for each part, so ``entries`` <= 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: entries must be in 1..256")
    spark = vectors.sparkSession
    rows = stored(whole_components(vectors, parts, scale), "whole-vectors")
    order = [F.col("vec_id").asc_nulls_last(), F.size("x"), F.col("x")]
    first = rows.orderBy(*order).select("x").first()
    out = T.StructType([rows.schema["vec_id"], rows.schema["label"], *T.StructType.fromDDL("code binary, error long").fields])
    if first is None:
        return Codes(spark.createDataFrame([], out), np.zeros((parts, 0, 0), np.int64))
    length = len(first["x"])
    rows = rows.where(F.size("x") == length)
    seeds = [r["x"] for r in rows.orderBy(*order).select("x").limit(entries).collect()]  # the codebooks' size
    centers = np.array(seeds, np.int64).reshape(len(seeds), parts, length // parts).swapaxes(0, 1).copy()
    book: np.ndarray | Balls = centers
    carried = T.StructType([*rows.schema.fields, T.StructField("code", T.BinaryType()), *T.StructType.fromDDL(_SUMS).fields])
    for k in range(rounds):
        assigned = stored(rows.mapInArrow(_pass(book, carried, False), carried), f"ball-round-{k}")
        book = _moved(assigned, book.centers if isinstance(book, Balls) else book)
        rows = assigned.where("part is null").select("vec_id", "label", "x", "code")
    coded = stored(rows.mapInArrow(_pass(book, out, True), out), "ball-codes")
    return Codes(coded, book.centers if isinstance(book, Balls) else book)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error: the error summed over rows of the same label, null labels together."""
    label = coded.schema["label"].dataType
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    if sums.count() <= BROADCAST_LABELS and not isinstance(label, (T.StringType, T.BinaryType)):
        sums = F.broadcast(sums)
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).drop("of")
