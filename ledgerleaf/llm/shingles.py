"""Word shingles of texts as sorted arrays of 64-bit digests, computed batch-wise in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZE = 5
PART_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LAST = np.uint64(0x94D049BB133111EB)


def finish(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit digests."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _LAST
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words of the texts ``data[offsets[i]:offsets[i + 1]]``, and the words' texts."""
    solid = ~_BLANK[data]
    if not solid.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    begins = np.flatnonzero(starts)
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    lengths = np.flatnonzero(ends) + 1 - begins
    at = np.flatnonzero(solid)
    place = at - np.repeat(begins, lengths)
    factor = np.cumprod(np.full(int(lengths.max()), _STEP))
    values = finish(_LOWER[data[at]] + np.uint64(1)) * factor[place]
    firsts = np.cumsum(lengths) - lengths
    digests = finish(np.add.reduceat(values, firsts) + lengths.astype(np.uint64))
    return digests, np.searchsorted(offsets, begins, side="right") - 1


def shingle_sets(texts: pa.Array, size: int = SIZE) -> Iterator[np.ndarray]:
    """For every text, in order, its distinct shingles: sorted digests (unsigned).

    A text of fewer words is one shingle, one without words or null has none.
    A-Z count as a-z.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES, side="right")) - 1)
        own = offsets[at:upto + 1]
        digests, of = _words(data[own[0]:own[-1]], own - own[0])
        counts = np.bincount(of, minlength=upto - at) if len(of) else np.zeros(upto - at, np.int64)
        rolled = np.zeros(max(0, len(digests) - size + 1), np.uint64)
        for j in range(size):
            rolled = rolled * _STEP + digests[j:len(digests) - size + 1 + j] if len(rolled) else rolled
        rolled = finish(rolled)
        first = 0
        for n in counts.tolist():
            if n >= size:
                yield np.unique(rolled[first:first + n - size + 1])
            elif n:
                short = np.uint64(n)
                with np.errstate(over="ignore"):
                    for d in digests[first:first + n]:
                        short = short * _STEP + d
                yield finish(np.array([short]))
            else:
                yield np.empty(0, np.uint64)
            first += n
        at = upto
