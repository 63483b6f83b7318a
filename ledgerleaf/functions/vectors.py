"""Embeddings as arrays: parsing, checks, similarity, pooling and embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# A user's embedder: a batch of texts in, one vector per text out.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def parse_embedding(col: Column) -> Column:
    """JSON text ``"[0.1, 0.2]"`` -> ``array<float>``."""
    return F.from_json(col, F.lit("array<float>"))


def check_dimension(df: DataFrame, dim: int | None = None, col: str = "embedding") -> DataFrame:
    """Rows unchanged; reading them fails when a vector has another dimension.

    Without ``dim`` all vectors must agree, which takes one small aggregate.
    """
    size = F.size(col)
    if dim is None:
        seen = df.agg(F.min(size).alias("lo"), F.max(size).alias("hi")).first()
        if seen["lo"] != seen["hi"]:
            raise ValueError(f"embedding dimensions differ: {seen['lo']} to {seen['hi']}")
        return df
    message = F.concat(F.lit(f"embedding dimension is not {dim}: "), size.cast("string"))
    return df.withColumn(col, F.when(size == dim, F.col(col)).otherwise(F.raise_error(message)))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 when either vector is all zeros."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def mean_pool_normalize(token_vectors: Column, mask: Column) -> Column:
    """Masked mean over token vectors, scaled to length 1."""
    width = F.size(token_vectors[0])
    zero = F.transform(F.sequence(F.lit(1), width), lambda _i: F.lit(0.0))
    weighted = F.zip_with(
        token_vectors, mask, lambda vec, m: F.transform(vec, lambda x: x.cast("double") * m.cast("double"))
    )
    total = F.aggregate(weighted, zero, lambda acc, vec: F.zip_with(acc, vec, lambda x, y: x + y))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m.cast("double")), F.lit(1e-9))
    mean = F.transform(total, lambda x: x / count)
    length = F.greatest(F.sqrt(dot(mean, mean)), F.lit(1e-12))
    return F.transform(mean, lambda x: x / length)


def char_hash_embedder(dim: int = 32) -> Embedder:
    """Counts of ``(code point * 31) mod dim``: a deterministic built-in embedder."""

    def run(texts: Sequence[str]) -> np.ndarray:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        cell = np.repeat(np.arange(len(texts)) * dim, [len(t) for t in texts])
        cell += codes * np.uint32(31) % np.uint32(dim)
        counts = np.bincount(cell, minlength=len(texts) * dim)
        return counts.reshape(len(texts), dim).astype(np.float64)

    return run


def keyword_embedder(keywords: Sequence[str]) -> Embedder:
    """One dimension per keyword found, and a last one when none is."""

    def run(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            hits = [1.0 if word in text else 0.0 for word in keywords]
            out.append(hits + [0.0 if any(hits) else 1.0])
        return out

    return run


def embed(
    df: DataFrame, embedder: Embedder | None = None, text: str = "text", out: str = "embedding", batch: int = 8
) -> DataFrame:
    """Adds ``out`` (array<double>) by calling the embedder on batches of ``batch`` texts.

    The embedder is shipped once per task and fed Arrow arrays, so a model is
    loaded once per task, not once per row. It is a column, so plans that do not
    read the vectors do not compute them. The built-in embedder takes any batch.
    """
    if embedder is None:
        embedder, batch = char_hash_embedder(), 256

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def vectors(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            made = [pa.array([], pa.list_(pa.float64()))]
            # Only one batch of texts at a time is held as Python strings.
            for at in range(0, len(array), batch):
                texts = ["" if t is None else t for t in array.slice(at, batch).to_pylist()]
                found = embedder(texts)
                if isinstance(found, np.ndarray):
                    ends, flat = np.arange(len(found) + 1) * found.shape[1], found.astype(np.float64, copy=False).ravel()
                else:
                    found = [np.asarray(v, dtype=np.float64) for v in found]
                    ends, flat = np.cumsum([0, *map(len, found)]), np.concatenate(found)
                made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
            yield pa.concat_arrays(made)

    return df.withColumn(out, vectors(F.col(text)))
