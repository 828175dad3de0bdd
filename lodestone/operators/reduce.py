"""Dimension reduction by a subsampled randomised Hadamard transform, and the space it leads to.

Signs and chosen coordinates follow from SHA-256 of names, so every worker and every run agree. A
transform of d dimensions costs d log d, in numpy over Arrow batches.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OptionError, VectorFormatError

PREFIX = "lodestone"
PROFILE = "srht-v1"


def key64(domain: str, dimensions: int, index: int, prefix: str = PREFIX) -> int:
    """The first 8 bytes, little-endian, of the hash of a name."""
    name = f"{prefix}|{PROFILE}|{domain}|{dimensions}|{index}"
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little")


@lru_cache(maxsize=16)
def profile(dimensions: int, output: int, prefix: str = PREFIX) -> tuple[np.ndarray, np.ndarray, int]:
    """(signs of the inputs, chosen coordinates, padded size)."""
    if not 0 < output <= dimensions:
        raise OptionError("a reduction has at least one dimension and never more than before")
    size = 1 << (dimensions - 1).bit_length()
    signs = np.array([-1.0 if key64("sign", dimensions, i, prefix) & 1 else 1.0 for i in range(dimensions)])
    keys = sorted(range(size), key=lambda i: (key64("coordinate", dimensions, i, prefix), i))
    return signs, np.array(keys[:output]), size


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised transform of rows, whose length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def reduce_rows(x: np.ndarray, output: int, prefix: str = PREFIX) -> np.ndarray:
    """Unit float32 rows of `output` dimensions; the input itself, normalised, where nothing is to be reduced."""
    x = np.asarray(x, dtype=np.float64)
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    if (norms == 0).any() or not np.isfinite(norms).all():
        raise VectorFormatError("a zero or non-finite vector has no direction")
    x = (x / norms).astype(np.float32)
    if output == x.shape[1]:
        return x
    signs, chosen, size = profile(x.shape[1], output, prefix)
    work = np.zeros((len(x), size))
    work[:, : x.shape[1]] = x * signs
    y = (hadamard(work)[:, chosen] / np.sqrt(size)).astype(np.float32)
    return (y / np.sqrt((y.astype(np.float64) ** 2).sum(axis=1, keepdims=True))).astype(np.float32)


def reduce_udf(output: int, prefix: str = PREFIX):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(vectors: pd.Series) -> pd.Series:
        there = vectors[vectors.notna()]
        out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
        sizes = there.map(len)
        for d in sizes.unique():
            part = there[sizes == d]
            for i, row in zip(part.index, reduce_rows(np.stack(part.to_list()), output, prefix), strict=True):
                out.at[i] = row
        return out

    return run


def child_fingerprint(parent: str, dimensions: int, output: int, prefix: str = PREFIX) -> str:
    """The space after a reduction; the number format of vectors doesn't matter to it."""
    return hashlib.sha256(f"{prefix}|reduce|{parent}|{PROFILE}|{dimensions}|{output}".encode()).hexdigest()


def reduce_dimensions(rows: DataFrame, vector: str, fingerprint: str, output: int, prefix: str = PREFIX) -> DataFrame:
    """rows with reduced vectors and the fingerprint of their space; rows of `output` dimensions stay as they are."""
    size = F.size(vector)
    child = F.sha2(F.concat_ws("|", F.lit(prefix), F.lit("reduce"), F.col(fingerprint), F.lit(PROFILE), size.cast("string"), F.lit(str(output))), 256)
    enough = F.when(size >= output, F.col(vector)).otherwise(F.raise_error("a vector isn't expanded").cast("array<float>"))
    return rows.withColumn(fingerprint, F.when(size == output, F.col(fingerprint)).otherwise(child)).withColumn(vector, F.when(size == output, F.col(vector)).otherwise(reduce_udf(output, prefix)(enough)))


def to_limited_space(rows: DataFrame, vector: str, fingerprint: str, dimensions: int, limit: int = 1998) -> DataFrame:
    """Vectors fit for a store with a limit of dimensions."""
    return reduce_dimensions(rows, vector, fingerprint, min(dimensions, limit))
