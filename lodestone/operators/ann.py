"""Approximate preselection: an inverted file of cells around centroids, then exact scores.

Centroids are fitted on a bounded sample and broadcast; every row is put in its nearest cell. Written with
`partition_by_cell`, a search reads the folders of the cells it probes only. Exact search is semantic.candidates().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import OptionError
from ..functions import vectors as V
from .filters import Filter, is_simple
from .semantic import QueryVector


def fit(vectors: DataFrame, column: str, cells: int = 64, sample: int = 20_000, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Unit centroids by spherical k-means of at most `sample` vectors, chosen by hash."""
    if not 0 < cells <= 65_536:
        raise OptionError("cells are between 1 and 65536")
    rows = vectors.select(F.col(column).alias("v")).orderBy(F.xxhash64("v", F.lit(seed))).limit(sample).collect()
    x = np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    if not len(x):
        return np.zeros((0, 0))
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    c = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, of, x)
        norms = np.sqrt((new * new).sum(axis=1, keepdims=True))
        c = np.where(norms > 0, new / np.maximum(norms, 1e-12), c)
    return c


def assign(vectors: DataFrame, column: str, centroids: np.ndarray) -> DataFrame:
    """vectors with their cell."""

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        if not len(v) or not len(centroids):
            return pd.Series([0] * len(v), dtype="int32")
        return pd.Series((np.stack(v.to_list()).astype(np.float64) @ centroids.T).argmax(axis=1).astype("int32"))

    return vectors.withColumn("cell", cell(column))


def partition_by_cell(indexed: DataFrame, path: str) -> None:
    indexed.repartition("cell", F.pmod(F.xxhash64(*indexed.columns[:1]), F.lit(8))).write.partitionBy("cell").parquet(path)


def candidates(indexed: DataFrame, item: str, column: str, fingerprint: str, query: QueryVector, centroids: np.ndarray, budget: int, probes: int = 8) -> DataFrame:
    """The nearest rows among those of the `probes` nearest cells."""
    q = np.asarray(query.vector, dtype=np.float64)
    near = np.argsort(-(centroids @ q), kind="stable")[:probes].tolist() if len(centroids) else [0]
    rows = indexed.where(F.col("cell").isin(near) & (F.col(fingerprint) == query.fingerprint))
    return rows.withColumn("native_similarity", V.cosine_to(F.col(column), query.vector)).orderBy(F.col("native_similarity").desc(), item).limit(budget)


def strategy(where: Filter | None, extra_sql: str | None = None, fields: list[str] | None = None) -> str:
    """approximate where the filter is one that an index can take along, else exact."""
    return "approximate" if is_simple(where) and not extra_sql and len(fields or []) <= 1 else "exact"
