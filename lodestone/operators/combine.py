"""One vector for many chunks of an item: coverage of meaning, with the share of what says the same damped.

An item's vectors meet in one Arrow group; items are as large as documents, not as the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpaceMismatchError, VectorFormatError
from ..options import CombineOptions
from ..schema import Mass
from . import reduce as R

DEGENERATE = 1e-3


@dataclass(frozen=True)
class Combined:
    vector: np.ndarray
    mass: np.ndarray
    mass_method: int
    coherence: float
    min_similarity: float
    medoid: bool
    source_tokens: float


def range_mass(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The tokens of each range, where those that several ranges cover are shared equally."""
    ends = starts + lengths
    cuts = np.unique(np.concatenate((starts, ends)))
    mass = np.zeros(len(starts))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        over = (starts <= a) & (ends >= b)
        if over.any():
            mass[over] += (b - a) / over.sum()
    return mass


def source_mass(document_tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, int]:
    total = document_tokens[0] if len(document_tokens) else 0
    if total > 0 and (document_tokens == total).all() and (starts >= 0).all() and (lengths > 0).all() and (starts + lengths <= total).all():
        return range_mass(starts, lengths), int(Mass.RANGE_COVERAGE)
    return tokens.astype(np.float64), int(Mass.TOKEN_COUNT)


def combine(vectors: np.ndarray, mass: np.ndarray, method: int = Mass.TOKEN_COUNT, baseline: float = 0.0) -> Combined:
    """Vectors of one space with their masses."""
    x = np.asarray(vectors, dtype=np.float64)
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    if (norms == 0).any():
        raise VectorFormatError("a zero vector has no direction")
    unit = x / norms
    cos = unit @ unit.T
    affinity = np.clip((cos - baseline) / (1 - baseline), 0, 1) ** 4
    np.fill_diagonal(affinity, 1.0)
    density = affinity @ mass
    weight = np.divide(mass, np.sqrt(density), out=np.zeros(len(mass)), where=(mass > 0) & (density > 0))
    if weight.sum() <= 0:
        weight = np.ones(len(mass))
    v = weight @ unit
    length = float(np.sqrt((v * v).sum()))
    coherence = length / float(weight.sum())
    medoid = coherence < DEGENERATE
    out = unit[int(np.argmax(cos @ weight))] if medoid else v / length
    return Combined(out.astype(np.float32), mass, int(method), coherence, float((unit @ out).min()), medoid, float(mass.sum()))


SCHEMA = "item {kind}, vector array<float>, fingerprint string, source_count int, source_tokens double, mass_method int, coherence double, min_similarity double, medoid boolean"


def combine_items(chunks: DataFrame, options: CombineOptions | None = None) -> DataFrame:
    """A row an item of chunks (item, vector, fingerprint, tokens, document_tokens, start, length).

    One chunk alone passes as it is; different spaces or dimensions in an item are an error.
    """
    options = options or CombineOptions()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "length", "tokens"], kind="stable")
        if pdf["fingerprint"].nunique(dropna=False) > 1 or pdf["vector"].map(len).nunique() > 1:
            raise SpaceMismatchError(f"item {pdf['item'].iloc[0]} has vectors of different spaces")
        x = np.stack(pdf["vector"].to_list())
        mass, method = source_mass(*(pdf[c].fillna(-1).to_numpy(dtype=np.float64) for c in ("document_tokens", "start", "length")), pdf["tokens"].fillna(0).to_numpy(dtype=np.float64))
        made = combine(x, mass, method, options.baseline) if len(x) > 1 else Combined(x[0], mass, method, 1.0, 1.0, False, float(mass.sum()))
        vector, space = made.vector, pdf["fingerprint"].iloc[0]
        if options.dimensions and options.dimensions != len(vector):
            space = R.child_fingerprint(space, len(vector), options.dimensions)
            vector = R.reduce_rows(vector[None, :], options.dimensions)[0]
        return pd.DataFrame({"item": [pdf["item"].iloc[0]], "vector": [vector], "fingerprint": [space], "source_count": [len(x)], "source_tokens": [made.source_tokens], "mass_method": [made.mass_method], "coherence": [made.coherence], "min_similarity": [made.min_similarity], "medoid": [made.medoid]})

    cols = ["item", "vector", "fingerprint", "tokens", "document_tokens", "start", "length"]
    return chunks.select(*cols).groupBy("item").applyInPandas(run, SCHEMA.format(kind=dict(chunks.dtypes)["item"]))


def range_mass_rows(chunks: DataFrame) -> DataFrame:
    """item, chunk, mass: range_mass() as a sweep in SQL, for chunks (item, chunk, start, length)."""
    from pyspark.sql import Window

    ends = chunks.select("item", "chunk", F.col("start").alias("a"), (F.col("start") + F.col("length")).alias("b"))
    cuts = ends.select("item", F.explode(F.array("a", "b")).alias("at")).distinct()
    segments = cuts.withColumn("to", F.lead("at").over(Window.partitionBy("item").orderBy("at"))).where(F.col("to").isNotNull())
    covered = segments.join(ends, "item").where((F.col("a") <= F.col("at")) & (F.col("b") >= F.col("to")))
    shared = covered.withColumn("n", F.count("*").over(Window.partitionBy("item", "at")))
    return shared.groupBy("item", "chunk").agg(F.sum((F.col("to") - F.col("at")) / F.col("n")).alias("mass"))


def densities(chunks: DataFrame, baseline: float = 0.0) -> DataFrame:
    """item, chunk, density, weight: the pairwise part in SQL, for chunks (item, chunk, vector, mass) of an item."""
    from ..functions.vectors import cosine

    a = chunks.select("item", F.col("chunk").alias("chunk"), F.col("vector").alias("x"), F.col("mass").alias("mass"))
    b = chunks.select("item", F.col("chunk").alias("other"), F.col("vector").alias("y"), F.col("mass").alias("m"))
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(F.col("x"), F.col("y")) - baseline) / (1 - baseline)))
    affinity = F.when(F.col("chunk") == F.col("other"), F.lit(1.0)).otherwise(F.pow(r, 4))
    out = a.join(b, "item").groupBy("item", "chunk", "mass").agg(F.sum(F.col("m") * affinity).alias("density"))
    return out.withColumn("weight", F.when(F.col("mass") > 0, F.col("mass") / F.sqrt("density")).otherwise(0.0))
