"""Reciprocal rank fusion of ranked lists: one union and one aggregation by key."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PlanError
from ..options import FusionOptions


@dataclass(frozen=True)
class Ranking:
    """A stage's result: rows (key, score), best first by score and then key, or by a rank column they have already."""

    name: str
    rows: DataFrame
    weight: float = 1.0


def ranked(r: Ranking) -> DataFrame:
    """key, rank, score; a key that comes again keeps its first place, and the places behind it stay as they are."""
    rows = r.rows
    if "rank" not in rows.columns:
        rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "key")))  # a stage's rows are bounded by its candidates
    return rows.groupBy("key").agg(F.min(F.struct("rank", "score")).alias("x")).select("key", "x.rank", "x.score")


def fuse(rankings: list[Ranking], options: FusionOptions | None = None) -> DataFrame:
    """key, score, first_stage, first_rank, contributions array<struct<part,stage,rank,score>>, best part first."""
    options = options or FusionOptions()
    if not rankings:
        raise PlanError("nothing to fuse")
    if len({r.name for r in rankings}) != len(rankings):
        raise PlanError("stages need names of their own")
    parts = []
    for i, r in enumerate(rankings):
        if r.weight < 0:
            raise PlanError("a stage weight is negative")
        part = F.lit(float(r.weight)) / (F.lit(float(options.rank_constant)) + F.col("rank"))
        parts.append(ranked(r).select("key", F.lit(i).alias("stage_index"), F.lit(r.name).alias("stage"), F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("raw"), part.alias("part")))
    all_ = reduce(DataFrame.unionByName, parts)
    out = all_.groupBy("key").agg(
        F.sum("part").alias("score"),
        F.min(F.struct("stage_index", "rank")).alias("first"),
        F.sort_array(F.collect_list(F.struct("part", "stage", "rank", F.col("raw").alias("score"))), asc=False).alias("contributions"),
    )
    return out.select("key", "score", F.col("first.stage_index").alias("first_stage"), F.col("first.rank").alias("first_rank"), "contributions")


def top(fused: DataFrame, n: int) -> DataFrame:
    return fused.orderBy(F.col("score").desc(), "first_stage", "first_rank").limit(n)
