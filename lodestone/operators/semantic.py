"""Semantic retrieval: chunks scored against a query vector, their evidence joined by field and item.

Chunks are rows (item, field, weight, vector, tokens, capacity, fingerprint). A query vector is a literal
in the plan, so scoring is part of the scan; only the three best chunks of a field matter, which the
window's group limit cuts down to before the one exchange, by item.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import OptionError, SpaceMismatchError
from ..functions import vectors as V
from ..options import CandidateOptions, ScoringOptions, SemanticOptions
from .filters import Filter, condition, resolver


@dataclass(frozen=True)
class QueryVector:
    vector: tuple[float, ...]
    fingerprint: str

    @staticmethod
    def of(vector, fingerprint: str) -> QueryVector:
        return QueryVector(tuple(float(x) for x in np.asarray(vector, dtype=np.float32)), fingerprint)


@dataclass(frozen=True)
class Chunks:
    """Which columns of a table of chunks hold what; a name that is None stands for a constant."""

    item: str = "item"
    vector: str = "vector"
    field_name: str | None = None
    weight: str | None = None
    tokens: str | None = None
    capacity: str | None = None
    fingerprint: str | None = "fingerprint"
    chunk: str | None = None
    columns: dict[str, str] = field(default_factory=dict)  # logical filter fields

    def rows(self, table: DataFrame) -> DataFrame:
        def c(name: str | None, default: Column) -> Column:
            return F.col(name) if name else default

        return table.select(
            F.col(self.item).alias("item"),
            c(self.field_name, F.lit("content")).cast("string").alias("field"),
            c(self.weight, F.lit(1.0)).cast("double").alias("weight"),
            F.col(self.vector).alias("vector"),
            c(self.tokens, F.lit(0)).cast("long").alias("tokens"),
            c(self.capacity, F.lit(0)).cast("long").alias("capacity"),
            c(self.fingerprint, F.lit("")).alias("fingerprint"),
            c(self.chunk, F.lit(None).cast("long")).alias("chunk"),
        )


def confidence(tokens: Column, capacity: Column, o: ScoringOptions) -> Column:
    coverage = F.when(capacity <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tokens / F.when(capacity > 0, capacity))))
    return F.lit(o.min_length_confidence) + F.lit(1 - o.min_length_confidence) * F.sqrt(coverage)


def evidence(best: Column, second: Column, third: Column, o: ScoringOptions) -> Column:
    """The best of a list and what its next two add; those may be null."""

    def bonus(s: Column, w: float) -> Column:
        near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (best - s) / o.support_window))
        return F.coalesce((1 - best) * w * near * s, F.lit(0.0))

    return F.least(F.lit(1.0), best + bonus(second, o.second) + bonus(third, o.third))


def weighted(score: Column, weight: Column) -> Column:
    return 1 - F.pow(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), weight)


def check_space(fingerprint: Column, query: QueryVector) -> Column:
    """The fingerprint; an error at run time where it is another than the query's."""
    return F.when(fingerprint == query.fingerprint, fingerprint).otherwise(F.raise_error(F.concat(F.lit("embedding space "), fingerprint, F.lit(f" isn't the query's {query.fingerprint}"))).cast("string"))


def chunk_scores(rows: DataFrame, query: QueryVector, o: ScoringOptions | None = None, strict: bool = True) -> DataFrame:
    """rows with similarity and adjusted. strict: a row of another space is an error; else it is left out."""
    o = o or ScoringOptions()
    rows = rows.withColumn("fingerprint", check_space(F.col("fingerprint"), query)).where(F.col("fingerprint").isNotNull()) if strict else rows.where(F.col("fingerprint") == query.fingerprint)
    similarity = V.cosine_to(F.col("vector"), query.vector)
    adjusted = F.greatest(F.lit(0.0), F.col("similarity")) * confidence(F.col("tokens"), F.col("capacity"), o)
    return rows.withColumn("similarity", similarity).withColumn("adjusted", adjusted)


def _best(rank: str, score: str, k: int) -> Column:
    return F.max(F.when(F.col(rank) == k, F.col(score)))


def item_scores(rows: DataFrame, query: QueryVector, o: ScoringOptions | None = None, strict: bool = True) -> DataFrame:
    """item, score, best_field, best_chunk, best_similarity, matches of every item with a usable field."""
    o = o or ScoringOptions()
    weight = F.when(F.col("weight") < 0, F.raise_error("a field weight is negative").cast("double")).otherwise(F.col("weight"))
    scored = chunk_scores(rows.withColumn("weight", weight).where("weight > 0"), query, o, strict).drop("vector")
    w = Window.partitionBy("item", "field").orderBy(F.col("adjusted").desc(), "chunk")
    three = scored.withColumn("r", F.row_number().over(w)).where("r <= 3")
    one_weight = F.when(F.min("weight") == F.max("weight"), F.max("weight")).otherwise(F.raise_error("chunks of a field have different weights").cast("double"))
    fields = three.groupBy("item", "field").agg(one_weight.alias("w"), _best("r", "adjusted", 1).alias("s1"), _best("r", "adjusted", 2).alias("s2"), _best("r", "adjusted", 3).alias("s3"), F.max(F.when(F.col("r") == 1, F.col("chunk"))).alias("best_chunk"), F.max(F.when(F.col("r") == 1, F.col("similarity"))).alias("best_similarity"), F.sort_array(F.collect_list(F.struct(F.col("r"), "chunk", "similarity", "adjusted"))).alias("matches"))
    fields = fields.withColumn("score", weighted(evidence(F.col("s1"), F.col("s2"), F.col("s3"), o), F.col("w")))
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), "field")
    ranked = fields.withColumn("fr", F.row_number().over(w)).where("fr <= 3")
    items = ranked.groupBy("item").agg(*(_best("fr", "score", k).alias(f"s{k}") for k in (1, 2, 3)), F.max(F.when(F.col("fr") == 1, F.struct("field", "best_chunk", "best_similarity", "matches"))).alias("best"))
    return items.select("item", evidence(F.col("s1"), F.col("s2"), F.col("s3"), o).alias("score"), F.col("best.field").alias("best_field"), F.col("best.best_chunk").alias("best_chunk"), F.col("best.best_similarity").alias("best_similarity"), F.col("best.matches").alias("matches"))


def all_matches(rows: DataFrame, query: QueryVector, o: ScoringOptions | None = None, top: int | None = 3) -> DataFrame:
    """item, field, chunk, similarity, adjusted, rank: the best chunks of each field, or all."""
    w = Window.partitionBy("item", "field").orderBy(F.col("adjusted").desc(), "chunk")
    out = chunk_scores(rows, query, o).withColumn("rank", F.row_number().over(w))
    return (out.where(F.col("rank") <= top) if top else out).select("item", "field", "chunk", "similarity", "adjusted", "rank")


def search(rows: DataFrame, query: QueryVector, options: SemanticOptions | None = None, o: ScoringOptions | None = None) -> DataFrame:
    """The best items: score, then item."""
    options = options or SemanticOptions()
    return item_scores(rows, query, o).orderBy(F.col("score").desc(), "item").limit(options.top).withColumn("scoring", F.lit("default-v1"))


def candidates(table: DataFrame, chunks: Chunks, query: QueryVector, budget: int, where: Filter | None = None, fields: list[str] | None = None, weights: dict[str, float] | None = None, extra_sql: str | None = None) -> DataFrame:
    """The budget's nearest chunks of the query's space that pass the filter; exact, in one scan.

    fields: only these, none if the list is empty. weights: multiply the stored weights of fields.
    """
    table = table.where(condition(where, resolver(chunks.columns)))
    if extra_sql:
        table = table.where(F.coalesce(F.expr(extra_sql), F.lit(False)))
    rows = chunks.rows(table).where(F.col("fingerprint") == query.fingerprint)
    if fields is not None:
        rows = rows.where(F.col("field").isin(fields) if fields else F.lit(False))
    for name, w in (weights or {}).items():
        rows = rows.withColumn("weight", F.when(F.col("field") == name, F.col("weight") * w).otherwise(F.col("weight")))
    near = rows.withColumn("native_similarity", V.cosine_to(F.col("vector"), query.vector))
    return near.orderBy(F.col("native_similarity").desc(), "item", "chunk").limit(budget)


def rerank(found: DataFrame, query: QueryVector, options: CandidateOptions | None = None, o: ScoringOptions | None = None, provider: str = "scan") -> DataFrame:
    """Candidates regrouped by item and scored by evidence; with what the preselection was."""
    options = options or CandidateOptions()
    best = item_scores(found, query, o).orderBy(F.col("score").desc(), "item").limit(options.top)
    return best.withColumn("scoring", F.lit("default-v1")).withColumn("retrieval", F.struct(F.lit(provider).alias("provider"), F.lit(options.mode).alias("mode"), F.lit(options.resolve()).alias("budget")))


def candidate_search(table: DataFrame, chunks: Chunks, query: QueryVector, options: CandidateOptions | None = None, where: Filter | None = None, fields: list[str] | None = None, weights: dict[str, float] | None = None, o: ScoringOptions | None = None) -> DataFrame:
    options = options or CandidateOptions()
    if options.mode != "exact":
        raise OptionError("approximate preselection is ann.candidates()")
    return rerank(candidates(table, chunks, query, options.resolve(), where, fields, weights), query, options, o)


def same_space(a: str, b: str) -> None:
    if a != b:
        raise SpaceMismatchError(f"embedding spaces {a} and {b}")
