"""Declarative retrieval plans and their compilation to one DataFrame lineage.

A plan: global filters, stages (semantic or lexical, each with filters and weights), fusion of the stages'
ranks, post-filters, and the number of results. Filters before a stage also bound its statistics; post-filters
come after fusion and before the cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions import vectors as V
from ..operators import fusion, lexical, semantic
from ..operators.filters import Filter, combine, condition, resolver
from ..options import FusionOptions, LexicalOptions, ScoringOptions


@dataclass(frozen=True)
class Stage:
    """kind: semantic or lexical. fields: weights by name; none stands for all fields, each with weight 1."""

    kind: str
    name: str
    fields: Mapping[str, float] | None = None
    filter: Filter | None = None
    candidates: int | None = None
    weight: float = 1.0

    def where(self, f: Filter) -> Stage:
        return replace(self, filter=combine(self.filter, f))

    def with_candidates(self, n: int) -> Stage:
        return replace(self, candidates=n)

    def with_weight(self, w: float) -> Stage:
        return replace(self, weight=w)


def semantic_stage(name: str = "semantic", fields: Mapping[str, float] | None = None) -> Stage:
    return Stage("semantic", name, fields)


def lexical_stage(name: str = "lexical", fields: Mapping[str, float] | None = None) -> Stage:
    return Stage("lexical", name, fields)


@dataclass(frozen=True)
class SearchQuery:
    text: str
    stages: tuple[Stage, ...] = ()
    filter: Filter | None = None
    post_filter: Filter | None = None
    top: int = 10
    fusion: FusionOptions = field(default_factory=FusionOptions)

    def where(self, f: Filter) -> SearchQuery:
        return replace(self, filter=combine(self.filter, f))

    def post_where(self, f: Filter) -> SearchQuery:
        return replace(self, post_filter=combine(self.post_filter, f))

    def add(self, *stages: Stage) -> SearchQuery:
        return replace(self, stages=(*self.stages, *stages))

    def semantic(self, fields: Mapping[str, float] | None = None, name: str = "semantic") -> SearchQuery:
        return self.add(semantic_stage(name, fields))

    def lexical(self, fields: Mapping[str, float] | None = None, name: str = "lexical") -> SearchQuery:
        return self.add(lexical_stage(name, fields))

    def take(self, n: int) -> SearchQuery:
        return replace(self, top=n)

    def reciprocal_rank_fusion(self, rank_constant: float = 60.0) -> SearchQuery:
        return replace(self, fusion=FusionOptions(rank_constant))

    def candidate_count(self, stage: Stage) -> int:
        return stage.candidates if stage.candidates is not None else max(100, 10 * self.top)

    def validate(self) -> SearchQuery:
        if not self.text or not self.text.strip():
            raise PlanError("the query is blank")
        if not self.stages:
            raise PlanError("a plan needs a stage")
        if len({s.name for s in self.stages}) < len(self.stages):
            raise PlanError("stages need names of their own")
        if self.top <= 0:
            raise PlanError("a plan takes at least one result")
        for s in self.stages:
            if s.kind not in ("semantic", "lexical"):
                raise PlanError(f"no stage of kind {s.kind}")
            if not math.isfinite(s.weight) or s.weight < 0:
                raise PlanError(f"the weight of {s.name} is negative")
            if s.candidates is not None and s.candidates <= 0:
                raise PlanError(f"the candidates of {s.name} aren't positive")
            if any(not math.isfinite(w) or w < 0 for w in (s.fields or {}).values()):
                raise PlanError(f"a field weight of {s.name} is negative")
        return self


@dataclass(frozen=True)
class Corpus:
    """items: a row an item with `key`, text columns and filter columns. chunks: a table of chunks whose item is the key."""

    items: DataFrame
    key: str
    columns: Mapping[str, str]
    text_fields: tuple[str, ...] = ()
    chunks: DataFrame | None = None
    chunk_map: semantic.Chunks | None = None


@dataclass(frozen=True)
class Profile:
    """How stages retrieve: after which kind of store.

    lexical: bm25, conjunctive (embedded full-text index), frequency (server ranking), field-fusion (a field at a time).
    preselect: semantic stages take a budget of nearest chunks first, ten times the stage's candidates, and rerank those.
    """

    name: str = "in-memory"
    lexical: str = "bm25"
    preselect: bool = False
    mode: str = "all"
    normalization: int = 0
    rank_constant: float = 60.0

    def lexical_rows(self, items: DataFrame, key: str, text: str, fields: Mapping[str, float], n: int, options: LexicalOptions | None) -> DataFrame:
        o = replace(options or LexicalOptions(), top=n)
        if self.lexical == "bm25":
            return lexical.top(lexical.bm25_scores(items, key, text, fields, o), n).select("key", "score")
        if self.lexical == "conjunctive":
            return lexical.conjunctive(items, key, text, fields, o)
        if self.lexical == "frequency":
            return lexical.frequency_rank(items, key, text, fields, o, self.mode, self.normalization)
        if self.lexical == "field-fusion":
            return lexical.field_fusion(items, key, text, fields, o, self.rank_constant)
        raise PlanError(f"no lexical profile {self.lexical}")


IN_MEMORY = Profile()
POSTGRES_LIKE = Profile("server", "frequency", True)
SQLITE_LIKE = Profile("embedded", "conjunctive", True)
SQL_SERVER_LIKE = Profile("field-ranked", "field-fusion", True)


Embed = Callable[[str], semantic.QueryVector]


def _chosen(available: tuple[str, ...], fields: Mapping[str, float] | None) -> dict[str, float]:
    if not fields:
        return dict.fromkeys(available, 1.0)
    return {n: w for n, w in fields.items() if w > 0 and n in available}


def compile_query(query: SearchQuery, corpus: Corpus, embed: Embed | None = None, scoring: ScoringOptions | None = None, lexical_options: LexicalOptions | None = None, profile: Profile = IN_MEMORY) -> DataFrame:
    """key, score, first_stage, first_rank, contributions and the items' columns, best first.

    The query text is embedded once, and only if a semantic stage is there to use it.
    """
    query.validate()
    resolve = resolver(corpus.columns)
    eligible = corpus.items.where(condition(query.filter, resolve))
    vector, rankings = None, []
    for s in query.stages:
        if s.weight == 0:
            continue
        items = eligible.where(condition(s.filter, resolve))
        n = query.candidate_count(s)
        if s.kind == "lexical":
            fields = _chosen(corpus.text_fields, s.fields)
            if not fields:
                continue
            rows = profile.lexical_rows(items, corpus.key, query.text, fields, n, lexical_options)
        else:
            if corpus.chunks is None or corpus.chunk_map is None or embed is None:
                raise PlanError("a semantic stage needs chunks and an embedder")
            vector = vector or embed(query.text)
            chunk_rows = corpus.chunk_map.rows(corpus.chunks)
            if s.fields:
                weights = {k: w for k, w in s.fields.items() if w > 0}
                weight = F.lit(0.0)
                for k, w in weights.items():
                    weight = F.when(F.col("field") == k, F.lit(float(w))).otherwise(weight)
                chunk_rows = chunk_rows.withColumn("weight", weight).where(F.col("field").isin(list(weights)) if weights else F.lit(False))
            chunk_rows = chunk_rows.join(items.select(F.col(corpus.key).alias("item")), "item", "left_semi")
            if profile.preselect:
                near = V.cosine_to(F.col("vector"), vector.vector)
                chunk_rows = chunk_rows.where(F.col("fingerprint") == vector.fingerprint).withColumn("_near", near).orderBy(F.col("_near").desc(), "item", "chunk").limit(max(100, 10 * n)).drop("_near")
            scores = semantic.item_scores(chunk_rows, vector, scoring)
            rows = scores.select(F.col("item").alias("key"), "score").orderBy(F.col("score").desc(), "key").limit(n)
        rankings.append(fusion.Ranking(s.name, rows, s.weight))
    if not rankings:
        return eligible.select(F.col(corpus.key).alias("key"), F.lit(0.0).alias("score"), F.lit(0).alias("first_stage"), F.lit(0).alias("first_rank")).where(F.lit(False))
    fused = fusion.fuse(rankings, query.fusion)
    if query.post_filter is not None:
        passing = corpus.items.where(condition(query.post_filter, resolve)).select(F.col(corpus.key).alias("key"))
        fused = passing.join(F.broadcast(fused), "key")  # at most the stages' candidates
    return fusion.top(fused, query.top)


def with_items(results: DataFrame, corpus: Corpus) -> DataFrame:
    """Results with the columns of their items."""
    return corpus.items.withColumn("key", F.col(corpus.key)).join(F.broadcast(results), "key").orderBy(F.col("score").desc(), "first_stage", "first_rank")
