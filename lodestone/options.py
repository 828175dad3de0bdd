"""Options with their defaults; each checks itself when made."""

from __future__ import annotations

import math
from dataclasses import dataclass

from .errors import OptionError


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise OptionError(what)


@dataclass(frozen=True)
class ScoringOptions:
    """Evidence of chunks: the least confidence of a short chunk, and the share of a second and third match within the window."""

    min_length_confidence: float = 0.96
    support_window: float = 0.12
    second: float = 0.25
    third: float = 0.10
    profile: str = "default-v1"

    def __post_init__(self) -> None:
        _need(0 <= self.min_length_confidence <= 1, "min_length_confidence is between 0 and 1")
        _need(self.support_window > 0, "support_window is positive")
        _need(self.second >= 0 and self.third >= 0, "support shares aren't negative")
        _need(self.profile == "default-v1", "the scoring profile is default-v1")


@dataclass(frozen=True)
class SemanticOptions:
    top: int = 10
    include_all_matches: bool = False

    def __post_init__(self) -> None:
        _need(self.top > 0, "top is positive")


@dataclass(frozen=True)
class LexicalOptions:
    top: int = 10
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self) -> None:
        _need(self.top > 0, "top is positive")
        _need(math.isfinite(self.k1) and self.k1 > 0, "k1 is positive")
        _need(0 <= self.b <= 1, "b is between 0 and 1")


@dataclass(frozen=True)
class FusionOptions:
    """kind: reciprocal-rank."""

    rank_constant: float = 60.0
    kind: str = "reciprocal-rank"

    def __post_init__(self) -> None:
        _need(math.isfinite(self.rank_constant) and self.rank_constant >= 0, "the rank constant isn't negative")
        _need(self.kind == "reciprocal-rank", "the only fusion is reciprocal-rank")


@dataclass(frozen=True)
class CandidateOptions:
    """How many chunks are preselected: explicit, or ten times the results, a hundred at least."""

    top: int = 10
    candidates: int | None = None
    mode: str = "exact"

    def __post_init__(self) -> None:
        _need(self.top > 0, "top is positive")
        _need(self.candidates is None or self.candidates >= self.top, "there are no fewer candidates than results")
        _need(self.mode in ("exact", "approximate"), "mode is exact or approximate")

    def resolve(self) -> int:
        return self.candidates if self.candidates is not None else max(100, 10 * self.top)


@dataclass(frozen=True)
class ChunkOptions:
    max_tokens: int = 1024
    overlap_tokens: int = 0
    repeat_heading: bool = True
    include_text: bool = True

    def __post_init__(self) -> None:
        _need(self.max_tokens > 0, "max_tokens is positive")
        _need(0 <= self.overlap_tokens < self.max_tokens, "the overlap is smaller than a chunk")


@dataclass(frozen=True)
class EmbeddingOptions:
    document_format: int = 4
    query_format: int = 4
    query_max_tokens: int = 1024

    def __post_init__(self) -> None:
        _need(self.document_format in (1, 2, 3, 4) and self.query_format in (1, 2, 3, 4), "an unknown vector format")
        _need(self.query_max_tokens > 0, "query_max_tokens is positive")


@dataclass(frozen=True)
class CombineOptions:
    """Of many vectors one: its dimensions and format where they shall change, and the similarity that counts as none."""

    dimensions: int | None = None
    format: int | None = None
    baseline: float = 0.0

    def __post_init__(self) -> None:
        _need(self.dimensions is None or self.dimensions > 0, "dimensions is positive")
        _need(-1 <= self.baseline < 1, "baseline is at least -1 and less than 1")


def inference_slots(threads: int, wanted: int | None = None) -> int:
    """Model calls at a time: half the threads, 1 to 8, unless told."""
    _need(threads > 0 and (wanted is None or wanted > 0), "threads and slots are positive")
    return wanted if wanted is not None else max(1, min(threads // 2, 8))
