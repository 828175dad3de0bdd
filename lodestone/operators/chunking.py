"""Structure-aware chunks of bounded token counts.

A text that fits is one chunk. Else it is cut at headings outside of fences; sections that fit are joined with
their neighbours as far as they fit together, and those that don't are cut into windows that end at a blank
line, a sentence, a word or a token, whichever the window reaches last in that order. Later parts of a section
may repeat its headings as context and the last tokens before them. Every chunk is encoded as the model will
see it, and shortened until it fits. Offsets count UTF-16 units.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TokenLimitError
from ..options import ChunkOptions
from ..schema import Boundary


class Tokenizer(Protocol):
    """offsets: (start, end) of source tokens in characters. special: tokens that the model's input adds."""

    special: int

    def offsets(self, text: str) -> list[tuple[int, int]]: ...


class WordTokenizer:
    """Words between white space; for tests, and where no vocabulary is at hand."""

    def __init__(self, special: int = 0):
        self.special = special

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in re.finditer(r"\S+", text)]


class FileTokenizer:
    """A vocabulary in a tokenizers JSON file; it is opened once a worker."""

    _open: dict[str, object] = {}

    def __init__(self, path: str, special: int | None = None):
        self.path = path
        self.special = special if special is not None else self._get().num_special_tokens_to_add(False)

    def _get(self):
        if self.path not in self._open:
            from tokenizers import Tokenizer as T

            self._open[self.path] = T.from_file(self.path)
        return self._open[self.path]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return [o for o in self._get().encode(text, add_special_tokens=False).offsets if o[1] > o[0]]


@dataclass(frozen=True)
class Chunk:
    index: int
    count: int
    text: str
    context: str
    boundary: int
    heading_path: tuple[str, ...]
    char_start: int
    char_length: int
    token_start: int
    token_count: int
    document_tokens: int
    context_tokens: int
    special_tokens: int
    input_tokens: int


@dataclass(frozen=True)
class Section:
    start: int
    end: int
    path: tuple[str, ...]


_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*))?$")


def sections(text: str) -> list[Section]:
    """Sections by headings of up to six signs outside of fences; text before the first heading is one of its own."""
    out, stack, begin, path, at, fenced = [], [None] * 6, 0, (), 0, False
    for line in text.splitlines(keepends=True):
        plain = line.rstrip("\r\n")
        if plain.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and (m := _HEADING.match(plain)):
            title = (m.group(2) or "").strip().rstrip("#").strip()
            if title:
                if at > begin:
                    out.append(Section(begin, at, path))
                depth = len(m.group(1))
                stack[depth - 1 :] = [title] + [None] * (6 - depth)
                begin, path = at, tuple(t for t in stack if t)
        at += len(line)
    if at > begin:
        out.append(Section(begin, at, path))
    return out


class _Offsets:
    """Tokens of a text, and places between characters and tokens."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def range(self, start: int, end: int) -> tuple[int, int]:
        """First token that ends after start, and how many begin before end."""
        first = bisect_right(self.ends, start)
        last = bisect_left(self.starts, end)
        return first, max(0, last - first)

    def char_end(self, first: int, count: int, fallback: int) -> int:
        """Where `count` tokens from `first` end: at the beginning of the next one."""
        at = first + count
        return self.starts[at] if at < len(self.starts) else fallback


def preferred_break(text: str, start: int, end: int) -> tuple[int, int]:
    """(end, boundary) of a window at the last blank line, sentence or white space in its second half, else at its last token."""
    low = start + (end - start) // 2
    at = text.rfind("\n\n", low, end)
    if at > start:
        return at + 2, int(Boundary.PARAGRAPHS)
    for i in range(end - 1, low, -1):
        if text[i - 1] in ".!?。！？" and (text[i].isspace() or text[i - 1] in "。！？"):
            return (i + 1 if text[i].isspace() else i), int(Boundary.SENTENCES)
    for i in range(end - 1, low, -1):
        if text[i].isspace():
            return i + 1, int(Boundary.WORDS)
    return end, int(Boundary.TOKENS)


def _common(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def chunk_text(text: str, tokenizer: Tokenizer, options: ChunkOptions | None = None) -> list[Chunk]:
    """Chunks whose input, with context and special tokens, is at most max_tokens. An empty text has none."""
    o = options or ChunkOptions()
    if not text:
        return []
    capacity = o.max_tokens - tokenizer.special
    if capacity <= 0:
        raise TokenLimitError("special tokens leave no room")
    tokens = _Offsets(tokenizer.offsets(text))
    total = len(tokens.starts)
    made: list[tuple[int, int, int, tuple[str, ...], str]] = []  # start, end, boundary, path, context
    if total <= capacity:
        made.append((0, len(text), int(Boundary.WHOLE_DOCUMENT), (), ""))
    else:
        held: Section | None = None
        for s in sections(text):
            if tokens.range(s.start, s.end)[1] > capacity:
                if held:
                    made.append((held.start, held.end, int(Boundary.SECTION), held.path, ""))
                    held = None
                made += _windows(text, s, tokens, tokenizer, capacity, o)
            elif held and tokens.range(held.start, s.end)[1] <= capacity:
                held = Section(held.start, s.end, _common(held.path, s.path))
            else:
                if held:
                    made.append((held.start, held.end, int(Boundary.SECTION), held.path, ""))
                held = s
        if held:
            made.append((held.start, held.end, int(Boundary.SECTION), held.path, ""))
    fitted = [p for m in made for p in _fit(text, *m, tokenizer, o)]
    units = _utf16(text)
    out = []
    for i, (start, end, boundary, path, context, n_context, n_input) in enumerate(fitted):
        first, count = tokens.range(start, end)
        out.append(Chunk(i, len(fitted), text[start:end], context, boundary, path, units(start), units(end) - units(start), first, count, total, n_context, tokenizer.special, n_input))
    return out


def _windows(text: str, s: Section, tokens: _Offsets, tokenizer: Tokenizer, capacity: int, o: ChunkOptions):
    start, first, out = s.start, True, []
    context = " > ".join(s.path) + "\n\n" if s.path and o.repeat_heading else ""
    n_context = len(tokenizer.offsets(context)) if context else 0
    if n_context >= capacity - o.overlap_tokens:
        context, n_context = "", 0
    while start < s.end:
        room = capacity if first else max(1, capacity - n_context)
        at, left = tokens.range(start, s.end)
        if left <= room:
            end, boundary = s.end, int(Boundary.SECTION)
        else:
            end, boundary = preferred_break(text, start, tokens.char_end(at, room, s.end))
        out.append((start, end, boundary, s.path, "" if first else context))
        if end >= s.end:
            break
        start_next = end
        if o.overlap_tokens:
            at, n = tokens.range(start, end)
            back = at + max(1, n - o.overlap_tokens)
            start_next = min(end, tokens.starts[back]) if back < len(tokens.starts) else end
        start, first = max(start_next, start + 1), False
    return out


def _fit(text, start, end, boundary, path, context, tokenizer, o):
    """The range as one or more chunks that fit when encoded with their context."""
    out = []
    while start < end:
        n_context = len(tokenizer.offsets(context)) if context else 0
        stop, kind = end, boundary
        while True:
            n = len(tokenizer.offsets(context + text[start:stop])) + tokenizer.special
            if n <= o.max_tokens:
                break
            spans = tokenizer.offsets(text[start:stop])
            keep = len(spans) - max(1, n - o.max_tokens)
            if keep < 1:
                if context:
                    context, n_context = "", 0
                    continue
                raise TokenLimitError("not even one token fits")
            stop, kind = start + spans[keep][0], int(Boundary.TOKENS)
        out.append((start, stop, kind, path, context, n_context, n))
        start = stop
    return out


def _utf16(text: str):
    if all(ord(c) < 0x10000 for c in text):
        return lambda i: i
    sums = [0]
    for c in text:
        sums.append(sums[-1] + (2 if ord(c) > 0xFFFF else 1))
    return lambda i: sums[i]


SCHEMA = "chunk int, chunks int, text string, context string, boundary int, heading_path array<string>, char_start int, char_length int, token_start int, token_count int, document_tokens int, context_tokens int, special_tokens int, input_tokens int"


def chunk_documents(docs: DataFrame, key: str, text: str, tokenizer: Tokenizer, options: ChunkOptions | None = None) -> DataFrame:
    """A row a chunk of each text, with the key; in Arrow batches, without a shuffle. Null texts have none."""
    o = options or ChunkOptions()
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                for c in chunk_text(t or "", tokenizer, o):
                    rows.append((k, c.index, c.count, c.text if o.include_text else None, c.context, c.boundary, list(c.heading_path), c.char_start, c.char_length, c.token_start, c.token_count, c.document_tokens, c.context_tokens, c.special_tokens, c.input_tokens))
            yield pd.DataFrame(rows, columns=["key", *(p.split()[0] for p in SCHEMA.split(", "))])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, {SCHEMA}")


def count_tokens(tokenizer: Tokenizer, special: bool = False):
    """A column function: source tokens of a text, or with those that the model's input adds.

    Words between white space are counted in the JVM; other tokenizers go through Arrow.
    """
    extra = tokenizer.special if special else 0
    if isinstance(tokenizer, WordTokenizer):
        # the white space of Python's patterns
        return lambda c: F.size(F.regexp_extract_all(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(r"(?U)([^\s\x1c-\x1f]+)"), F.lit(1))) + F.lit(extra)
    return count_tokens_udf(tokenizer, extra)


def count_tokens_udf(tokenizer: Tokenizer, extra: int = 0):
    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(tokenizer.offsets(t or "")) + extra).astype("int32")

    return run


@dataclass(frozen=True)
class TokenFit:
    """A text's tokens against a chunk and the model."""

    source_tokens: int
    input_tokens: int
    max_tokens: int
    model_tokens: int

    @property
    def fits_chunk(self) -> bool:
        return self.input_tokens <= self.max_tokens

    @property
    def fits_model(self) -> bool:
        return self.input_tokens <= self.model_tokens
