"""Words of a text, as JVM expressions and in Python alike."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{Nd}]+)"


def words(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased; no words for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(1)), F.lower)


_ASCII = bytes(ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)) + bytes(range(128, 256))


@cache
def _in_word(code: int) -> bool:
    import regex

    return regex.fullmatch(WORD, chr(code)) is not None


def word_lists(texts: list[str | None]) -> Iterator[list[bytes]]:
    """words() of each text in Python, as UTF-8; letters are lower-cased one by one, as DuckDB does it.

    ASCII goes by one table; other signs that stand between words are looked for in each text and blanked before.
    """
    for t in texts:
        if not t:
            yield []
            continue
        if not t.isascii():
            t = t.replace("\u0130", "i").replace("\u03a3", "\u03c3").lower()
            codes = np.frombuffer(t.encode("utf-32-le"), dtype="<u4")
            between = [chr(c) for c in np.unique(codes[codes > 127]).tolist() if not _in_word(c)]
            if between:
                t = re.sub(f"[{re.escape(''.join(between))}]", " ", t)
        yield t.encode().translate(_ASCII).split()


def query_words(text: str) -> list[str]:
    """Distinct words of a query, in the order they first come."""
    import regex

    return list(dict.fromkeys(w.lower() for w in regex.findall(WORD, text)))


def times(tokens: Column, term: str) -> Column:
    """How often a term is among the words."""
    return F.size(F.filter(tokens, lambda w: w == F.lit(term))).cast("long")


def markup_stripped(html: Column) -> Column:
    """Text without scripts, styles, comments and tags."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(plain, r"(?s)<[^>]*>", " ")
