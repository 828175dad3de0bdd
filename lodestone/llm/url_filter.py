"""Operator 3: URL filters by host word segmentation and naive Bayes.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: what follows
up to `?`, `#` or the end. Rules (verdict, host, path) fit their host and its subdomains where the path
begins with theirs; the longest rule's verdict stands. Other URLs are judged by multinomial naive Bayes,
learned from the URLs that rules decide: tokens are the words of the host and of the path, in PLACES
hashed places. Host names are cut into words by a unigram Viterbi search over word counts of all pages'
text; counts meet substrings by a join, whatever their number. Digits of a host or path are one token,
non-ASCII runs are tokens as they stand. Before any token the odds are those of the ruled URLs, unless a
prior is given: where most rules block, so is most of what has no telling token.

A null URL, or one without `://`, has an empty host and path; it has no token, so the prior decides. With
no URL under a rule all others are allowed. Rows that repeat are judged alike. Null html counts as empty.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from . import kernels as K

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
PLACES = 1 << 18
#: The longest unknown word of a host name; counted words are looked up at any length.
LONGEST = 20
LETTERS = K.mask_of([b for b in range(256) if not 97 <= b <= 122])


def split_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict)."""
    url = F.col("url").cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, ruled = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return out.select("*", rule.alias("rule"), ruled.alias("ruled"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, n, letters): hashes of runs of ASCII letters, A-Z lower-cased, outside of tags, with their number and length."""

    def run(batches):
        for batch in batches:
            hashes, sizes = [], []
            for _, _, data, offsets in K.text_chunks(batch.column(0)):
                if not len(data):
                    continue
                place = np.arange(len(data))
                first = np.repeat(offsets[:-1], np.diff(offsets))
                opened = np.maximum.accumulate(np.where(data == 60, place, -1))
                closed = np.maximum.accumulate(np.where(data == 62, place, -1))
                plain = np.where((opened > closed) & (opened >= first), np.uint8(32), K.LOWER[data])
                starts, ends, _ = K.word_spans(plain, offsets, LETTERS)
                hashes.append(K.hash_spans(plain, starts, ends))
                sizes.append(ends - starts)
            h, first, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            letters = np.concatenate(sizes)[first] if sizes else first
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(letters.astype(np.int64))], ["h", "n", "letters"])

    return texts.mapInArrow(run, "h long, n long, letters long").groupBy("h").agg(F.sum("n").alias("n"), F.max("letters").alias("letters"))


def cut_words(piece: str, chance: dict[tuple[int, int], float], unknown) -> list[str]:
    """The likeliest words of a piece; chance has log probabilities by (start, length), unknown(length) those of others."""
    long: dict[int, list[int]] = {}
    for start, size in chance:
        if size > LONGEST:
            long.setdefault(start + size, []).append(size)
    best, back = [0.0] + [-math.inf] * len(piece), [0] * (len(piece) + 1)
    for end in range(1, len(piece) + 1):
        for size in [*range(1, min(LONGEST, end) + 1), *long.get(end, ())]:
            c = best[end - size] + chance.get((end - size, size), unknown(size))
            if c > best[end]:
                best[end], back[end] = c, end - size
    out, end = [], len(piece)
    while end:
        out.append(piece[back[end] : end])
        end = back[end]
    return out[::-1]


#: Bytes of spans that are hashed, and rows that are sent, in one go.
SPAN_BYTES, SPAN_ROWS = 4 << 20, 100_000


def _substrings(data: np.ndarray, sizes: list[int]):
    """(starts, sizes, hashes) of all substrings of these sizes, in runs of bounded size."""
    n, out, rows = len(data), [], 0
    for size in sizes:
        step = max(1, SPAN_BYTES // size)
        for lo in range(0, n - size + 1, step):
            starts = np.arange(lo, min(n - size + 1, lo + step))
            # each start is hashed apart: spans may overlap
            flat = data[(starts[:, None] + np.arange(size)).ravel()]
            at = np.arange(len(starts)) * size
            out.append((starts, np.full(len(starts), size), K.hash_spans(flat, at, at + size)))
            rows += len(starts)
            if rows >= SPAN_ROWS:
                yield tuple(np.concatenate(x) for x in zip(*out, strict=True))
                out, rows = [], 0
    if out:
        yield tuple(np.concatenate(x) for x in zip(*out, strict=True))


def segment(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """(piece, words) of distinct pieces, runs of letters: a table (piece, id), or rows (piece) that are written as one first."""
    if "id" not in pieces.columns:
        pieces = base.table(pieces.withColumn("id", F.monotonically_increasing_id()), "pieces")
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = pieces.agg(F.max(F.length("piece"))).first()[0] or 0
    long = sorted(r[0] for r in counts.where((F.col("letters") > LONGEST) & (F.col("letters") <= most)).select("letters").distinct().collect())

    def substrings(batches):
        def sent(held):
            rows, starts, sizes, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(hashes.view(np.int64))], ["id", "start", "size", "h"])

        for batch in batches:
            held, rows = [], 0
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(name)
                for starts, sizes, hashes in _substrings(np.frombuffer(name.encode(), dtype=np.uint8), [*range(1, min(LONGEST, n) + 1), *(k for k in long if k <= n)]):
                    held.append((np.full(len(starts), key, dtype=np.int64), starts, sizes, hashes))
                    rows += len(starts)
                    if rows >= SPAN_ROWS:
                        yield sent(held)
                        held, rows = [], 0
            if held:
                yield sent(held)

    known = pieces.select("id", "piece").mapInArrow(substrings, "id long, start int, size int, h long").join(counts.select("h", "n"), "h")
    found = pieces.select("id", "piece").join(known.groupBy("id").agg(F.collect_list(F.struct("start", "size", "n")).alias("known")), "id", "left")

    def run(batches):
        log_total = math.log(total + 1)
        for batch in batches:
            out = []
            for piece, known_ in zip(batch.column("piece").to_pylist(), batch.column("known").to_pylist(), strict=True):
                chance = {(k["start"], k["size"]): math.log(k["n"]) - log_total for k in known_ or []}
                out.append(cut_words(piece, chance, lambda size: -log_total - 2.3 * size))
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(out, pa.list_(pa.string()))], ["piece", "words"])

    return found.select("piece", "known").mapInArrow(run, "piece string, words array<string>")


def place_of(kind: str, word: str) -> int:
    return zlib.crc32(f"{kind}:{word}".encode()) & (PLACES - 1)


def path_places(path: str) -> list[int]:
    """Places of the runs of letters, of digits and of non-ASCII signs of a path; all numbers are one token."""
    return [place_of("p", "0" if w[0] in "0123456789" else w) for w in re.findall(r"[a-z]+|[0-9]+|[^\x00-\x7f]+", path.lower())]


def _host_places(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, places) of distinct hosts (host): of the words of its runs of letters, and of its runs of digits (all one token) and of non-ASCII signs."""
    runs = hosts.select("host", F.posexplode(F.expr(r"regexp_extract_all(host, '([a-z]+|[0-9]+|[^\\x00-\\x7f]+)', 1)")).alias("pos", "piece"))
    runs = base.table(runs, "host-pieces")
    pieces = runs.groupBy("piece").agg(F.count("*").alias("_n")).withColumn("id", F.monotonically_increasing_id())
    pieces = base.table(pieces, "pieces")
    letters = F.col("piece").rlike("^[a-z]")
    other = pieces.where(~letters).select("piece", F.array(F.when(F.col("piece").rlike("^[0-9]"), F.lit("0")).otherwise(F.col("piece"))).alias("words"))
    words = base.table(segment(pieces.where(letters), counts).unionByName(other).join(pieces.select("piece", "_n"), "piece"), "piece-words")
    joined = base.attach(runs, words, ["piece"], "_n").select("host", F.explode("words").alias("word"))
    place = F.crc32(F.concat(F.lit("h:"), F.col("word")).cast("binary")).bitwiseAND(F.lit(PLACES - 1)).cast("int")
    return hosts.join(joined.groupBy("host").agg(F.collect_list(place).alias("places")), "host", "left")


def _path_counts(urls: DataFrame) -> DataFrame:
    """(place, allow, block) of path tokens of ruled URLs, counted before they are shuffled."""

    def run(batches):
        for batch in batches:
            n = np.zeros((2, PLACES), dtype=np.int64)
            for path, ruled in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.add.at(n[int(ruled == "block")], path_places(path), 1)
            at = np.flatnonzero(n.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[0, at]), pa.array(n[1, at])], ["place", "allow", "block"])

    return urls.where("ruled is not null").select("path", "ruled").mapInArrow(run, "place int, allow long, block long")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, prior: float | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block of every row of pages (page_id, url, html).

    prior: the chance of block before a token is seen; if None, the share of block among the URLs that rules decide.
    """
    spark = pages.sparkSession
    base.ship(spark)
    urls = base.table(split_urls(pages, RULES if rules is None else rules), "urls")
    counts = base.table(word_counts(pages.select(F.col("html").cast("string"))), "word-counts")
    hosts = base.table(urls.groupBy("host").agg(F.count("*").alias("_n"), F.count_if(F.col("ruled") == "allow").alias("_allow"), F.count_if(F.col("ruled") == "block").alias("_block")), "hosts")
    placed = base.table(_host_places(hosts.select("host"), counts).join(hosts, "host"), "host-words")
    of_hosts = placed.where("_allow + _block > 0").select(F.explode("places").alias("place"), F.col("_allow").alias("allow"), F.col("_block").alias("block"))
    learned = of_hosts.unionByName(_path_counts(urls)).groupBy("place").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).collect()  # at most PLACES rows
    n = np.zeros((2, PLACES))
    for r in learned:
        n[:, r["place"]] = r["allow"], r["block"]
    ruled = placed.agg(F.coalesce(F.sum("_allow"), F.lit(0)), F.coalesce(F.sum("_block"), F.lit(0))).first()
    used = max(1, int((n.sum(axis=0) > 0).sum()))
    weight = np.log((n[1] + 0.5) / (n[1].sum() + 0.5 * used)) - np.log((n[0] + 0.5) / (n[0].sum() + 0.5 * used))
    weight[n.sum(axis=0) == 0] = 0.0
    bias = math.log((ruled[1] + 0.5) / (ruled[0] + 0.5)) if sum(ruled) else -math.inf
    if prior is not None and sum(ruled):
        bias = math.log(prior / (1 - prior))

    def run(batches):
        for batch in batches:
            odds = np.full(len(batch), bias)
            for r, (path, places) in enumerate(zip(batch.column("path").to_pylist(), batch.column("places").to_pylist(), strict=True)):
                odds[r] += sum(weight[k] for k in [*(places or ()), *path_places(path)])
            chance = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            by_rule = batch.column("ruled").to_pylist()
            verdict = [v or ("block" if c > 0.5 else "allow") for v, c in zip(by_rule, chance.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(chance)], ["page_id", "host", "path", "rule", "verdict", "p_block"])

    rows = base.attach(urls, placed.select("host", "places", "_n"), ["host"], "_n").select("page_id", "host", "path", "rule", "ruled", "places")
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, p_block double")
