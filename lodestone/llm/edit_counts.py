"""Operator 6: token counts of edited texts, from trees that are kept.

build_trees() encodes each text once and keeps, in a table, its pre-tokens in a segment tree: a leaf is a run
of pre-tokens with their byte lengths and token counts, an inner node the sum of its two children.
edit_trees() takes such a table and edits, and gives the table of the edited texts: an edit re-encodes
pre-tokens from the one before the edited place on, until a boundary of the new text falls on a boundary of
the old text past the edit; from there on pre-tokens are those of before. Only leaves that were touched are
cut and summed anew, and the sums on their paths to the root. Its result is edited again in the same way.

An edit replaces characters [start, end) of the text as it is by another text; edits of one round don't
overlap. Counts are those of the rank file's byte-level BPE on the edited text. Null and empty texts have
no tokens and, by the masks, no edits. Rows that repeat are counted each; extra columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, bpe
from . import kernels as K

LEAF = 64

Edit = tuple[int, int, str]

_DOMAIN, _LOCAL = re.compile(r"@[\w-]+(?:\.[\w-]+)+"), re.compile(r"[\w.+-]")
_OTHERS = [(re.compile(r"\+?\d[\d ().-]{7,}\d"), "<number>"), (re.compile(r"\b(?=\w*\d)(?=\w*[A-Za-z])\w{20,}\b"), "<secret>")]


def _addresses(text: str):
    """(start, end) of e-mail addresses. What stands before an @ is read backwards, so that a run without one costs nothing."""
    last = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        while at > last and _LOCAL.match(text[at - 1]):
            at -= 1
        if at < m.start():
            yield at, m.end()
            last = m.end()


def masking_edits(text: str) -> list[Edit]:
    """The production edits: replacements of e-mail addresses, long numbers and secrets; of overlapping ones the first stays."""
    found = [(s, e, "<email>") for s, e in _addresses(text)]
    found += [(m.start(), m.end(), mark) for pattern, mark in _OTHERS for m in pattern.finditer(text)]
    out: list[Edit] = []
    for s, e, mark in sorted(found):
        if not out or s >= out[-1][1]:
            out.append((s, e, mark))
    return out


def _packed(a: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes each as the largest needs, after a byte that says how many."""
    most = int(a.max()) if len(a) else 0
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([size]) + a.astype(f"<u{size}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


def _levels(leaves: np.ndarray) -> list[np.ndarray]:
    out = [leaves.astype(np.int64)]
    while len(out[-1]) > 1:
        out.append(np.add.reduceat(out[-1], np.arange(0, len(out[-1]), 2)))
    return out


def _cut(n: int) -> list[int]:
    """Sizes of the leaves of n pre-tokens."""
    return [LEAF] * (n // LEAF) + [n % LEAF] * (n % LEAF > 0)


class Tree:
    """A document's pre-tokens (byte lengths and token counts), the sizes of its leaves, and sums by level."""

    def __init__(self, lens: np.ndarray, counts: np.ndarray, leaves: np.ndarray | None = None, levels: list[np.ndarray] | None = None):
        self.lens, self.counts = lens.astype(np.int64), counts.astype(np.int64)
        self.leaves = np.array(_cut(len(lens)) or [0]) if leaves is None else leaves
        if levels is None:
            at = np.cumsum(self.leaves) - self.leaves
            levels = _levels(np.add.reduceat(self.counts, at) if len(lens) else np.zeros(1, np.int64))
        self.levels = levels

    @property
    def total(self) -> int:
        return int(self.levels[-1][0])

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lens) - self.lens

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        return _packed(self.lens), _packed(self.counts), _packed(self.leaves), _packed(np.concatenate(self.levels))

    @staticmethod
    def unpacked(lens: bytes, counts: bytes, leaves: bytes, sums: bytes) -> Tree:
        leaf, flat, levels, at = _unpacked(leaves), _unpacked(sums), [], 0
        n = len(leaf)
        while True:
            levels.append(flat[at : at + n])
            at += n
            if n == 1:
                return Tree(_unpacked(lens), _unpacked(counts), leaf, levels)
            n = -(-n // 2)

    def replace(self, changes: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        """Pre-tokens [first, end) give way to those of the lengths and counts, for changes in order that don't overlap."""
        if not changes:
            return
        bound = np.concatenate(([0], np.cumsum(self.leaves)))
        last = len(self.leaves) - 1
        lens, counts, at = [], [], 0
        groups: list[list[int]] = []  # first and last touched leaf, change of their number of pre-tokens
        for first, end, new_lens, new_counts in changes:
            lens += [self.lens[at:first], new_lens]
            counts += [self.counts[at:first], new_counts]
            at = end
            a = min(last, int(np.searchsorted(bound, first, side="right")) - 1)
            b = max(a, min(last, int(np.searchsorted(bound, max(first, end - 1), side="right")) - 1))
            grown = len(new_lens) - (end - first)
            if groups and a <= groups[-1][1]:
                groups[-1][1], groups[-1][2] = max(b, groups[-1][1]), groups[-1][2] + grown
            else:
                groups.append([a, b, grown])
        self.lens, self.counts = np.concatenate([*lens, self.lens[at:]]).astype(np.int64), np.concatenate([*counts, self.counts[at:]]).astype(np.int64)
        leaves, sums, done, place = [], [], 0, 0
        for a, b, grown in groups:
            leaves.append(self.leaves[done:a])
            sums.append(self.levels[0][done:a])
            place += int(self.leaves[done:a].sum())
            n = int(self.leaves[a : b + 1].sum()) + grown
            for size in _cut(n):
                leaves.append(np.array([size]))
                sums.append(np.array([int(self.counts[place : place + size].sum())]))
                place += size
            done = b + 1
        leaves.append(self.leaves[done:])
        sums.append(self.levels[0][done:])
        leaf, low = np.concatenate(leaves).astype(np.int64), np.concatenate(sums).astype(np.int64)
        if not len(leaf):
            leaf, low = np.zeros(1, np.int64), np.zeros(1, np.int64)
        if len(leaf) == len(self.leaves):  # the tree keeps its shape: only paths to the root change
            for k in np.flatnonzero(low != self.levels[0]).tolist():
                change, node = int(low[k] - self.levels[0][k]), k
                for level in self.levels:
                    level[node] += change
                    node >>= 1
        else:
            self.levels = _levels(low)
        self.leaves = leaf


def regions(data: np.ndarray, starts: np.ndarray, edits: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes, np.ndarray, np.ndarray]]:
    """(first, end, bytes, starts, ends): pre-tokens [first, end) are replaced by those of the spans in the bytes.

    Edits are in bytes, in order. Edits whose regions touch are settled in one.
    """
    out, k, size = [], 0, len(data)
    while k < len(edits):
        lo = edits[k][0]
        first = max(0, int(np.searchsorted(starts, lo, side="right")) - 2)
        begin = int(starts[first]) if len(starts) else 0
        parts, at, last = [], begin, k
        reach = 64
        while True:  # edits up to `last` are applied, and `reach` bytes beyond them are read
            parts, at = [], begin
            for s, e, new in edits[k : last + 1]:
                parts += [data[at:s].tobytes(), new]
                at = e
            stop = min(size, at + reach)
            while stop < size and (data[stop] & 0xC0) == 0x80:
                stop += 1
            if last + 1 < len(edits) and edits[last + 1][0] <= stop:
                last += 1
                continue
            text = b"".join(parts)
            tail = len(text)  # where the old text goes on
            text += data[at:stop].tobytes()
            spans = np.frombuffer(text, dtype=np.uint8)
            s, e, _ = K.pretokens(spans, np.array([0, len(spans)]), True)
            if stop == size:
                out.append((first, len(starts), text, s, e))
                break
            # a boundary that old and new share, far enough from the cut to be sure of it
            old = np.searchsorted(starts, s - tail + at)
            same = (s >= tail) & (s < len(text) - 8) & (old < len(starts))
            same[same] = starts[old[same]] == s[same] - tail + at
            hit = np.flatnonzero(same)
            if len(hit):
                h = int(hit[0])
                if last + 1 < len(edits) and int(np.searchsorted(starts, edits[last + 1][0], side="right")) - 2 < old[h]:
                    last += 1  # the next edit's region would begin inside this one
                    continue
                out.append((first, int(old[h]), text[: s[h]], s[:h], e[:h]))
                break
            reach *= 4
        k = last + 1
    return out


#: Columns of a table of trees.
TREES = "doc_id long, text string, lens binary, counts binary, leaves binary, sums binary"


def build_trees(docs: DataFrame, path: str, carry: str | None = None) -> DataFrame:
    """A row (TREES) of every row of docs (doc_id, text), with the column `carry` if one is named."""
    base.ship(docs.sparkSession)
    cols = [F.col("doc_id").cast("long").alias("doc_id"), base.text_of().alias("text"), *([F.col(carry).alias("edits")] if carry else [])]
    rows = docs.select(*cols)

    def run(batches):
        store = bpe.words(path)
        for batch in base.gathered(batches, bpe.REPLAY):
            made = []
            for lo, hi, enc in bpe.encode_rows(store, batch.column(1), True):
                lens = (enc.ends - enc.starts).astype(np.int64)
                for k in range(hi - lo):
                    a, b = enc.rows[k], enc.rows[k + 1]
                    made.append(Tree(lens[a:b], enc.counts[a:b]).packed())
            packed = [pa.array(c, pa.binary()) for c in zip(*made, strict=True)] if made else [pa.array([], pa.binary())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *packed, *batch.columns[2:]], ["doc_id", "text", "lens", "counts", "leaves", "sums", *batch.schema.names[2:]])

    return rows.mapInArrow(run, TREES + (f", edits {rows.schema['edits'].dataType.simpleString()}" if carry else ""))


def edit_trees(trees: DataFrame, path: str, edits: Callable[[str], list[Edit]] | str = masking_edits) -> DataFrame:
    """The trees (TREES) after the edits, with n_edits, n_before, n_after and n_reencoded (pre-tokens encoded anew).

    edits: a function of a text, or the name of a column array<struct<start,end,text>> in order of start.
    """
    base.ship(trees.sparkSession)
    names = [c.split()[0] for c in TREES.split(", ")]
    rows = trees.select(*names, *([F.col(edits).alias("edits")] if isinstance(edits, str) else []))

    def run(batches):
        store = bpe.words(path)
        for batch in base.gathered(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if isinstance(edits, str):
                wanted = [[(x["start"], x["end"], x["text"] or "") for x in e or []] for e in batch.column(6).to_pylist()]
            else:
                wanted = [edits(t) if t else [] for t in texts]
            kept = [batch.column(k) for k in range(6)]
            touched = [r for r, w in enumerate(wanted) if w]
            # the total of a tree is its last sum; only trees with edits are opened
            before = np.array([int(_unpacked(bytes([b[0]]) + b[-b[0] :])[0]) for b in kept[5].to_pylist()], dtype=np.int64)
            after, anew = before.copy(), np.zeros(len(texts), np.int64)
            if touched:
                open_, jobs, spans = {}, [], []
                for r in touched:
                    tree = open_[r] = Tree.unpacked(*(kept[k][r].as_py() for k in range(2, 6)))
                    data = np.frombuffer(texts[r].encode(), dtype=np.uint8)
                    for first, end, text, s, e in regions(data, tree.starts, _in_bytes(texts[r], wanted[r])):
                        jobs.append((r, first, end, len(spans), len(spans) + len(s)))
                        spans += [text[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                n = _count(store, spans) if spans else np.zeros(0, np.int64)
                size = np.array([len(s) for s in spans], dtype=np.int64)
                changes: dict[int, list] = {}
                for r, first, end, x, y in jobs:
                    changes.setdefault(r, []).append((first, end, size[x:y], n[x:y]))
                    anew[r] += y - x
                columns = [c.to_pylist() for c in kept[1:]]
                for r in touched:
                    open_[r].replace(changes.get(r, []))
                    after[r] = open_[r].total
                    for column, value in zip(columns, (_edited(texts[r], wanted[r]), *open_[r].packed()), strict=True):
                        column[r] = value
                kept[1:] = [pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.binary()] * 4), strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([len(w) for w in wanted], pa.int64()), pa.array(before), pa.array(after), pa.array(anew)], [*names, "n_edits", "n_before", "n_after", "n_reencoded"])

    return rows.mapInArrow(run, TREES + ", n_edits long, n_before long, n_after long, n_reencoded long")


def _edited(text: str, edits: list[Edit]) -> str:
    out, at = [], 0
    for s, e, new in edits:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]])


def edited_counts(docs: DataFrame, path: str, edits: Callable[[str], list[Edit]] | str = masking_edits) -> DataFrame:
    """doc_id, n_edits, n_before, n_after, n_reencoded of every row of docs (doc_id, text): trees are built and written, then edited.

    edits: as in edit_trees(), a column being one of docs.
    """
    carry = edits if isinstance(edits, str) else None
    trees = base.table(build_trees(docs, path, carry), "trees", "zstd")
    return edit_trees(trees, path, "edits" if carry else edits).select("doc_id", "n_edits", "n_before", "n_after", "n_reencoded")


def _in_bytes(text: str, edits: list[Edit]) -> list[tuple[int, int, bytes]]:
    if text.isascii():
        return [(s, e, new.encode()) for s, e, new in edits]
    out, at, place = [], 0, 0
    for s, e, new in edits:
        place += len(text[at:s].encode())
        start = place
        place += len(text[s:e].encode())
        out.append((start, place, new.encode()))
        at = e
    return out


def _count(store: bpe.Words, spans: list[bytes]) -> np.ndarray:
    """Tokens of each pre-token."""
    data = np.frombuffer(b"".join(spans), dtype=np.uint8)
    lens = np.array([len(s) for s in spans], dtype=np.int64)
    ends = np.cumsum(lens)
    h = K.hash_spans(data, ends - lens, ends)
    unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    store.learn(data, (ends - lens)[first], ends[first], unique)
    return store.len[store.find(unique)][inverse]
