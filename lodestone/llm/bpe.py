"""Byte-pair encoding by corpus-level merge replay.

All distinct words of a batch are laid out in one linked array of symbols. An inverted index
from merge rank to the places where that pair stands is built once; ranks are then replayed
in order from a heap, every merge being applied to all its places in one vector operation, and
only the pairs with the two neighbours of a merged place are looked up anew. A word in which a
merge makes a pair of a lower rank than its own (rank files allow that) is encoded by itself,
one merge at a time, so that ids are always those of the reference algorithm.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from functools import lru_cache

import numpy as np

from . import kernels as K

NONE = np.int32(2**31 - 1)


class MergeTable:
    """Pairs of symbols with their rank and the symbol they become."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, new: np.ndarray, single: np.ndarray, final: np.ndarray):
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.new = key[order], rank[order].astype(np.int32), new[order].astype(np.int32)
        self.new_of_rank = np.zeros(int(rank.max()) + 1, dtype=np.int32)
        self.new_of_rank[rank] = new
        self.single, self.final = single.astype(np.int32), final.astype(np.int32)  # of a byte; of a word's last byte
        # a direct-address filter of pairs: most pairs are none, and are ruled out by one probe
        self.bits = 22
        self.maybe = np.zeros(1 << self.bits, dtype=bool)
        self.maybe[self._slot(left, right)] = True

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left.astype(np.uint32) * np.uint32(2654435761)) ^ (right.astype(np.uint32) * np.uint32(2246822519))) >> np.uint32(32 - self.bits)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where there is no such merge."""
        out = np.full(len(left), NONE, dtype=np.int32)
        may = np.flatnonzero(self.maybe[self._slot(left, right)]) if len(left) > 64 else np.arange(len(left))
        if len(may):
            key = (left[may].astype(np.int64) << 32) | right[may].astype(np.int64)
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out[may] = np.where(self.key[at] == key, self.rank[at], NONE)
        return out

    def one(self, symbols: list[int]) -> list[int]:
        """Greedy encoding of one word: the leftmost pair of the least rank, again and again, from a heap of pairs."""
        s, n = list(symbols), len(symbols)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.ranks(np.array(s[:-1]), np.array(s[1:])).tolist() if n > 1 else []
        heap = [(r, i, s[i], s[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)

        def note(i: int) -> None:
            if i >= 0 and nxt[i] < n:
                r = int(self.ranks(np.array([s[i]]), np.array([s[nxt[i]]]))[0])
                if r != NONE:
                    heapq.heappush(heap, (r, i, s[i], s[nxt[i]]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            if s[i] != a or nxt[i] >= n or s[nxt[i]] != b:
                continue  # one of the two has been merged since
            j = nxt[i]
            s[i], s[j], nxt[i] = int(self.new_of_rank[r]), -1, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            note(prv[i])
            note(i)
        return [x for x in s if x >= 0]

    def replay(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (spans of bytes, none empty) one after the other, and how many each has."""
        words = len(starts)
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sym = np.empty(int(lens.sum()) + 1, dtype=np.int32)
        n = len(sym) - 1
        ends = np.cumsum(lens)
        raw = data[K.ragged(starts, lens)]
        sym[:n] = self.single[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        sym[n] = -1
        nxt = np.arange(1, n + 2, dtype=np.int32)
        nxt[ends - 1] = n
        prv = np.arange(-1, n, dtype=np.int32)
        prv[ends - lens] = n
        nxt[n] = prv[n] = n
        word = np.repeat(np.arange(words, dtype=np.int32), lens)
        rank = np.full(n + 1, NONE, dtype=np.int32)
        inner = np.flatnonzero(nxt[:n] != n)
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray, of: np.ndarray) -> None:
            if len(of) == 1:
                r = int(of[0])
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(heap, r)
                return
            order = np.argsort(of, kind="stable")
            of, places = of[order], places[order]
            cut = np.flatnonzero(of[1:] != of[:-1]) + 1
            lo = 0
            for hi in [*cut.tolist(), len(of)]:
                r = int(of[lo])
                if r in index:
                    index[r].append(places[lo:hi])
                else:
                    index[r] = [places[lo:hi]]
                    heapq.heappush(heap, r)
                lo = hi

        has = inner[rank[inner] != NONE]
        if len(has):
            note(has, rank[has])
        odd: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            p = lists[0] if len(lists) == 1 else np.concatenate(lists)
            p = p[rank[p] == r]
            if not len(p):
                continue
            if len(p) > 1:
                if len(lists) > 1:
                    p = np.unique(p)
                clash = nxt[p[:-1]] == p[1:]
                if clash.any():  # of places that overlap, the first, third, ... are taken
                    c = np.concatenate(([False], clash))
                    head = np.maximum.accumulate(np.where(c, 0, np.arange(len(p))))
                    p = p[(np.arange(len(p)) - head) % 2 == 0]
            right = nxt[p]
            after = nxt[right]
            sym[p] = self.new_of_rank[r]
            sym[right] = -2
            rank[right] = NONE
            nxt[p] = after
            prv[after] = p
            nxt[n] = prv[n] = n
            before = prv[p]
            places = np.concatenate((before, p))
            of = self.ranks(sym[places], sym[nxt[places]])
            of[places == n] = NONE
            rank[places] = of
            rank[n] = NONE
            good = np.flatnonzero(of != NONE)
            if len(good):
                places, of = places[good], of[good]
                if (of < r).any():
                    odd.append(np.unique(word[places[of < r]]))
                note(places, of)
        alive = sym[:n] >= 0
        ids, counts = sym[:n][alive], np.bincount(word[alive], minlength=words)
        if odd:
            redo = np.unique(np.concatenate(odd))
            at = np.concatenate(([0], np.cumsum(counts)))
            parts, last = [], 0
            for w in redo.tolist():
                b = raw[ends[w] - lens[w] : ends[w]]
                s = self.single[b].copy()
                s[-1] = self.final[b[-1]]
                new = np.array(self.one(s.tolist()), dtype=np.int32)
                parts += [ids[at[last] : at[w]], new]
                counts[w], last = len(new), w + 1
            ids = np.concatenate([*parts, ids[at[last] :]])
        return ids, counts


@lru_cache(maxsize=2)
def rank_file(path: str) -> tuple[MergeTable, list[bytes]]:
    """A table from a file of base64 tokens and ranks; every split of a token in two tokens is a merge. Also the tokens by id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    left, right, rank = [], [], []
    for token, r in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                rank.append(r)
    single = np.array([ranks[bytes([i])] for i in range(256)])
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    r = np.array(rank)
    return MergeTable(np.array(left), np.array(right), r, r, single, single), tokens


def _byte_letters() -> dict[int, str]:
    """The printable letters that stand for bytes in vocabularies of byte-level tokenizers."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in seen}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


@lru_cache(maxsize=2)
def merge_file(path: str) -> MergeTable:
    """A table from a tokenizers JSON file with an explicit list of merges and an end-of-word mark."""
    with open(path) as f:
        model = json.load(f)["model"]
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    letters = _byte_letters()
    left = np.array([vocab[a] for a, _ in pairs])
    right = np.array([vocab[b] for _, b in pairs])
    new = np.array([vocab[a + b] for a, b in pairs])
    single = np.array([vocab[letters[i]] for i in range(256)])
    final = np.array([vocab[letters[i] + suffix] for i in range(256)])
    return MergeTable(left, right, np.arange(len(pairs)), new, single, final)


class AddedTokens:
    """Tokens that are found in raw texts before anything else is done to them."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids
        # the library takes the leftmost, of those the one that is listed first
        self.pattern = re.compile("|".join(map(re.escape, ids))) if ids else None

    def split(self, text: str) -> list[tuple[str, int | None]]:
        """(text, id of the added token after it); the last part has no such id."""
        if self.pattern is None:
            return [(text, None)]
        out, at = [], 0
        for m in self.pattern.finditer(text):
            out.append((text[at : m.start()], self.ids[m.group()]))
            at = m.end()
        out.append((text[at:], None))
        return out


@lru_cache(maxsize=4)
def added_tokens(path: str) -> AddedTokens:
    """Those of a tokenizers JSON file; only plain ones, which match raw text anywhere, are known."""
    with open(path) as f:
        listed = json.load(f).get("added_tokens") or []
    if any(t.get(k) for t in listed for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with conditions are not supported")
    return AddedTokens({t["content"]: t["id"] for t in listed if t["content"]})


class Words:
    """Ids of the words that a worker has met, by hash: sorted hashes, and spans of one flat array.

    When more than `most` words are held, those not of the current batch are let go; that costs
    only time when they come again.
    """

    def __init__(self, table: MergeTable, most: int = 400_000):
        self.table, self.most = table, most
        self._clear()

    def _clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Encodes words (of distinct, sorted hashes) that aren't held yet."""
        at = np.searchsorted(self.hash, hashes)
        known = np.zeros(len(hashes), dtype=bool)
        if len(self.hash):
            known = self.hash[np.minimum(at, len(self.hash) - 1)] == hashes
        new = np.flatnonzero(~known)
        if not len(new):
            return
        if len(self.hash) + len(new) > self.most and len(self.hash):
            self._clear()
            new = np.arange(len(hashes))
        ids, counts = self.table.replay(data, starts[new], ends[new] - starts[new])
        first = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate((self.flat, ids))
        at = np.searchsorted(self.hash, hashes[new])
        self.start, self.len = np.insert(self.start, at, first), np.insert(self.len, at, counts)
        self.hash = np.insert(self.hash, at, hashes[new])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.hash, hashes)


@lru_cache(maxsize=4)
def words(path: str) -> Words:
    """One store a worker process and vocabulary."""
    return Words(rank_file(path)[0] if path.endswith(".tiktoken") else merge_file(path))


class Encoded:
    """The ids of the pre-tokens of a run of rows."""

    def __init__(self, store: Words, data: np.ndarray, offsets: np.ndarray, glued: bool):
        self.data, self.offsets, self.store = data, offsets, store
        self.starts, self.ends, self.rows = K.pretokens(data, offsets, glued)
        h = K.hash_spans(data, self.starts, self.ends)
        self.unique, self.first, inverse = np.unique(h, return_index=True, return_inverse=True)
        self.inverse = inverse.astype(np.int32)
        if len(data) < 1 << 31:
            self.starts, self.ends = self.starts.astype(np.int32), self.ends.astype(np.int32)

    def finish(self) -> None:
        """To be called after Words.learn(): counts and ids of pre-tokens."""
        at = self.store.find(self.unique)
        self.word_start, self.word_len = self.store.start[at], self.store.len[at]
        self.counts = self.word_len[self.inverse]
        total = np.concatenate(([0], np.cumsum(self.counts)))
        self.row_tokens = total[self.rows]  # for each row, ids before it

    def drop(self) -> None:
        """Lets the arrays go."""
        self.starts = self.ends = self.inverse = self.counts = self.unique = self.first = None

    def ids(self) -> np.ndarray:
        return self.store.flat[K.ragged(self.word_start[self.inverse], self.counts)]


#: Bytes of text that one replay serves; all arrays of so much text are held at once.
REPLAY = 8 << 20


def encode_rows(store: Words, column, glued: bool):
    """Encoded runs of rows of an Arrow column: (first row, end row, Encoded).

    The words that are new are learned from many runs together, so that one replay serves them all.
    """
    runs, size = [], 0
    for lo, hi, data, offsets in K.text_chunks(column):
        runs.append((lo, hi, Encoded(store, data, offsets, glued)))
        size += len(data)
        if size >= REPLAY:
            yield from _learned(store, runs)
            runs, size = [], 0
    if runs:
        yield from _learned(store, runs)


def _learned(store: Words, runs: list[tuple[int, int, Encoded]]):
    hashes = np.concatenate([e.unique for *_, e in runs])
    run = np.repeat(np.arange(len(runs)), [len(e.unique) for *_, e in runs])
    uniq, at = np.unique(hashes, return_index=True)
    parts, starts, ends, base = [], np.empty(len(uniq), np.int64), np.empty(len(uniq), np.int64), 0
    shift = np.concatenate(([0], np.cumsum([len(e.unique) for *_, e in runs])))
    for k, (_, _, e) in enumerate(runs):
        mine = np.flatnonzero(run[at] == k)
        first = e.first[at[mine] - shift[k]]
        s, n = e.starts[first], e.ends[first] - e.starts[first]
        parts.append(e.data[K.ragged(s, n)])
        ends[mine] = base + np.cumsum(n)
        starts[mine] = ends[mine] - n
        base += int(n.sum())
    store.learn(np.concatenate(parts), starts, ends, uniq)
    del hashes, run, uniq, at, parts, starts, ends
    for lo, hi, e in runs:
        e.finish()
        yield lo, hi, e
        e.drop()
