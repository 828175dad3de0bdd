"""Operator 4: an interpolated modified Kneser-Ney model of word pairs, counted in Spark.

Words are runs of bytes other than white space, A-Z lower-cased; each text has a begin mark before
it and an end mark, counted as a token, after it. Map tasks count their distinct pairs and send them
in packed arrays to the shard of their first word (very frequent first words are split by the second);
each shard settles its counts, writes its pairs as a sorted array of 64-bit hashes with counts, and
passes on what it knows of single words: how often and after how many different words a word comes,
and the totals and counts of counts of what follows it. A second exchange adds that up and writes
the sorted arrays of words. Files go to the shared folder, each under its final name at once, so a
lost executor or a second attempt does no harm. Scoring workers map the arrays into memory and look
up the sorted distinct words and pairs of a batch, shard by shard.

Everything is counted over all training texts: nothing is pruned, sampled or capped. Only which
words are split as frequent is guessed, from a few thousand rows; that moves work, not results.

Null and empty texts are an end mark only. Rows without an id are training rows. An empty table
scores nothing; a model without training tokens gives every token the same chance.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base
from . import kernels as K

BEGIN, END = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
_SPLIT_SLOTS = 1 << 16
#: Bytes of text whose pairs are made distinct together before they are sent.
COUNTED = 20 << 20


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return K.mix64(v * np.uint64(0xD1342543DE82EF95) + w)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of each row the hash of the word before it and its own, and the offsets of rows."""
    data = K.LOWER[data]
    starts, ends, rows = K.word_spans(data, offsets, K.SPACES)
    h = K.hash_spans(data, starts, ends)
    n = len(offsets) - 1
    at = rows + np.arange(n + 1)  # a place for each end mark
    w = np.empty(len(h) + n, dtype=np.uint64)
    v = np.empty_like(w)
    ends_at = at[1:] - 1
    w[ends_at] = END
    inner = np.ones(len(w), dtype=bool)
    inner[ends_at] = False
    w[inner] = h
    v[1:] = w[:-1]
    v[at[:-1]] = BEGIN
    return v, w, at


def shard_of(x: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes."""
    return ((x >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pack_pairs(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    """Pairs sorted by v: distinct v with their run lengths, distinct w with indices, counts."""
    order = np.argsort(v, kind="stable")
    v, w, c = v[order], w[order], c[order]
    cut = np.concatenate(([0], np.flatnonzero(v[1:] != v[:-1]) + 1, [len(v)]))
    words, index = np.unique(w, return_inverse=True)
    parts = [v[cut[:-1]], np.diff(cut).astype(np.uint32), words, index.astype(np.uint16 if len(words) < 1 << 16 else np.uint32), c.astype(np.uint16 if c.max() < 1 << 16 else np.uint32)]
    head = np.array([len(p) for p in parts] + [p.itemsize for p in parts], dtype=np.uint32)
    return head.tobytes() + b"".join(p.tobytes() for p in parts)


def _unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    head = np.frombuffer(blob, dtype=np.uint32, count=10)
    at, parts = 40, []
    for n, size in zip(head[:5].tolist(), head[5:].tolist(), strict=True):
        parts.append(np.frombuffer(blob, dtype=f"u{size}", count=n, offset=at))
        at += n * size
    v, runs, words, index, c = parts
    return np.repeat(v, runs), words[index], c.astype(np.int64)


def _pack(cols: list[np.ndarray]) -> bytes:
    small = [c if c.dtype == np.uint64 else c.astype(np.uint8 if not len(c) or c.max() < 256 else np.uint16 if c.max() < 1 << 16 else np.uint64) for c in cols]
    return np.array([len(small[0]), *(c.itemsize for c in small)], dtype=np.uint32).tobytes() + b"".join(c.tobytes() for c in small)


def _unpack(blob: bytes, n_cols: int) -> list[np.ndarray]:
    head = np.frombuffer(blob, dtype=np.uint32, count=1 + n_cols)
    at, out = 4 * (1 + n_cols), []
    for size in head[1:].tolist():
        out.append(np.frombuffer(blob, dtype=f"u{size}", count=int(head[0]), offset=at).astype(np.uint64))
        at += int(head[0]) * size
    return out


def _sum_by(key: np.ndarray, cols: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1)) if len(key) else np.zeros(0, np.int64)
    return key[first], [np.add.reduceat(c[order], first) if len(first) else c for c in cols]


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """A file under its final name at once; a second attempt writes the same bytes."""
    temporary = f"{folder}/.{name}-{os.getpid()}-{os.urandom(6).hex()}"
    with open(temporary, "wb") as f:
        np.save(f, array)
    os.replace(temporary, f"{folder}/{name}.npy")


def local_path(path: str) -> str:
    """The mounted path of a folder; arrays can be mapped from nowhere else."""
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError("the shared folder must be mounted on all executors to map arrays from it")
    return path


#: Columns of the word arrays: times seen, words it follows, and of what follows it the total and how many came once, twice, more often.
WORD_COLS = ("raw", "before", "total", "once", "twice", "more")


def _count(shards: int, frequent: np.ndarray):
    """Map side: (shard, blob of distinct pairs with counts)."""
    split = np.zeros(_SPLIT_SLOTS, dtype=bool)
    split[frequent] = True

    def run(batches):
        for batch in base.gathered(batches, COUNTED):
            vs, ws = [], []
            for _, _, data, offsets in K.text_chunks(batch.column(0)):
                v, w, _ = tokens(data, offsets)
                vs.append(v)
                ws.append(w)
            if not vs:
                continue
            v, w = np.concatenate(vs), np.concatenate(ws)
            _, first, c = np.unique(pair_hash(v, w), return_index=True, return_counts=True)
            v, w = v[first], w[first]
            key = np.where(split[(v & np.uint64(_SPLIT_SLOTS - 1)).astype(np.int64)], K.mix64(v ^ w), v)
            shard = shard_of(key, shards)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            ids, blobs = [], []
            for s in np.flatnonzero(np.diff(cut)).tolist():
                of = order[cut[s] : cut[s + 1]]
                ids.append(s)
                blobs.append(_pack_pairs(v[of], w[of], c[of]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    return run


def _settle(shards: int, folder: str):
    """A shard's pairs: written as sorted arrays; on go facts of words, and counts of counts under shard 0."""

    def run(batches):
        mine: dict[int, list] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine.setdefault(s, []).append(_unpack_pairs(blob))
        for s, parts in mine.items():
            v, w, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            p = pair_hash(v, w)
            order = np.argsort(p, kind="stable")
            p = p[order]
            first = np.concatenate(([0], np.flatnonzero(p[1:] != p[:-1]) + 1))
            p, c = p[first], np.add.reduceat(c[order], first)
            v, w = v[order][first], w[order][first]
            _save(folder, f"pair-{s}-hash", p)
            _save(folder, f"pair-{s}-count", c.astype(np.uint32 if c.max() < 1 << 32 else np.uint64))
            zero, u = np.zeros(len(c), np.uint64), c.astype(np.uint64)
            kind = [(c == 1).astype(np.uint64), (c == 2).astype(np.uint64), (c > 2).astype(np.uint64)]
            words, seen = _sum_by(w, [u, zero + np.uint64(1)])
            heads, follows = _sum_by(v, [u, *kind])
            x = np.concatenate((words, heads))
            cols = [np.concatenate((seen[0], np.zeros(len(heads), np.uint64))), np.concatenate((seen[1], np.zeros(len(heads), np.uint64)))]
            cols += [np.concatenate((np.zeros(len(words), np.uint64), f)) for f in follows]
            x, cols = _sum_by(x, cols)
            to = shard_of(x, shards)  # x is sorted, so shards are runs
            cut = np.searchsorted(to, np.arange(shards + 1))
            ids = np.flatnonzero(np.diff(cut)).tolist()
            blobs = [_pack([x[cut[t] : cut[t + 1]], *(k[cut[t] : cut[t + 1]] for k in cols)]) for t in ids]
            counts = [int((c == k).sum()) for k in (1, 2, 3, 4)]
            del v, w, c, p, order, first, u, kind, words, seen, heads, follows, x, cols, to
            base.trim()
            yield pa.RecordBatch.from_arrays([pa.array([*ids, 0], pa.int32()), pa.array([*blobs, None], pa.binary()), *(pa.array([0] * len(ids) + [k], pa.int64()) for k in counts)], ["shard", "blob", "c1", "c2", "c3", "c4"])

    return run


_STATS = ("tokens", "types", "pairs", *(f"w{k}" for k in (1, 2, 3, 4)), "w_more", *(f"c{k}" for k in (1, 2, 3, 4)))


def _words(folder: str):
    """A shard's words: written as sorted arrays; sums for the discounts are returned."""

    def run(batches):
        mine: dict[int, list] = {}
        coc = np.zeros(4, dtype=np.int64)
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if blob is not None:
                    mine.setdefault(s, []).append(_unpack(blob, 1 + len(WORD_COLS)))
            coc += [int(batch.column(k).to_numpy().sum()) for k in range(2, 6)]
        out = np.zeros(8, dtype=np.int64)
        for s, parts in mine.items():
            x, *cols = (np.concatenate(k) for k in zip(*parts, strict=True))
            parts.clear()
            x, cols = _sum_by(x, cols)
            _save(folder, f"word-{s}-hash", x)
            for name, c in zip(WORD_COLS, cols, strict=True):
                _save(folder, f"word-{s}-{name}", c.astype(np.uint32) if not len(c) or c.max() < 1 << 32 else c)
            before = cols[1].astype(np.int64)
            out += [int(cols[0].sum()), int((cols[0] > 0).sum()), int(before.sum()), *(int((before == k).sum()) for k in (1, 2, 3, 4)), int((before > 2).sum())]
        row = [*out.tolist(), *coc.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()) for k in row], list(_STATS))

    return run


class Discounts:
    """The three discounts of modified Kneser-Ney from counts of counts; where those are too few to tell, halves of the count."""

    def __init__(self, n: list[int]):
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
        d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] and y else (k + 1) / 2 for k in range(3)]
        self.of = np.array([0.0, *(min(max(x, 1e-3), k + 1 - 1e-3) for k, x in enumerate(d))])

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return self.of[np.minimum(c, 3)]


class Model:
    """Where the arrays are, and the few numbers that go with them."""

    def __init__(self, folder: str, shards: int, stats: dict[str, int], frequent: np.ndarray):
        self.folder, self.shards, self.stats, self.frequent = folder, shards, stats, frequent
        self.pair_discounts = Discounts([stats[f"c{k}"] for k in (1, 2, 3, 4)])
        self.word_discounts = Discounts([stats[f"w{k}"] for k in (1, 2, 3, 4)])
        d, pairs = self.word_discounts.of, max(1, stats["pairs"])
        self.word_rest = (d[1] * stats["w1"] + d[2] * stats["w2"] + d[3] * stats["w_more"]) / pairs if stats["pairs"] else 1.0


def train(docs: DataFrame, shards: int | None = None) -> Model:
    """The model of all texts of docs (text)."""
    spark = docs.sparkSession
    base.ship(spark)
    shards = shards or base.parts(spark)
    folder = local_path(base.new_path(spark, "kneser-ney"))
    os.makedirs(folder, exist_ok=True)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    frequent = _frequent(texts)
    pairs = texts.mapInArrow(_count(shards, frequent), "shard int, blob binary").repartitionById(shards, F.col("shard"))
    facts = pairs.mapInArrow(_settle(shards, folder), "shard int, blob binary, c1 long, c2 long, c3 long, c4 long").repartitionById(shards, F.col("shard"))
    sums = facts.mapInArrow(_words(folder), ", ".join(f"{c} long" for c in _STATS)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _STATS)).first()
    return Model(folder, shards, sums.asDict(), frequent)


def _frequent(texts: DataFrame, rows: int = 3000, share: float = 1 / 500) -> np.ndarray:
    """Slots of words that are at least that share of the tokens of a few rows; there are at most 1 / share."""

    def run(batches):
        for batch in batches:
            n = np.zeros(_SPLIT_SLOTS, dtype=np.int64)
            for _, _, data, offsets in K.text_chunks(batch.column(0)):
                n += np.bincount((tokens(data, offsets)[0] & np.uint64(_SPLIT_SLOTS - 1)).astype(np.int64), minlength=_SPLIT_SLOTS)
            at = np.flatnonzero(n >= max(1, n.sum() * share))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], ["slot"])

    return np.array(sorted({r[0] for r in texts.limit(rows).mapInArrow(run, "slot long").distinct().limit(5000).collect()}), dtype=np.int64)


class Arrays:
    """Sorted arrays of all shards, mapped into memory as they are asked for."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def _get(self, name: str):
        if name not in self.open:
            path = f"{self.model.folder}/{name}.npy"
            self.open[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.open[name]

    def find(self, what: str, hashes: np.ndarray, shard: np.ndarray, cols: tuple[str, ...]) -> list[np.ndarray]:
        """Of distinct hashes in the order of their shards and sizes: the columns, 0 where a hash isn't held."""
        out = [np.zeros(len(hashes), dtype=np.int64) for _ in cols]
        cut = np.searchsorted(shard, np.arange(self.model.shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            held = self._get(f"{what}-{s}-hash")
            if held is None:
                continue
            of = hashes[cut[s] : cut[s + 1]]
            at = np.minimum(np.searchsorted(held, of), len(held) - 1)
            hit = np.flatnonzero(held[at] == of)
            for o, c in zip(out, cols, strict=True):
                o[cut[s] + hit] = self._get(f"{what}-{s}-{c}")[at[hit]]
        return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of docs (doc_id, text)."""
    base.ship(docs.sparkSession)

    def run(batches):
        arrays, st = Arrays(model), model.stats
        split = np.zeros(_SPLIT_SLOTS, dtype=bool)
        split[model.frequent] = True
        floor = np.log10(st["tokens"] + 0.5 * (st["types"] + 1))
        for batch in base.gathered(batches):
            ns, ks, bs, ss = [], [], [], []
            for _, _, data, offsets in K.text_chunks(batch.column(1), 4 * K.CHUNK):
                v, w, at = tokens(data, offsets)
                x, back = np.unique(np.concatenate((w, np.array([BEGIN]))), return_inverse=True)
                raw, before, total, once, twice, more = arrays.find("word", x, shard_of(x, model.shards), WORD_COLS)
                back, begin = back[:-1], back[-1]
                prev = np.empty_like(back)
                prev[1:] = back[:-1]
                prev[at[:-1]] = begin
                alone = np.maximum(before - model.word_discounts(before), 0) / max(1, st["pairs"]) + model.word_rest / (st["types"] + 1)
                d = model.pair_discounts.of
                rest = np.where(total > 0, (d[1] * once + d[2] * twice + d[3] * more) / np.maximum(total, 1), 1.0)
                p, first, pair = np.unique(pair_hash(v, w), return_index=True, return_inverse=True)
                key = np.where(split[(v[first] & np.uint64(_SPLIT_SLOTS - 1)).astype(np.int64)], K.mix64(v[first] ^ w[first]), v[first])
                shard = shard_of(key, model.shards)
                order = np.argsort(shard, kind="stable")
                (c,) = arrays.find("pair", p[order], shard[order], ("count",))
                count = np.empty_like(c)
                count[order] = c
                head, tail = prev[first], back[first]
                chance = np.maximum(count - model.pair_discounts(count), 0) / np.maximum(total[head], 1) + rest[head] * alone[tail]
                ns.append(np.diff(at))
                ks.append(np.add.reduceat((raw > 0)[back].astype(np.int64), at[:-1]))
                bs.append(np.add.reduceat((np.log10(raw + 0.5) - floor)[back], at[:-1]))
                ss.append(np.add.reduceat(np.log10(chance)[pair], at[:-1]))
            if ns:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(k)) for k in (ns, ks, bs, ss))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out() -> Column:
    return F.coalesce(base.crc_mod("doc_id", 5) == 1, F.lit(False))


def train_and_score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    model = train(docs.where(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(int(model.stats["tokens"])).cast("long").alias("train_tokens"), "base_score", "score")
