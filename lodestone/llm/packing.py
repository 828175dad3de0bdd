"""Operator 1: best-fit packing of token pieces by minimum bin slack.

Packing depends on lengths alone, and a length is at most the limit, so the corpus is planned
from its histogram of lengths (at most `limit` rows at any size). For each bin the largest length
left is set, and a bitset subset-sum dynamic programme over the lengths still available finds the
fullest combination that goes with it; the combination is then taken as often as the counts
allow. Where that needs more sequences than a lower bound, the same programme is run by classes of
lengths, and bins with room are emptied and filled to the fullest again in other orders. Pieces get
their place from their rank among the pieces of their length.

Ids are those of the tokenizers library without special tokens added around a text; added tokens that
a text itself spells (such as an end-of-text mark) are one token each, as the library has it.

Nulls and empty texts are one end token. A document of any length is cut; one row may repeat
another, and each row is packed by itself. An empty table gives no rows. Columns other than the
id and the text are not looked at.
"""

from __future__ import annotations

import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base, bpe

LIMIT, END = 4096, 1


def normal(text: str) -> str:
    """The vocabulary's normal form: NFC, and lower case letter by letter."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 [, ids array<int>] of every piece of every document.

    A document's ids by the vocabulary at `path`, then `end`; cut each `limit` ids.
    """
    base.ship(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches):
        store, added = bpe.words(path), bpe.added_tokens(path)
        for batch in base.gathered(batches, bpe.REPLAY):
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            kept = []
            doc_ids = batch.column(0).to_pylist()

            def put(row: int, own: np.ndarray) -> None:
                raw = own.tobytes()
                for p, s in enumerate(range(0, len(own), limit)):
                    out["doc_id"].append(doc_ids[row])
                    out["piece"].append(p)
                    out["start"].append(s)
                    out["length"].append(min(limit, len(own) - s))
                    out["ids_crc32"].append(zlib.crc32(raw[4 * s : 4 * (s + limit)]))
                    if keep_ids:
                        kept.append(own[s : s + limit].astype(np.int32))

            # rows that spell added tokens are encoded in parts; a part knows its row and the id that follows it
            parts, row_of, after = [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                for text, follows in added.split(t or ""):
                    parts.append(normal(text))
                    row_of.append(r)
                    after.append(follows)
            texts, held = pa.array(parts, pa.large_string()), []
            for lo, hi, enc in bpe.encode_rows(store, texts, False):
                ids, at = enc.ids().astype("<u4"), enc.row_tokens
                for k in range(hi - lo):
                    held.append(ids[at[k] : at[k + 1]])
                    if after[lo + k] is not None:
                        held.append(np.array([after[lo + k]], dtype="<u4"))
                        continue
                    held.append(np.array([end], dtype="<u4"))
                    put(row_of[lo + k], np.concatenate(held).astype("<u4"))
                    held = []
            cols = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32"))]
            names = list(out)
            if keep_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


Plan = list[tuple[list[tuple[int, int]], int]]


def _fullest(left: dict[int, int], lengths: list[int], room: int) -> tuple[dict[int, int], int, int]:
    """The fullest combination of the lengths (how many of each there are: left) that fits the room; its sum, and the steps it took.

    A bitset of reachable sums grows by each length in the order given, a length's number in powers of
    two; of equally full combinations the one with the earlier lengths is taken.
    """
    mask, goal, reach = (1 << (room + 1)) - 1, 1 << room, 1
    steps: list[tuple[int, int, int]] = []  # length, how many at once, what was reachable before
    for length in lengths:
        if length > room:
            continue
        n, many = min(left.get(length, 0), room // length), 1
        while n > 0 and not reach & goal:
            take = min(many, n)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            n -= take
            many *= 2
        if reach & goal:
            break
    at = full = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not at:
            break
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used, full, len(steps)


class _Work:
    """Steps of the subset-sum programme that a search may still take."""

    def __init__(self, steps: int):
        self.left = steps


def plan(counts: dict[int, int], limit: int = LIMIT, classes: int = 1, rng: random.Random | None = None, work: _Work | None = None) -> Plan:
    """[(combination [(length, how many)], how many bins)] that uses up the counts of lengths.

    Each bin gets the largest length left, then the fullest combination of what is left that fits
    its room. With more classes, lengths are parted by size (bounds at equal parts of the limit) and a
    bin is filled to the fullest from the larger ones before the smaller ones are asked, so that small
    pieces last longer. A random generator varies the order of lengths, that is, which of equally full
    combinations is taken.
    """
    left = {k: n for k, n in sorted(counts.items(), reverse=True) if n > 0}
    if any(k < 1 or k > limit for k in left):
        raise ValueError("lengths must be between 1 and the limit")
    out: Plan = []
    while left:
        first = next(iter(left))
        bin_, room = {first: 1}, limit - first
        left[first] -= 1
        fit = [k for k in left if k <= room and left[k]]
        if rng is not None:
            rng.shuffle(fit)
        groups: dict[int, list[int]] = {}
        for k in fit:
            groups.setdefault((k - 1) * classes // limit, []).append(k)
        for c in sorted(groups, reverse=True):
            if not room:
                break
            used, full, steps = _fullest(left, groups[c], room)
            room -= full
            for k, m in used.items():
                bin_[k] = bin_.get(k, 0) + m
            if work is not None:
                work.left -= steps
        left[first] += 1
        if work is not None:
            work.left -= 10 + len(left)
        times = min(left[k] // m for k, m in bin_.items())
        out.append((sorted(bin_.items(), reverse=True), times))
        for k, m in bin_.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
    return out


def lower_bound(counts: dict[int, int], limit: int = LIMIT) -> int:
    """Bins that any plan needs: for each bound a, pieces above limit - a are alone, those above half the limit
    have a bin each, and what of the pieces from a to half the limit doesn't fit beside them needs more."""
    kinds = sorted(counts.items())
    best = -(-sum(k * n for k, n in kinds) // limit)
    for a in [0, *(k for k, _ in kinds if 2 * k <= limit)]:
        alone = sum(n for k, n in kinds if k > limit - a)
        halves = [(k, n) for k, n in kinds if 2 * k > limit and k <= limit - a]
        beside = sum((limit - k) * n for k, n in halves)
        small = sum(k * n for k, n in kinds if a <= k and 2 * k <= limit)
        best = max(best, alone + sum(n for _, n in halves) + max(0, -(-(small - beside) // limit)))
    return best


def _bins(p: Plan) -> int:
    return sum(n for _, n in p)


def _weight(p: Plan) -> int:
    return sum(n * sum(k * m for k, m in c) ** 2 for c, n in p)


def _merged(p: Plan) -> Plan:
    out: dict[tuple[tuple[int, int], ...], int] = {}
    for c, n in p:
        out[tuple(c)] = out.get(tuple(c), 0) + n
    return [(list(c), n) for c, n in out.items()]


def improved(found: Plan, limit: int, goal: int, work: _Work) -> Plan:
    """A plan with no more bins: bins with room and some full ones are emptied and filled anew, to the fullest but in
    another order, until `goal` bins are reached or the work is used up. A new filling stays if it needs fewer
    bins, or as many with the room in fewer of them."""
    rng = random.Random(4096)
    found = _merged(found)
    while work.left > 0 and _bins(found) > goal:
        loose = [i for i, (c, _) in enumerate(found) if sum(k * m for k, m in c) < limit]
        share, some = rng.random(), rng.random() ** 2
        taken = {i: found[i][1] if rng.random() < 0.5 else rng.randint(1, found[i][1]) for i in loose if rng.random() < 0.3 + share}
        for i, (_, n) in enumerate(found):
            if i not in taken and rng.random() < some:
                taken[i] = rng.randint(1, n)
        old = [(found[i][0], n) for i, n in taken.items()]
        counts: dict[int, int] = {}
        for c, n in old:
            for k, m in c:
                counts[k] = counts.get(k, 0) + m * n
        work.left -= 20 + len(found) + len(counts)
        new = plan(counts, limit, rng.choice((1, 1, 1, 2, 4)), rng, work)
        if (_bins(new), -_weight(new)) <= (_bins(old), -_weight(old)):
            rest = [(c, n - taken.get(i, 0)) for i, (c, n) in enumerate(found)]
            found = _merged([(c, n) for c, n in [*rest, *new] if n])
    return found


#: Steps of the search for a plan with fewer bins.
WORK = 200_000


def best_plan(counts: dict[int, int], limit: int = LIMIT, steps: int = WORK) -> Plan:
    """Minimum bin slack with as few bins as its search finds.

    One class first; where that needs more bins than the lower bound, 8, 64, ... classes up to one a
    length, and the best of these is then improved. Every plan fills bin by bin to the fullest.
    """
    goal = lower_bound(counts, limit)
    best, classes = plan(counts, limit), 8
    while _bins(best) > goal and classes < 8 * limit:
        other = plan(counts, limit, min(classes, limit))
        if _bins(other) < _bins(best):
            best = other
        classes *= 8
    return improved(best, limit, goal, _Work(steps)) if _bins(best) > goal else best


def places(plan_: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Per length and interval of ranks: the first bin, how many a bin holds, and the offset of the first of them."""
    rows, used, first_bin = [], {}, 0
    for combination, times in plan_:
        offset = 0
        for length, m in combination:
            rows.append((length, used.get(length, 0), m, first_bin, offset))
            used[length] = used.get(length, 0) + m * times
            offset += length * m
        first_bin += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 44) | a[:, 1], "from": a[:, 1], "each": a[:, 2], "bin": a[:, 3], "offset": a[:, 4]}


def pack(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """found (a table with doc_id, piece, length and more) with sequence_id and offset.

    Ranks are counted inside (length, shard of ids), then shifted by the counts of the shards
    before, so that a length that most pieces have is spread over all tasks.
    """
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `limit` rows
    where = places(best_plan(histogram, limit))
    shards = base.parts(found.sparkSession)
    sharded = found.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    shift = sharded.groupBy("length", "_shard").agg(F.count("*").alias("_n")).select("length", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ranked = sharded.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_shard").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(shift, ["length", "_shard"]).withColumn("_rank", F.col("_rank") + F.col("_shift")).drop("_shard", "_shift").select(*found.columns, "_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("_rank").to_numpy().astype(np.int64)
            at = np.searchsorted(where["key"], (length << 44) | rank, side="right") - 1
            nth = rank - where["from"][at]
            each = where["each"][at]
            cols = [batch.column(c) for c in batch.schema.names if c != "_rank"]
            names = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(where["bin"][at] + nth // each), pa.array(where["offset"][at] + nth % each * length)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, keep_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most `limit` tokens; see pieces() and pack()."""
    return pack(base.table(pieces(docs, path, limit, end, keep_ids), "pieces"), limit)
