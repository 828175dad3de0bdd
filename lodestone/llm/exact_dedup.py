"""Operator 5: exact duplicates, owned by Patricia tries.

Rows are keyed by length and content hash (SHA-256, and a second hash that tells texts of one SHA-256
apart). Only texts whose key more than one row has can have copies; they alone are shuffled, after
every map task has merged its own copies in a trie. Each length-and-hash partition then inserts the full
byte strings in a compressed radix trie, whose terminal nodes hold the owner's identifier, how many rows
have that identifier, and the number of copies: these give keep_id, group_size and kept. When a trie
outgrows its memory, its largest subtree is spilled to the task's local disk (which Spark gives it for
that; a lost task begins anew) and settled afterwards.

Texts are equal when all bytes are; null counts as empty. The largest id owns a group (the
terminal keeps it in the place of the smallest). Of rows that repeat an id and a text, one is
kept. A null id is smaller than all others. If two different texts should ever share both hashes, the
tries see it and the job stops rather than merge them.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base


def _common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Node:
    __slots__ = ("label", "kids", "owner", "count", "spill")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner, self.count, self.spill = label, {}, None, 0, None


class PatriciaTrie:
    """Byte strings with an owner and a count at each terminal.

    `better(a, b)` chooses the owner of two. `budget` is in bytes of labels and nodes; beyond it
    the largest subtree below the root moves to a file, and strings that lead there follow it.
    """

    NODE = 200

    def __init__(self, better=min, budget: int = 64 << 20, folder: str | None = None):
        self.root, self.better, self.budget, self.size, self.folder, self.spills = Node(b""), better, budget, 0, folder, 0

    def add(self, key: bytes, owner, count: int = 1) -> None:
        node, at, end = self.root, 0, len(key)
        while at < end:
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                self.size += end - at + self.NODE
                node = kid
                break
            if kid.spill is not None:
                pickle.dump((key, owner, count), kid.spill, -1)
                return
            n = _common(kid.label, key[at : at + len(kid.label)])
            if n < len(kid.label):
                upper = Node(kid.label[:n])
                kid.label = kid.label[n:]
                upper.kids[kid.label[0]] = kid
                node.kids[key[at]] = upper
                self.size += self.NODE
                kid = upper
            node, at = kid, at + n
        node.owner = owner if not node.count else self.better(node.owner, owner)
        node.count += count
        if self.size > self.budget:
            self._spill()

    def _walk(self, node: Node, above: bytes) -> Iterator[tuple[bytes, Node]]:
        stack = [(node, above)]
        while stack:
            x, before = stack.pop()
            key = before + x.label
            yield key, x
            stack += [(k, key) for k in x.kids.values()]

    def _spill(self) -> None:
        """Writes the largest subtree below the root, or below the first fork if the root has one way only."""
        parent, above = self.root, b""
        while len(parent.kids) == 1 and not parent.count:
            kid = next(iter(parent.kids.values()))
            if kid.spill is not None or not kid.kids:
                break
            parent, above = kid, above + kid.label
        best, weight = None, -1
        for kid in parent.kids.values():
            if kid.spill is None:
                w = sum(len(x.label) + self.NODE for _, x in self._walk(kid, b""))
                if w > weight:
                    best, weight = kid, w
        if best is None:
            return
        file = tempfile.TemporaryFile(dir=self.folder)
        for key, x in self._walk(best, above):
            if x.count:
                pickle.dump((key, x.owner, x.count), file, -1)
        best.kids, best.spill, best.count = {}, file, 0
        best.label = best.label[:1]
        self.size -= weight
        self.spills += 1

    def items(self) -> Iterator[tuple[bytes, object, int]]:
        """(key, owner, count) of each distinct string; spilled subtrees come last, a trie each."""
        spilled = []
        for key, x in self._walk(self.root, b""):
            if x.spill is not None:
                spilled.append(x)
            elif x.count:
                yield key, x.owner, x.count
        for x in spilled:
            # a subtree larger than memory as a whole is split again, at a deeper fork
            sub = PatriciaTrie(self.better, max(self.budget, 1 << 16) * 2, self.folder)
            x.spill.seek(0)
            while True:
                try:
                    sub.add(*pickle.load(x.spill))
                except EOFError:
                    break
            x.spill.close()
            yield from sub.items()


def _best(a: tuple, b: tuple) -> tuple:
    """Of two (id, rows that have it, key) the one with the larger id; of one id the rows are added up."""
    if a[0] == b[0]:
        return a[0], a[1] + b[1], a[2]
    return b if a[0] is None or (b[0] is not None and b[0] > a[0]) else a


def _local_folder() -> str | None:
    """Where Spark itself spills for this task."""
    for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(","):
        if d and os.path.isdir(d):
            return d
    return None


def _tries(final: bool, budget: int):
    """Texts of a task in a trie: (key, bytes [but in the end], owner, owner_rows, copies) of each distinct one."""

    def run(batches):
        def emit(trie):
            rows, size = [], 0
            for text, (owner, owner_rows, key), copies in trie.items():
                rows.append((key, None if final else text, owner, owner_rows, copies))
                size += len(text)
                if len(rows) >= 5000 or size > 8 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

        def batch_of(rows):
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays(cols, ["_key", "_bytes", "owner", "owner_rows", "copies"])

        trie = PatriciaTrie(_best, budget, _local_folder())
        for batch in base.gathered(batches):
            for key, text, owner, owner_rows, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie.add(text, (owner, owner_rows, key), copies)
            if not final and trie.spills:  # a full map-side trie passes on what it has
                yield from emit(trie)
                trie = PatriciaTrie(_best, budget, _local_folder())
        yield from emit(trie)

    return run


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _key(text: Column) -> Column:
    """SHA-256, and a second hash: 40 bytes."""
    return F.concat(_sha(text), F.unhex(F.lpad(F.hex(F.xxhash64(text)), 16, "0")))


def _owners(docs: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Tables of all rows (doc_id, _length, _key, _row) and of the texts that come more than once (_key, owner, owner_rows, copies, _first)."""
    spark = docs.sparkSession
    base.ship(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.text_of().alias("_text"))
    keyed = plain.select("doc_id", F.octet_length("_text").cast("long").alias("_length"), _key(F.col("_text")).alias("_key"))
    rows = base.table(keyed.withColumn("_row", F.monotonically_increasing_id()), "dedup-keys")
    # a key that one row has needs no trie: such a text owns itself
    many = base.table(rows.groupBy("_length", "_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key"), "dedup-groups")
    texts = base.passing(plain.select("doc_id", "_text", _key(F.col("_text")).alias("_key")), F.col("_key"), many)
    kind = "_key binary, _bytes binary, owner long, owner_rows long, copies long"
    one = F.lit(1).cast("long")
    merged = texts.select("_key", F.col("_text").cast("binary").alias("_bytes"), F.col("doc_id").alias("owner"), one.alias("owner_rows"), one.alias("copies")).mapInArrow(_tries(False, budget), kind)
    spread = merged.repartition(base.parts(spark), F.octet_length("_bytes"), "_key")
    owners = base.table(spread.mapInArrow(_tries(True, budget), kind).drop("_bytes").where("copies > 1"), "dedup-owners")
    twice = owners.groupBy("_key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (twice or 0) > 1:
        raise RuntimeError("different texts share both hashes")
    # where an id comes more than once in its group, the first of its rows stays
    again = base.table(owners.where("owner_rows > 1").select("_key", "owner", "copies"), "dedup-repeats")
    first = base.attach(base.passing(rows, F.col("_key"), again.select("_key")), again, ["_key"], "copies", "inner").where(F.col("doc_id").eqNullSafe(F.col("owner")))
    first = first.groupBy("_key").agg(F.min("_row").alias("_first"))
    return rows, base.table(owners.join(first, "_key", "left"), "dedup-facts")


def exact_duplicates(docs: DataFrame, budget: int = 64 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text).

    budget: bytes of a task's trie before it spills.
    """
    rows, facts = _owners(docs, budget)
    out = base.attach(rows, facts, ["_key"], "copies")
    alone = F.col("copies").isNull()
    kept = alone | F.when(F.col("_first").isNotNull(), F.col("_row") == F.col("_first")).otherwise(F.col("doc_id").eqNullSafe(F.col("owner")))
    sha = F.lower(F.hex(F.substring("_key", 1, 32)))
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("owner")).alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), sha.alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, budget: int = 64 << 20) -> DataFrame:
    """docs without the copies that exact_duplicates() doesn't keep."""
    _, facts = _owners(docs, budget)
    contested = base.table(facts.select(F.col("_key").alias("key"), F.col("owner").alias("keeper"), F.lit(True).alias("keeps"), F.col("copies").alias("n")), "contested")
    return base.retain(docs, _key(base.text_of()), contested)
