"""Operator 10: near duplicates of embeddings by random-hyperplane hashing.

Vectors are compared when their labels are equal and not null. Equal vectors are one node. Signs
of random projections give each node a code in each of several tables; the bits grow with the
largest label so that buckets stay small, and the tables are as many as the target recall at the
threshold asks for. Only (bucket, node, SKETCH signs) is exchanged: nodes of one bucket whose
sketches differ in no more signs than a pair at the threshold may are candidates, in blocks of
bounded size, and a block returns a spanning forest of them, never its pairs. Each vector is then
sent once to the place of its connected component of candidates (large components in blocks of
bounded bytes) and compared there with all others of the component by cosine in double precision. A
block returns counts of links and a spanning forest of them; connected components of the links
are found in rounds.

A vector that is null, empty, zero, or holds a null, NaN or infinity links with nothing, nor does one
without a label; vectors of different length never link. Vectors are scaled by a power of two, so
that squares neither overflow nor vanish. Rows that repeat are vectors of their own and link with each
other. A row without links is its own component.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Nodes of a bucket that are paired in one go, and vectors' bytes of a block of a component.
BLOCK, BLOCK_BYTES = 768, 8 << 20
#: Signs that tell in a bucket whether two nodes may be near, in two words.
SKETCH = 128
#: Nodes of the largest label in a bucket, as a mean.
BUCKET = 128


def tables_for(threshold: float, recall: float, largest: int) -> tuple[int, int]:
    """(tables, bits): bits for buckets of about BUCKET of the largest label, tables for the recall of a pair at the threshold."""
    bits = min(24, max(4, math.ceil(math.log2(max(1, largest) / BUCKET)) if largest > BUCKET else 4))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-p))), bits


def most_different(threshold: float, miss: float) -> int:
    """Signs of SKETCH that a pair at the threshold differs in at most, but for a chance of `miss`."""
    p, left, d = math.acos(threshold) / math.pi, 1.0, 0
    while d < SKETCH:
        left -= math.comb(SKETCH, d) * p**d * (1 - p) ** (SKETCH - d)
        if left <= miss:
            break
        d += 1
    return d


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1; exact."""
    _, e = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -e[:, None])


def _signs(x: np.ndarray, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, tables) codes, and (rows, 2) words of the sketch; the first signs serve both."""
    n = max(SKETCH, tables * bits)
    planes = np.random.default_rng(20_000 + x.shape[1]).standard_normal((n, x.shape[1]))
    signs = (x @ planes.T) >= 0
    codes = (signs[:, : tables * bits].reshape(len(x), tables, bits) * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)
    return codes, np.packbits(signs[:, :SKETCH], axis=1).view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_size(column: pa.Array):
    """(rows, matrix) of vectors of one length at a time."""
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    for d in np.unique(size):
        of = np.flatnonzero(size == d)
        yield of, _matrix(column.take(pa.array(of)))


def _coded(tables: int, bits: int):
    """_row, vec_id, space, vector to _row, vec_id, space, two words of a key of the vector, its sketch and codes."""

    def run(batches):
        for batch in base.gathered(batches):
            n, column = len(batch), batch.column("vector")
            space = batch.column("space").to_numpy()
            codes, words, key = np.zeros((n, tables), np.int32), np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
            for of, x in _by_size(column):
                codes[of], words[of] = _signs(_scaled(x), tables, bits)
                x += 0.0  # one zero
                key[of] = np.frombuffer(b"".join(hashlib.blake2b(r.tobytes() + s.tobytes(), digest_size=16).digest() for r, s in zip(x, space[of], strict=True)), dtype=np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * tables, pa.int32()), pa.array(codes.ravel()))
            cols = [batch.column("_row"), batch.column("vec_id"), batch.column("space"), *(pa.array(np.ascontiguousarray(m[:, k])) for m in (key, words) for k in (0, 1)), lists]
            yield pa.RecordBatch.from_arrays(cols, ["_row", "vec_id", "space", "k0", "k1", "s0", "s1", "codes"])

    return run


def _near_sketches(most: int):
    """Rows (h, i, j, own, node, s0, s1), sorted by bucket and block, to stars of candidates (src, dst)."""

    def run(batches):
        for (_, i, j, own, node, s0, s1), at in base.whole_runs(batches, ["h", "i", "j", "own", "node", "s0", "s1"], 3):
            s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
            run_end = np.repeat(at[1:], np.diff(at))
            live, k, out_a, out_b, held = np.arange(len(node)), 1, [], [], 0
            while len(live):
                live = live[live + k < run_end[live]]
                x, y = live, live + k
                ok = np.bitwise_count(s0[x] ^ s0[y]) + np.bitwise_count(s1[x] ^ s1[y]) <= most
                x, y = x[ok], y[ok]
                ok = (i[x] == j[x]) | (own[x] != own[y])
                out_a.append(node[x[ok]])
                out_b.append(node[y[ok]])
                held += len(out_a[-1])
                k += 1
                if held > 500_000:
                    a, b = base.spanning(np.concatenate(out_a), np.concatenate(out_b))
                    out_a, out_b, held = [a], [b], 0
            if out_a:
                a, b = base.spanning(np.concatenate(out_a), np.concatenate(out_b))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])

    return run


def _candidates(nodes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Edges (src, dst) that connect what candidate pairs of nodes (node, space, s0, s1, codes) connect."""
    met = nodes.select("node", "s0", "s1", "space", F.posexplode("codes").alias("t", "code"))
    met = met.select(F.xxhash64("space", "t", "code").alias("h"), "node", "s0", "s1")
    sizes = base.table(met.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1"), "buckets")
    met = base.attach(met, sizes, ["h"], "_n", "inner")
    blocks = F.ceil(F.col("_n") / F.lit(BLOCK)).cast("int")
    met = met.withColumn("_blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", "h"), F.col("_blocks").cast("long")).cast("int"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.select("h", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "node", "s0", "s1")
    met = met.repartition(base.parts(nodes.sparkSession), "h", "i", "j").sortWithinPartitions("h", "i", "j")
    return base.table(met.mapInArrow(_near_sketches(most_different(threshold, miss)), "src long, dst long"), "near-sketches")


def _compare(x: np.ndarray, times: np.ndarray, own: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row, counted by the rows' times, and for each row the least row that its links reach. With `cross` only rows of different blocks are compared."""
    x = _scaled(x)
    norm = np.sqrt((x * x).sum(axis=1))
    n, tile = len(x), max(1, (1 << 22) // max(1, len(x)))
    count, label = np.zeros(n, dtype=np.int64), np.arange(n)
    for lo in range(0, n, tile):
        hi = min(n, lo + tile)
        linked = (x[lo:hi] @ x.T) >= threshold * norm[lo:hi, None] * norm[None, :]
        if cross:
            linked &= own[lo:hi, None] != own[None, :]
        linked[np.arange(hi - lo), np.arange(lo, hi)] = False
        count[lo:hi] = linked @ times
        while True:  # one link of each row that leads out of its component so far, until none does
            apart = linked & (label[lo:hi, None] != label[None, :])
            rows = np.flatnonzero(apart.any(axis=1))
            if not len(rows):
                break
            u, v = base.spanning(label[lo + rows], label[apart[rows].argmax(axis=1)])
            to = np.arange(n)
            to[u] = v
            label = to[label]
    return count, label


def _blocks(threshold: float):
    """Groups of rows (component, i, j, ...) to counts (a, null, n) and a forest of links (a, b, 0)."""

    def settle(t: pa.Table, out: tuple[list, list, list]) -> None:
        space = t.column("space").to_numpy()
        for s in np.unique(space):  # one, but where hashes collide
            g = t.filter(pa.array(space == s))
            node, own, times = (g.column(c).to_numpy() for c in ("node", "own", "n"))
            count, label = _compare(_matrix(g.column("vector").combine_chunks()), times, own, g.column("i")[0] != g.column("j")[0], threshold)
            for k in np.flatnonzero(count).tolist():
                out[0].append(int(node[k]))
                out[1].append(None)
                out[2].append(int(count[k]))
            for k in np.flatnonzero(label != np.arange(len(label))).tolist():
                out[0].append(int(node[k]))
                out[1].append(int(node[label[k]]))
                out[2].append(0)

    def run(batches):
        rest, kinds = None, ["component", "i", "j"]
        sent = lambda out: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "n"])
        for batch in base.gathered(batches):
            t = pa.Table.from_batches([batch])
            t = t if rest is None or not len(rest) else pa.concat_tables([rest, t])
            at = base.bounds([t.column(c).to_numpy() for c in kinds], 3)
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip(at[:-2].tolist(), at[1:-1].tolist(), strict=True):
                settle(t.slice(a, b - a), out)
            rest = t.slice(int(at[-2]))
            yield sent(out)
        if rest is not None and len(rest):
            settle(rest, out := ([], [], []))
            yield sent(out)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.9999) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    base.ship(spark)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    e = F.col("embedding").cast(kind)
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, e).alias("vector"), F.xxhash64(F.col("label").cast("string"), F.size(e)).alias("space")).withColumn("_row", F.monotonically_increasing_id())
    rows = base.table(rows, "vectors")
    usable = rows.where("vector is not null")
    largest = usable.groupBy("space").agg(F.approx_count_distinct(F.xxhash64("vector")).alias("n")).agg(F.max("n")).first()[0] or 0
    tables, bits = tables_for(threshold, 1 - (1 - recall) * 0.9, largest)
    coded = usable.select("_row", "vec_id", "space", "vector").mapInArrow(_coded(tables, bits), "_row long, vec_id long, space long, k0 long, k1 long, s0 long, s1 long, codes array<int>")
    coded = base.table(coded, "vector-codes")
    first = F.min(F.struct(F.coalesce(F.col("vec_id"), F.lit(2**63 - 1)).alias("_id"), F.col("_row"))).alias("_first")
    nodes = coded.groupBy("k0", "k1").agg(F.count("*").alias("n"), first, *(F.first(c).alias(c) for c in ("space", "s0", "s1", "codes")))
    nodes = base.table(nodes.select(F.col("_first._row").alias("node"), F.col("_first._id").alias("_id"), "k0", "k1", "n", "space", "s0", "s1", "codes"), "vector-nodes")
    near = _candidates(nodes, threshold, (1 - recall) * 0.1)
    homes = base.components(near)
    base.drop_table(near)
    # each vector of a component once, or once for each two blocks of a large one
    sizes = base.table(homes.groupBy("component").agg(F.count("*").alias("_n")), "component-sizes")
    homes = base.attach(homes, sizes, ["component"], "_n", "inner").join(nodes.select("node", "n"), "node")
    held = usable.select(F.col("_row").alias("node"), "space", "vector")
    held = base.passing(held, F.col("node"), homes.select("node")).join(homes, "node")
    blocks = F.ceil(F.col("_n") * F.size("vector") * 8 / F.lit(BLOCK_BYTES)).cast("int")
    held = held.withColumn("_blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("_blocks").cast("long")).cast("int"))
    held = held.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    held = held.select("component", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "node", "n", "space", "vector")
    order = ["component", "i", "j"]
    found = held.repartition(base.parts(spark), *order).sortWithinPartitions(*order).mapInArrow(_blocks(threshold), "a long, b long, n long")
    found = base.table(found, "vector-links")
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("_links"))
    groups = base.components(found.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    known = nodes.select("node", "_id", "k0", "k1", "n").join(degree, "node", "left").join(groups, "node", "left").withColumn("_group", F.coalesce("component", "node"))
    least = known.groupBy("_group").agg(F.min("_id").alias("_least"))
    facts = base.table(known.join(least, "_group").select("k0", "k1", "n", (F.coalesce("_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "_least"), "vector-facts")
    base.drop_table(found)
    out = base.attach(coded.select("vec_id", "k0", "k1"), facts, ["k0", "k1"], "n", "inner").select("vec_id", "n_links", F.col("_least").alias("component_id"))
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone)
    component = F.when(F.col("component_id") < 2**63 - 1, F.col("component_id"))
    return out.select("vec_id", "n_links", component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
