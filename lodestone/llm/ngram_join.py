"""Operator 9: n-gram Jaccard self-join by MinHash banding.

Words are runs of letters, digits and non-ASCII signs, A-Z lower-cased; a text's set holds the 64-bit
hashes of its word n-grams (of all its words at once if it has fewer than n). Copies of a text are
one class from the start. Bands and rows are chosen for a target recall at the threshold. Band hashes
are counted before rows are exchanged: those that come once go no further, and large buckets are
spread over blocks of bounded size, so no bucket is ever one task.

Members of a bucket whose set sizes allow the threshold are compared there by sketches, a byte a
minimum; a pair at the threshold is missed by that with a chance of SKETCH_LOSS. Pairs don't travel: what is
clearly alike leaves a bucket as a spanning forest, and only pairs near the threshold that the forest
doesn't connect leave it one by one and are verified on the full sets. Forests and verified pairs give
components, and in each all pairs are counted on the full sets, by blocks and matrix products. So every
candidate is judged by its full sets, and no more rows are exchanged than texts have places in buckets.
What is returned is a row a document: its class, its number of links to other texts, its group
(connected by links) and whether it is the one of its group that stays.

Null and empty texts, and texts without a word, form classes of copies without links. Rows that
repeat a doc_id are told apart by their place; the smallest id stays. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from . import kernels as K

WORD = K.mask_of([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Members of a bucket that are paired in one go, and rows of them that are compared with the rest at once.
BLOCK, TILE = 4096, 128
#: Sets, and n-grams in them, of a block of a component.
COMPONENT_BLOCK, BLOCK_GRAMS = 2048, 2 << 20
#: Pairs near the threshold that are verified in one place, about.
PAIRS = 50_000
#: The chance that a sketch rejects a pair at the threshold; a sketch has at most so many bytes.
SKETCH_LOSS, SKETCH = 1e-7, 255
#: Hashes of a signature at most. With fewer, recall 0.9999 at 0.5 takes bands of two rows, whose chance candidates grow with the square of the texts.
MOST_HASHES = 256


def banding(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which so many bands reach the recall at the threshold with at most `most` hashes."""
    best = None
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches that recall with so few hashes")
    return best


def least_matches(places: int, threshold: float, loss: float = SKETCH_LOSS) -> int:
    """The most matches of so many places that a pair at the threshold falls short of with at most that chance."""
    below = 0.0
    for k in range(places):
        below += math.comb(places, k) * threshold**k * (1 - threshold) ** (places - k)
        if below > loss:
            return k
    return places


def gram_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams, in order, and the offsets of rows in them."""
    data = K.LOWER[data]
    starts, ends, rows = K.word_spans(data, offsets, WORD)
    h = K.hash_spans(data, starts, ends)
    words = np.diff(rows)
    g = h.copy()
    for k in range(1, n):
        g = g * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
        if len(h) > k:
            g[:-k] ^= K.mix64(h[k:])
    valid = np.maximum(words - (n - 1), 0)
    short = np.flatnonzero((words > 0) & (words < n))
    count = valid.copy()
    count[short] = 1
    out = K.mix64(g[K.ragged(rows[:-1], count)])
    at = np.concatenate(([0], np.cumsum(count)))
    for r in short.tolist():  # fewer words than n: one gram of them all
        x = np.uint64(words[r])
        for v in h[rows[r] : rows[r + 1]]:
            x = K.mix64(np.array([x ^ v], dtype=np.uint64))[0]
        out[at[r]] = x
    return out, at


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = K.mix64(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return (r[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (r[k:] >> np.uint64(32)).astype(np.uint32)


def band_hashes(grams: np.ndarray, at: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, bands) int64 and sketches, the last byte of each minimum; texts without grams have zeros."""
    some = np.flatnonzero(np.diff(at) > 0)
    out = np.zeros((len(at) - 1, bands), dtype=np.int64)
    sketch = np.zeros((len(at) - 1, min(bands * rows, SKETCH)), dtype=np.uint8)
    if not len(some):
        return out, sketch
    x = (grams >> np.uint64(32)).astype(np.uint32)
    a, b = _coefficients(bands * rows)
    first = at[:-1][some]
    y = np.empty_like(x)
    for band in range(bands):
        h = np.full(len(some), np.uint64(band + 1), dtype=np.uint64)
        for r in range(rows):
            k = band * rows + r
            np.multiply(x, a[k], out=y)
            y += b[k]
            least = np.minimum.reduceat(y, first)
            h = K.mix64(h ^ least.astype(np.uint64))
            if k < sketch.shape[1]:
                sketch[some, k] = least.astype(np.uint8)
        out[some, band] = h.view(np.int64)
    return out, sketch


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key (MD5 of the text), size (distinct n-grams), bands, sketch."""
    width = min(bands * rows, SKETCH)

    def run(batches):
        for batch in base.gathered(batches):
            sizes, sig, sketches = [], [], []
            for _, _, data, offsets in K.text_chunks(batch.column("text")):
                grams, at = gram_hashes(data, offsets, n)
                h, sketch = band_hashes(grams, at, bands, rows)
                sig.append(h)
                sketches.append(sketch)
                for k in range(len(at) - 1):
                    own = grams[at[k] : at[k + 1]]
                    sizes.append(len(np.unique(own)) if len(own) > 1 else len(own))
            flat = np.concatenate(sig).ravel() if sig else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * bands, pa.int32()), pa.array(flat))
            ends = pa.array(np.arange(len(sizes) + 1) * width, pa.int32()).buffers()[1]
            bytes_ = pa.Array.from_buffers(pa.binary(), len(sizes), [None, ends, pa.py_buffer(b"".join(x.tobytes() for x in sketches))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), lists, bytes_], ["doc_id", "key", "size", "bands", "sketch"])

    return _keyed(docs).mapInArrow(run, "doc_id long, key binary, size long, bands array<long>, sketch binary")


def _keyed(docs: DataFrame) -> DataFrame:
    t = base.text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(t.cast("binary"))).alias("key"), t.alias("text"))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as an array; sketches have one more dimension."""
    c = batch.column(name)
    if name != "sketch":
        return c.to_numpy(zero_copy_only=False)
    _, ends, data = c.buffers()
    ends = np.frombuffer(ends, dtype=np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].reshape(len(c), -1)


def _near(nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b, strong), a < b, of nodes (node, size, bands, sketch), out of the buckets of equal band hashes.

    Of the pairs in a bucket whose sizes and sketches allow the threshold, each is connected by strong edges
    or is an edge that isn't strong.
    """
    spark = nodes.sparkSession
    rows = nodes.where("size > 0").select("node", "size", "sketch", F.explode("bands").alias("h"))
    # hashes are counted alone, map side first; only rows of those that come again are exchanged
    shared = base.table(rows.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1"), "shared-bands")
    rows = base.passing(rows, F.col("h"), shared.select("h")).join(F.broadcast(shared.where(F.col("_n") > BLOCK)), "h", "left")
    blocks = F.coalesce(F.ceil(F.col("_n") / F.lit(BLOCK)), F.lit(1)).cast("int")
    rows = rows.withColumn("_blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("_blocks").cast("long")).cast("int"))
    rows = rows.select("h", "node", "size", "sketch", "own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    rows = rows.select("h", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "node", "size", "sketch")
    rows = rows.repartition(base.parts(spark), "h", "i", "j").sortWithinPartitions("h", "i", "j")

    def run(batches):
        for (_, i, j, own, node, size, sketch), at in base.whole_runs(batches, ["h", "i", "j", "own", "node", "size", "sketch"], 3, get=_column):

            def ok(x, y, i=i, j=j, own=own, node=node, size=size):
                s, t = size[x], size[y]
                return ((i[x] == j[x]) | (own[x] != own[y])) & (np.minimum(s, t) >= threshold * np.maximum(s, t)) & (node[x] != node[y])

            width = sketch.shape[1]
            weak = least_matches(width, threshold)
            strong = max(weak, math.ceil(width * threshold + 2 * math.sqrt(width * threshold * (1 - threshold))))
            x, y, s = near_pairs(sketch, at, ok, weak, strong)
            a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.bool_())], ["a", "b", "strong"])

    return rows.mapInArrow(run, "a long, b long, strong boolean").where("a <> b").distinct()


def near_pairs(sketch: np.ndarray, at: np.ndarray, ok, weak: int, strong: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, strong) of places in runs with bounds `at`, for pairs in a run that ok(x, y) allows.

    Strong edges are spanning forests of the pairs with at least `strong` equal bytes; the others are the pairs of at
    least `weak` that a forest doesn't connect.
    """
    lens = np.diff(at)
    label = np.arange(len(sketch))
    xs, ys, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]

    def keep(x, y, matches):
        near = matches >= weak
        xs.append(x[near])
        ys.append(y[near])
        many.append(matches[near] >= strong)

    # pairs of short runs are made by distance: the k-th next row of the same run
    live, k, end = np.flatnonzero(np.repeat(lens <= TILE, lens)), 1, np.repeat(at[1:], lens)
    while len(live):
        live = live[live + k < end[live]]
        found = live[ok(live, live + k)]
        for lo in range(0, len(found), 1 << 14):
            x = found[lo : lo + (1 << 14)]
            keep(x, x + k, np.count_nonzero(sketch[x] == sketch[x + k], axis=1))
        k += 1
    for r in np.flatnonzero(lens > TILE).tolist():
        first, m = int(at[r]), int(lens[r])
        own, lab = sketch[first : first + m], np.arange(m)
        # what is like a few rows is tied to them first, so that few pairs are left
        p, place = -1, np.arange(m)
        for _ in range(64):
            alone = np.flatnonzero((lab == place) & (place > p))
            if not len(alone):
                break
            p, to = int(alone[0]), alone[1:]
            to = to[np.count_nonzero(own[to] == own[p], axis=1) >= strong]
            to = to[ok(np.full(len(to), first + p), first + to)]
            lab[to] = p
        tied = np.flatnonzero(lab != place)
        keep(first + tied, first + lab[tied], np.full(len(tied), strong))
        by_place = np.ascontiguousarray(own.T)
        for lo in range(0, m, TILE):
            hi = min(m, lo + TILE)
            matches, same = np.zeros((hi - lo, m - lo), np.uint8), np.empty((hi - lo, m - lo), bool)
            for c in by_place:
                np.equal(c[lo:hi, None], c[None, lo:], out=same)
                np.add(matches, same.view(np.uint8), out=matches)
            near = (matches >= weak) & (lab[lo:hi, None] != lab[None, lo:])
            x, y = np.nonzero(near)
            after = y > x
            x, y = x[after], y[after]
            allowed = ok(first + lo + x, first + lo + y)
            x, y = x[allowed], y[allowed]
            keep(first + lo + x, first + lo + y, matches[x, y])
    x, y, s = np.concatenate(xs), np.concatenate(ys), np.concatenate(many)
    u, v = base.spanning(x[s], y[s])
    label[u] = v
    rest = ~s & (label[x] != label[y])
    x, y = np.concatenate((u, x[rest])), np.concatenate((v, y[rest]))
    return x, y, np.arange(len(x)) < len(u)


def _texts(docs: DataFrame, edges: DataFrame, classes: DataFrame) -> DataFrame:
    """A table (node, text) of the nodes of edges (a, b); classes (node, key). A text goes out once a map task, whatever copies it has."""
    wanted = base.table(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "key"), "node"), "wanted-texts")
    texts = base.passing(_keyed(docs).select("key", "text"), F.col("key"), wanted.select("key"))
    return base.table(texts.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key").select("node", "text"), "near-texts")


def _sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-grams of each text."""
    out = []
    for _, _, data, offsets in K.text_chunks(column):
        grams, at = gram_hashes(data, offsets, n)
        out += [np.unique(grams[at[k] : at[k + 1]]) for k in range(len(at) - 1)]
    return out


def _groups(batches, n: int, order: list[str], names: list[str]):
    """(key, columns, sets) of rows that agree in `order`, by which batches are sorted."""
    key, held, sets = None, [], []
    for batch in base.gathered(batches):
        if not len(batch):
            continue
        keys, cols, own = [batch.column(c).to_numpy() for c in order], [batch.column(c).to_numpy() for c in names], _sets(batch.column("text"), n)
        at = base.bounds(keys, len(keys)).tolist()
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            k = tuple(int(c[lo]) for c in keys)
            if k != key and held:
                yield key, [np.concatenate(x) for x in zip(*held, strict=True)], sets
                held, sets = [], []
            key = k
            held.append([c[lo:hi] for c in cols])
            sets = sets + own[lo:hi] if len(sets) else own[lo:hi]
    if held:
        yield key, [np.concatenate(x) for x in zip(*held, strict=True)], sets


def _verified(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, n: int, threshold: float) -> DataFrame:
    """Of the table of pairs (a, b) those whose full sets reach the threshold; texts (node, text), sizes (node, size).

    Nodes are in blocks by their hash, and there is a group for each two blocks that have pairs: about PAIRS of them, and
    at most two blocks of about BLOCK_GRAMS n-grams.
    """
    spark = pairs.sparkSession
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    grams = sizes.join(ends, "node").agg(F.sum("size")).first()[0] or 0
    blocks = max(1, math.ceil(math.sqrt(2 * pairs.count() / PAIRS)), math.ceil(grams / BLOCK_GRAMS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    placed = pairs.select(F.least(block("a"), block("b")).alias("i"), F.greatest(block("a"), block("b")).alias("j"), "a", "b")
    at = placed.select("i", "j", F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = base.passing(texts, F.col("node"), base.table(ends, "weak-ends")).join(at, "node")
    rows = rows.select("i", "j", F.col("node").alias("a"), F.lit(-1).cast("long").alias("b"), "text")
    rows = rows.unionByName(placed.select("i", "j", "a", "b", F.lit(None).cast("string").alias("text")))
    rows = rows.repartition(base.parts(spark), "i", "j").sortWithinPartitions("i", "j")

    def run(batches):
        for _, (a, b), sets in _groups(batches, n, ["i", "j"], ["a", "b"]):
            has, pair = np.flatnonzero(b < 0), np.flatnonzero(b >= 0)
            has = has[np.argsort(a[has], kind="stable")]
            x, y = has[np.searchsorted(a[has], a[pair])], has[np.searchsorted(a[has], b[pair])]
            link = reach(sets, x, y, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a[pair][link], pa.int64()), pa.array(b[pair][link], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def reach(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sets of each pair (x, y) of places reach the threshold."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    x, y = np.where(size[x] <= size[y], x, y), np.where(size[x] <= size[y], y, x)
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(size)))
    there = np.repeat(np.arange(len(sets)), size) * len(values) + number  # sorted, as each set is
    common = np.zeros(len(x), dtype=np.int64)
    cum = np.concatenate(([0], np.cumsum(size[x])))
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(cum, cum[lo] + (1 << 20), side="right")) - 1)
        of = np.repeat(np.arange(lo, hi), size[x[lo:hi]])
        want = y[of] * len(values) + number[K.ragged(start[x[lo:hi]], size[x[lo:hi]])]
        found = there[np.minimum(np.searchsorted(there, want), len(there) - 1)] == want
        common[lo:hi] = np.bincount(of[found] - lo, minlength=hi - lo)
        lo = hi
    return common >= threshold * (size[x] + size[y] - common)


def links_of(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """(left, right), whether the sets at these places reach the threshold: common n-grams are counted by matrix products."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    common = np.zeros((len(left), len(right)), dtype=np.float32 if size.max() < 1 << 24 else np.float64)
    row, col = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    # only n-grams of at least two sets, and of both sides, count
    use = np.bincount(number, minlength=len(values)) > 1
    for side in (row, col):
        use &= np.bincount(number[side[owner] >= 0], minlength=len(values)) > 0
    number, owner = (np.cumsum(use) - 1)[number[use[number]]], owner[use[number]]
    order = np.argsort(number, kind="stable")
    number, owner, total = number[order], owner[order], int(use.sum())
    step = max(64, (4 << 20) // max(len(left), len(right)))
    for lo in range(0, total, step):
        a, b = np.searchsorted(number, [lo, lo + step])
        o, g = owner[a:b], number[a:b] - lo
        sides = []
        for side, count in ((row, len(left)), (col, len(right))):
            m = np.zeros((count, min(step, total - lo)), dtype=common.dtype)
            m[side[o[side[o] >= 0]], g[side[o] >= 0]] = 1
            sides.append(m)
        common += sides[0] @ sides[1].T
    out = np.empty(common.shape, dtype=bool)
    for r in range(len(left)):
        c = common[r].astype(np.float64)
        out[r] = c >= threshold * (size[left[r]] + size[right] - c)
    return out


def forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (place, first place of its component) of a symmetric matrix of links."""
    label = np.full(len(link), -1)
    for r in range(len(link)):
        if label[r] < 0:
            label[r], edge = r, np.array([r])
            while len(edge):
                edge = np.flatnonzero(link[edge].any(axis=0) & (label < 0))
                label[edge] = r
    moved = np.flatnonzero(label != np.arange(len(link)))
    return moved, label[moved]


def _counted(edges: DataFrame, texts: DataFrame, sizes: DataFrame, n: int, threshold: float) -> DataFrame:
    """All links inside the components of edges (a, b), on full sets: rows (node, null, links of the node), which are to be
    added up, and (node, other, null), a spanning forest of the links; texts (node, text), sizes (node, size).

    Components are cut in blocks of about COMPONENT_BLOCK sets or BLOCK_GRAMS n-grams, whichever are more blocks, and there
    is a group for each two blocks.
    """
    spark = edges.sparkSession
    homes = base.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    whole = homes.join(sizes, "node").groupBy("component").agg(F.count("*").alias("_n"), F.sum("size").alias("_grams"))
    homes = base.attach(homes, base.table(whole, "component-sizes"), ["component"], "_n", "inner")
    blocks = F.greatest(F.ceil(F.col("_n") / F.lit(COMPONENT_BLOCK)), F.ceil(F.col("_grams") / F.lit(BLOCK_GRAMS)), F.lit(1).cast("long"))
    homes = homes.select("node", F.col("component").alias("c"), blocks.cast("int").alias("_blocks"))
    rows = texts.join(homes, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("_blocks").cast("long")).cast("int"))
    rows = rows.select("c", "node", "own", "text", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    rows = rows.select("c", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "node", "text")
    rows = rows.repartition(base.parts(spark), "c", "i", "j").sortWithinPartitions("c", "i", "j")

    def run(batches):
        out, held = [], 0
        for (_, i, j), (own, node), sets in _groups(batches, n, ["c", "i", "j"], ["own", "node"]):
            m = len(node)
            link = np.zeros((m, m), dtype=bool)
            if i == j and m == 2:
                link[0, 1] = link[1, 0] = reach(sets, np.array([0]), np.array([1]), threshold)[0]
            elif i == j:
                link[:] = links_of(sets, np.arange(m), np.arange(m), threshold)
                np.fill_diagonal(link, False)
            else:
                left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
                if len(left) and len(right):
                    link[np.ix_(left, right)] = links_of(sets, left, right, threshold)
                    link |= link.T
            count = link.sum(axis=1)
            some = np.flatnonzero(count)
            u, v = forest(link)
            out.append((node[some], np.full(len(some), -1), count[some]))
            out.append((node[u], node[v], np.full(len(u), -1)))
            held += len(some) + len(u)
            if held > 100_000:
                yield _counts(out)
                out, held = [], 0
        if out:
            yield _counts(out)

    return rows.mapInArrow(run, "node long, other long, n long")


def _counts(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    node, other, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64(), mask=other < 0), pa.array(n, pa.int64(), mask=n < 0)], ["node", "other", "n"])


def _classes(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Tables of all rows (doc_id, key, _row and more), and of their classes with links and groups."""
    spark = docs.sparkSession
    base.ship(spark)
    bands, rows = banding(threshold, recall, MOST_HASHES)
    found = base.table(signatures(docs, n, bands, rows).withColumn("_row", F.monotonically_increasing_id()), "signatures")
    first = F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("_id"), F.col("_row"))).alias("_first")
    classes = found.groupBy("key").agg(F.count("*").alias("n_copies"), first)
    classes = base.table(classes.select(F.col("_first._row").alias("node"), F.col("_first._id").alias("_id"), "key", "n_copies"), "classes")
    # a class's bands are those of its first row, and stay where they are: only rows that may be later copies are joined
    many = base.table(classes.where("n_copies > 1").select("key", F.col("node").alias("_node"), "n_copies"), "copied")
    later = base.attach(base.passing(found.select("key", "_row"), F.col("key"), many.select("key")), many, ["key"], "n_copies", "inner")
    later = base.table(later.where("_row <> _node").select(F.col("_row").alias("node")), "later-copies")
    signed = base.flagged(found.select(F.col("_row").alias("node"), "size", "bands", "sketch"), F.col("node"), later, "_may")
    nodes = signed.where("not _may").drop("_may").unionByName(signed.where("_may").drop("_may").join(later, "node", "left_anti"))
    edges = base.table(_near(nodes, threshold), "near-edges")
    sizes, texts = found.select(F.col("_row").alias("node"), "size"), _texts(docs, edges, classes)
    near = base.table(_verified(edges.where("not strong").select("a", "b"), texts, sizes, n, threshold), "near-links")
    counted = base.table(_counted(edges.where("strong").select("a", "b").unionByName(near), texts, sizes, n, threshold), "links")
    for old in (edges, texts, near):
        base.drop_table(old)
    degree = counted.where("other is null").groupBy("node").agg(F.sum("n").alias("n_links"))
    groups = base.components(counted.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    known = classes.join(degree, "node", "left").join(groups, "node", "left").withColumn("_group", F.coalesce("component", "node"))
    least = known.groupBy("_group").agg(F.min(F.struct("_id", "node")).alias("_least"))
    facts = base.table(known.join(least, "_group").select("key", "node", F.col("_id").alias("class_id"), F.col("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("_least._id").alias("group_id"), F.col("_least.node").alias("_stays")), "near-facts")
    return found, facts


def near_duplicates(docs: DataFrame, n: int = 3, threshold: float = 0.5, recall: float = 0.9999) -> DataFrame:
    """doc_id, class_id, n_copies, n_links, group_id, kept of every row of docs (doc_id, text).

    class_id: the smallest doc_id with the same text; n_copies: rows with that text; n_links: other
    texts of Jaccard similarity >= threshold; group_id: the smallest doc_id of the group that links
    and copies connect; kept: true for one row of each group.
    """
    found, facts = _classes(docs, n, threshold, recall)
    out = base.attach(found.select("doc_id", "key", "_row"), facts.drop("node"), ["key"], "n_copies")
    real = lambda c: F.when(F.col(c) < 2**63 - 1, F.col(c)).alias(c)
    return out.select("doc_id", real("class_id"), "n_copies", "n_links", real("group_id"), (F.col("_row") == F.col("_stays")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = 3, threshold: float = 0.5, recall: float = 0.9999) -> DataFrame:
    """docs with one row of each group of near duplicates: that with the smallest doc_id."""
    _, facts = _classes(docs, n, threshold, recall)
    facts = facts.where("n_copies > 1 or node <> _stays")
    contested = base.table(facts.select("key", F.when(F.col("class_id") < 2**63 - 1, F.col("class_id")).alias("keeper"), (F.col("node") == F.col("_stays")).alias("keeps"), F.col("n_copies").alias("n")), "contested")
    return base.retain(docs, F.unhex(F.md5(base.text_of().cast("binary"))), contested)
