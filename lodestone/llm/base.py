"""What the operators share: the shared folder, tables cut from their lineage, hot keys, connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Bytes of an Arrow batch to a Python worker, where the session doesn't set its own; texts may be long, so rows bound nothing.
ARROW_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a Spark context, and bounds Arrow batches by bytes where the session doesn't."""
    if not spark.sparkContext.getConf().contains("spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    shipping.ship(spark)


def trim() -> None:
    """Gives freed memory back to the system; the allocator would keep most of it for a worker's life."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def gathered(batches: Iterator[pa.RecordBatch], limit: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches of at least `limit` bytes, but for the last: for work that is cheaper on more rows at once. Memory is trimmed after each."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            whole = pa.concat_batches(held) if len(held) > 1 else held[0]
            held, size = [], 0
            del batch
            yield whole
            del whole
            trim()
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]
        del held
        trim()


def _array(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def whole_runs(batches: Iterator[pa.RecordBatch], names: list[str], keys: int, limit: int = 0, get: Callable[[pa.RecordBatch, str], np.ndarray] = _array) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of sorted batches with the bounds of runs that agree in the first `keys` columns; no run is parted."""
    rest: list[np.ndarray] | None = None
    for batch in gathered(batches, limit):
        if not len(batch):
            continue
        cols = [get(batch, c) for c in names]
        if rest is not None and len(rest[0]):
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        at = bounds(cols, keys)
        if len(at) > 2:
            stop = at[-2]
            yield [c[:stop] for c in cols], at[:-1]
            cols = [c[stop:].copy() for c in cols]
        rest = cols
    if rest is not None and len(rest[0]):
        yield rest, bounds(rest, keys)


def bounds(cols: list[np.ndarray], keys: int) -> np.ndarray:
    n = len(cols[0])
    change = np.zeros(n, dtype=bool)
    for c in cols[:keys]:
        change[1:] |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(change), [n]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. In local mode one is made where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(spark.sparkContext, "_lodestone_shared", None)
        if folder is None:
            folder = spark.sparkContext._lodestone_shared = tempfile.mkdtemp(prefix="lodestone-shared-")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The rows of df, written once in the shared folder and read from there: lineage ends here, and no lost executor takes them along."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes what table() wrote, on whatever file system it is, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in {os.path.dirname(p) for p in df.inputFiles()}:
        if "/lodestone/" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(conf).delete(path, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(name: str, mod: int) -> Column:
    """crc32 of a number as decimal text, modulo; null for null."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % mod


#: Rows of a key that holds at least this share of all rows go by a broadcast; there can't be more such keys than its inverse.
HOT_SHARE = 1 / 1000


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """rows joined to facts (one row a key) where a key may hold any share of the rows.

    facts[weight] is the number of rows of the key. Keys of at least HOT_SHARE of all rows, at
    most 1 / HOT_SHARE of them, are broadcast; the rest is an ordinary join without large keys.
    Both frames are tables already, so reading them twice is cheap.
    """
    total, most = facts.agg(F.sum(weight), F.max(weight)).first()
    limit = max(1000, int((total or 0) * HOT_SHARE))
    if (most or 0) < limit:
        return rows.join(facts, keys, how)
    hot, cold = facts.where(F.col(weight) >= limit), facts.where(F.col(weight) < limit)
    return rows.join(F.broadcast(hot), keys, "inner").unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how))


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that connect what the edges (u, v) connect."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v), v < u: edges (src, dst) batch by batch reduced to stars around the least nodes."""

    def run(batches):
        for batch in gathered(batches, 8 << 20):
            u, v = spanning(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").mapInArrow(run, "u long, v long")


def _stars(pair: DataFrame) -> bool:
    """Whether no u of (u, v) comes twice or is a v: each u then tells its component."""
    ends = pair.select(F.col("u").alias("x"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(pair.select(F.col("v").alias("x"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
    each = ends.groupBy("x").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v"))
    return not each.agg(F.max((F.col("as_u") > 1) | ((F.col("as_u") > 0) & (F.col("as_v") > 0)))).first()[0]


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (src, dst) reaches; a table.

    Edges are first reduced to stars inside each batch; then large-star and small-star in turns until only
    stars are left. Every round is a table in the shared folder. A node with very many neighbours is
    met by aggregation on map sides only: each round needs the least neighbour of a node, never a
    list of them.
    """
    pair = table(contracted(edges).distinct(), "cc")
    for _ in range(most):
        if _stars(pair):
            out = pair.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pair.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            out = table(out, "components")
            drop_table(pair)
            return out
        # large-star: every node tells its larger neighbours of the least node around it
        both = pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "cc-least")
        told = attach(both, least, ["u"], "n", "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = table(told, "cc")
        drop_table(least)
        # small-star: every node ties its smaller neighbours and itself to the least of them
        least = table(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-least")
        told = attach(large, least, ["u"], "n", "inner").select(F.explode(F.array(F.struct(F.col("v").alias("src"), F.col("m").alias("dst")), F.struct(F.col("u").alias("src"), F.col("m").alias("dst")))).alias("e")).select("e.src", "e.dst")
        small = table(contracted(told).distinct(), "cc")
        for old in (pair, large, least):
            drop_table(old)
        pair = small
    raise RuntimeError(f"no stars in {most} rounds")


#: Places of a filter: at least the first number, about 16 for each key, and never more than the second, which is 16 MB.
FEWEST_PLACES, MOST_PLACES = 1 << 20, 1 << 27


def flagged(rows: DataFrame, key: Column, keys: DataFrame, flag: str) -> DataFrame:
    """rows with a boolean column: false only where the key is none of the table keys (one column of the key's type).

    A bitmap of hashed places is broadcast, at most MOST_PLACES bits of it. Its places grow with the keys; where
    even so many are too few, the flag is true more often, and the join that follows sorts that out.
    """
    name = keys.columns[0]
    places, wanted = FEWEST_PLACES, 16 * keys.count()
    while places < min(wanted, MOST_PLACES):
        places *= 2
    free = {c.lower() for c in (*rows.columns, flag)}
    p, b, bits = (next(c for c in (f"_{x}{i}" for i in range(99)) if c not in free) for x in ("p", "b", "bits"))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(places))
    map_ = keys.select(place(F.col(name)).alias(p)).select(F.shiftright(p, 15).alias(b), F.pmod(p, F.lit(1 << 15)).alias(p))
    map_ = map_.groupBy(b).agg(F.bitmap_construct_agg(p).alias(bits))
    found = rows.withColumn(p, place(key)).withColumn(b, F.shiftright(p, 15)).join(F.broadcast(map_), b, "left")
    byte = F.conv(F.hex(F.substring(bits, F.pmod(F.shiftright(p, 3), F.lit(1 << 12)).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return found.select(*rows.columns, F.coalesce(F.getbit(byte, F.pmod(p, F.lit(8)).cast("int")) == 1, F.lit(False)).alias(flag))


def passing(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose key may be among the keys, where they are: all that are, and few others. See flagged()."""
    flag = next(c for c in (f"_may{i}" for i in range(99)) if c not in {x.lower() for x in rows.columns})
    return flagged(rows, key, keys, flag).where(flag).drop(flag)


def retain(docs: DataFrame, key: Column, contested: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' own columns.

    contested (key, keeper, keeps, n), a table: keys of which at most one row stays, that with doc_id `keeper`
    (none where `keeps` is false); n is the number of rows of the key. A bitmap lets most rows of other keys
    pass where they are; only rows that may be contested are joined.
    """
    names = docs.columns
    free = {n.lower() for n in names}
    k, may, w, keeps, n = (next(c for c in (f"_{x}{i}" for i in range(99)) if c not in free) for x in ("key", "may", "keeper", "keeps", "n"))
    facts = contested.select(F.col("key").alias(k), F.col("keeper").alias(w), F.col("keeps").alias(keeps), F.col("n").alias(n))
    rows = flagged(docs.withColumn(k, key), F.col(k), facts.select(k), may)
    clear = rows.where(~F.col(may)).select(*names)
    joined = attach(rows.where(may).drop(may), facts, [k], n)
    free_rows = joined.where(F.col(n).isNull()).select(*names)
    chosen = joined.where(F.coalesce(keeps, F.lit(False)) & F.col("doc_id").cast("long").eqNullSafe(F.col(w))).dropDuplicates([k]).select(*names)
    return union([clear, free_rows, chosen])
