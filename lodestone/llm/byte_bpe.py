"""Operator 8: byte-level BPE encoding and decoding; see bpe.py for the merge replay.

Every pre-token is encoded by itself; null and empty texts have no ids. Decoding goes from ids
to bytes through the rank file's tokens. Rows that repeat are encoded each; extra columns are
not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, bpe
from . import kernels as K


class Tokens:
    """The bytes of all tokens in one array."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.len = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.len) - self.len

    def decode(self, ids: np.ndarray) -> bytes:
        return self.flat[K.ragged(self.start[ids], self.len[ids])].tobytes()


def encode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids array<int>; with digest, hashes of the ids and of the decoded bytes in their place."""
    base.ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")

    def run(batches):
        store = bpe.words(path)
        tokens = Tokens(bpe.rank_file(path)[1])
        for batch in base.gathered(batches, bpe.REPLAY):
            count, a, b = [], [], []
            for lo, hi, enc in bpe.encode_rows(store, batch.column(1), True):
                ids, at = enc.ids(), enc.row_tokens
                count += np.diff(at).tolist()
                for k in range(hi - lo):
                    own = ids[at[k] : at[k + 1]]
                    if digest:
                        a.append(hashlib.sha256(str(own.tolist())[1:-1].replace(", ", ",").encode()).hexdigest())
                        b.append(hashlib.sha256(tokens.decode(own)).hexdigest())
                    else:
                        a.append(own)
            cols = [batch.column(0), pa.array(count, pa.int64()), *([pa.array(a), pa.array(b)] if digest else [pa.array(a, pa.list_(pa.int32()))])]
            if len(count) or not len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c.cast(t) for c, t in zip(cols, [pa.int64(), pa.int64(), *([pa.string()] * 2 if digest else [pa.list_(pa.int32())])], strict=True)], ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids"])])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes (binary) of rows doc_id, ids; null ids give null."""
    base.ship(encoded.sparkSession)

    def run(batches):
        tokens = Tokens(bpe.rank_file(path)[1])
        for batch in batches:
            out = [None if x is None else tokens.decode(np.array(x, dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")
