"""Embedders, and documents and queries turned into embedding records.

An embedder maps a list of texts to unit vectors. The hashing embedder needs no model and is the same
everywhere; the ONNX embedder runs a model from a folder that all workers see, in true batches, with one
session a worker. Records are rows; a document's chunks are embedded where they were cut, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ModelOutputError, ModelSourceError, TokenLimitError
from ..functions import text as X
from ..functions import vectors as V
from ..options import ChunkOptions, EmbeddingOptions
from ..schema import SCHEMA_VERSION, VectorFormat
from .chunking import SCHEMA as CHUNK_SCHEMA
from .chunking import Tokenizer, chunk_documents
from .semantic import QueryVector


class Embedder(Protocol):
    model_id: str
    revision: str
    fingerprint: str
    dimensions: int
    max_tokens: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed word counts in places told by SHA-256, normalised; a text without words, or whose counts cancel, points along the first axis.

    axis: False leaves such a text the zero vector.
    """

    max_tokens = 1 << 30

    def __init__(self, dimensions: int = 64, axis: bool = True):
        self.dimensions, self.axis, self.model_id, self.revision = dimensions, axis, "hashing", "1"
        self.fingerprint = hashlib.sha256(f"hashing|1|{dimensions}{'' if axis else '|zero'}".encode()).hexdigest()

    def place(self, word: str) -> tuple[int, float]:
        h = hashlib.sha256(word.encode()).digest()
        return int.from_bytes(h[:4], "big") % self.dimensions, 1.0 if h[4] & 1 else -1.0

    def _known(self, word: str) -> tuple[int, float]:
        """place(), kept for words that come again; the store is let go when it is large."""
        store = self.__dict__.setdefault("_places", {})
        if word not in store:
            if len(store) >= 1 << 18:
                store.clear()
            store[word] = self.place(word)
        return store[word]

    def embed(self, texts: list[str]) -> np.ndarray:
        import regex

        # words are numbered in one pass; hashing and adding up go by distinct words and whole arrays
        word, number = regex.compile(X.WORD), {}
        rows, sizes = [], np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            found = [number.setdefault(w, len(number)) for w in map(str.lower, word.findall(t or ""))]
            rows.append(np.array(found, dtype=np.int64))
            sizes[i] = len(found)
        out = np.zeros((len(texts), self.dimensions))
        if number:
            place = np.array([self._known(w) for w in number])
            words = np.concatenate(rows)
            at = np.repeat(np.arange(len(texts)), sizes) * self.dimensions + place[words, 0].astype(np.int64)
            out = np.bincount(at, weights=place[words, 1], minlength=out.size).reshape(out.shape)
        norms = np.sqrt((out * out).sum(axis=1))
        if self.axis:
            out[norms == 0, 0] = 1.0
        norms[norms == 0] = 1.0
        return (out / norms[:, None]).astype(np.float32)


def pool(output: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit rows of a model's output: (width), (texts, width), or (texts, tokens, width) by the masked mean."""
    if output.ndim == 1:
        output = output[None, :]
    if output.ndim == 3:
        if output.shape[:2] != mask.shape:
            raise ModelOutputError(f"output {output.shape} for a mask {mask.shape}")
        m = mask[:, :, None].astype(np.float64)
        output = (output * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1)
    if output.ndim != 2 or len(output) != len(mask):
        raise ModelOutputError(f"output of shape {output.shape}")
    norms = np.sqrt((output.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    if not np.isfinite(norms).all() or (norms == 0).any():
        raise ModelOutputError("a zero or non-finite vector")
    return (output / norms).astype(np.float32)


def padded(ids: list[list[int]], pad: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, ids))
    out, mask = np.full((len(ids), n), pad, dtype=np.int64), np.zeros((len(ids), n), dtype=np.int64)
    for i, row in enumerate(ids):
        out[i, : len(row)], mask[i, : len(row)] = row, 1
    return out, mask


ARTIFACTS = ("*.onnx", "*.json", "*.txt", "*.model", "*.data", "*.onnx_data")


def model_files(folder: str | Path) -> list[Path]:
    """A model's files below a folder, by the patterns that belong to a model; links out of the folder are an error."""
    root = Path(folder).resolve()
    if not root.is_dir():
        raise ModelSourceError(f"no folder {folder}")
    found = sorted({p for pattern in ARTIFACTS for p in root.rglob(pattern) if p.is_file()})
    for p in found:
        if not p.resolve().is_relative_to(root):
            raise ModelSourceError(f"{p} leads out of the model's folder")
    if not any(p.suffix == ".onnx" for p in found):
        raise ModelSourceError(f"no .onnx file in {folder}")
    return found


def model_fingerprint(folder: str | Path) -> str:
    """SHA-256 over the names and contents of a model's files."""
    root, h = Path(folder).resolve(), hashlib.sha256()
    for p in model_files(root):
        h.update(p.relative_to(root).as_posix().encode() + b"\0")
        with p.open("rb") as f:
            for block in iter(lambda: f.read(1 << 20), b""):
                h.update(block)
        h.update(b"\0")
    return h.hexdigest()


class OnnxEmbedder:
    """A model in a folder of the shared file system; opened once a worker process, on first use."""

    _sessions: dict[str, tuple] = {}

    def __init__(self, folder: str, dimensions: int, max_tokens: int = 1024, threads: int = 1, model_id: str | None = None, revision: str = "local", fingerprint: str | None = None):
        self.folder, self.dimensions, self.max_tokens, self.threads, self.revision = str(folder), dimensions, max_tokens, threads, revision
        self.model_id = model_id or Path(folder).name
        self.fingerprint = fingerprint or model_fingerprint(folder)

    def _open(self) -> tuple:
        if self.fingerprint not in self._sessions:
            import onnxruntime as ort
            from tokenizers import Tokenizer as T

            files = model_files(self.folder)
            o = ort.SessionOptions()
            o.intra_op_num_threads, o.inter_op_num_threads = self.threads, 1
            session = ort.InferenceSession(str(next(p for p in files if p.suffix == ".onnx")), o, providers=["CPUExecutionProvider"])
            self._sessions[self.fingerprint] = session, T.from_file(str(Path(self.folder) / "tokenizer.json"))
        return self._sessions[self.fingerprint]

    def embed(self, texts: list[str]) -> np.ndarray:
        session, tokenizer = self._open()
        ids = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts])]
        if any(len(i) > self.max_tokens for i in ids):
            raise TokenLimitError(f"a text has more than {self.max_tokens} tokens")
        x, mask = padded(ids, 0)
        given = {"input_ids": x, "attention_mask": mask, "token_type_ids": np.zeros_like(x)}
        names = {i.name for i in session.get_inputs()}
        return pool(session.run(None, {k: v for k, v in given.items() if k in names})[0], mask)


def embed_rows(rows: DataFrame, text: str, embedder: Embedder, format: int = VectorFormat.FLOAT32, batch: int = 64) -> DataFrame:
    """rows with vector array<float>, encoded binary (in the format) and fingerprint."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", vector array<float>, encoded binary, fingerprint string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf[text]]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))  # texts of like length share a batch
            made: list = [None] * len(texts)
            for lo in range(0, len(order), batch):
                of = order[lo : lo + batch]
                for i, v in zip(of, embedder.embed([texts[i] for i in of]), strict=True):
                    made[i] = v
            encoded = [V.encode(v, format) for v in made]
            yield pdf.assign(vector=[V.decode(e) for e in encoded], encoded=[V.to_envelope(e) for e in encoded], fingerprint=embedder.fingerprint)

    return rows.mapInPandas(run, schema)


def embed_documents(docs: DataFrame, key: str, text: str, embedder: Embedder, tokenizer: Tokenizer, chunking: ChunkOptions | None = None, options: EmbeddingOptions | None = None) -> DataFrame:
    """A record row a chunk: key, the chunk's columns, vector, encoded, fingerprint, model."""
    options, chunking = options or EmbeddingOptions(), chunking or ChunkOptions()
    if chunking.max_tokens > embedder.max_tokens:
        raise TokenLimitError("chunks are larger than the model's limit")
    whole = ChunkOptions(chunking.max_tokens, chunking.overlap_tokens, chunking.repeat_heading, True)
    chunks = chunk_documents(docs, key, text, tokenizer, whole).withColumn("_input", F.concat("context", "text"))
    out = embed_rows(chunks, "_input", embedder, options.document_format).drop("_input")
    if not chunking.include_text:
        out = out.withColumn("text", F.lit(None).cast("string")).withColumn("context", F.lit(None).cast("string"))
    return out.withColumns({"model_id": F.lit(embedder.model_id), "revision": F.lit(embedder.revision), "schema_version": F.lit(SCHEMA_VERSION), "token_capacity": F.lit(chunking.max_tokens)})


def embed_query(text: str, embedder: Embedder, tokenizer: Tokenizer | None = None, options: EmbeddingOptions | None = None) -> QueryVector:
    """One vector; a query is never cut, so one that is too long is an error."""
    options = options or EmbeddingOptions()
    if tokenizer is not None:
        n = len(tokenizer.offsets(text)) + tokenizer.special
        if n > min(options.query_max_tokens, embedder.max_tokens):
            raise TokenLimitError(f"the query has {n} tokens")
    v = V.decode(V.encode(embedder.embed([text])[0], options.query_format))
    return QueryVector.of(v, embedder.fingerprint)


class ModelRegistry:
    """The current embedder; a new one is tried before it takes over, and a failure leaves the old one."""

    def __init__(self) -> None:
        self.current: Embedder | None = None
        self.status, self.last_error = "empty", None

    def update(self, make) -> Embedder:
        try:
            new = make()
            v = new.embed(["ready"])
            if v.shape != (1, new.dimensions) or not np.isclose((v.astype(np.float64) ** 2).sum(), 1, atol=1e-3):
                raise ModelOutputError(f"a vector of shape {v.shape} that isn't of unit length")
        except Exception as e:
            self.last_error, self.status = str(e), "ready" if self.current else "failed"
            raise
        self.current, self.status, self.last_error = new, "ready", None
        return new


__all__ = ["CHUNK_SCHEMA", "Embedder", "HashingEmbedder", "ModelRegistry", "OnnxEmbedder", "embed_documents", "embed_query", "embed_rows", "model_files", "model_fingerprint", "padded", "pool"]
