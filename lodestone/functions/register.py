"""SQL names for what the engine does to vectors and texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import VectorFormatError
from ..operators import chunking
from ..operators import reduce as R
from ..options import ChunkOptions
from . import vectors as V


def register(spark: SparkSession, tokenizer: chunking.Tokenizer | None = None) -> list[str]:
    """Registers vec_cosine, vec_normalize, vec_encode, vec_decode, vec_reduce, count_tokens, and the table function chunk_text."""
    tokenizer = tokenizer or chunking.WordTokenizer()

    @F.pandas_udf("double")
    def vec_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        both = a.notna() & b.notna()
        if not (a[both].map(len) == b[both].map(len)).all():
            raise VectorFormatError("vectors of different dimensions")
        sizes = a.where(both).map(len, na_action="ignore")
        for d in sizes.dropna().unique():
            of = np.flatnonzero((sizes == d).to_numpy())
            x, y = (np.stack(s.iloc[of].to_list()).astype(np.float32) for s in (a, b))
            n = np.sqrt((x * x).astype(np.float64).sum(axis=1)) * np.sqrt((y * y).astype(np.float64).sum(axis=1))
            out[of] = np.divide((x * y).astype(np.float64).sum(axis=1), n, out=np.zeros(len(of)), where=n > 0)
        return pd.Series(out).where(both.to_numpy())

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vec_normalize(a: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(a), dtype=object)
        sizes = a.map(len, na_action="ignore")
        for d in sizes.dropna().unique():
            of = np.flatnonzero((sizes == d).to_numpy())
            made = R.reduce_rows(np.stack(a.iloc[of].to_list()), int(d))
            for k, v in zip(of.tolist(), made, strict=True):
                out.iat[k] = v
        return out

    @F.pandas_udf("binary")
    def vec_encode(a: pd.Series, format: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else V.to_envelope(V.encode(x, int(f))) for x, f in zip(a, format, strict=True)])

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vec_reduce(a: pd.Series, dimensions: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(a), dtype=object)
        sizes = a.map(len, na_action="ignore")
        for d, to in set(zip(sizes.dropna(), dimensions[sizes.notna()], strict=True)):
            of = np.flatnonzero(((sizes == d) & (dimensions == to)).to_numpy())
            for k, v in zip(of.tolist(), R.reduce_rows(np.stack(a.iloc[of].to_list()), int(to)), strict=True):
                out.iat[k] = v
        return out

    @F.udtf(returnType=chunking.SCHEMA)
    class ChunkText:
        def eval(self, text: str, max_tokens: int):
            for c in chunking.chunk_text(text or "", tokenizer, ChunkOptions(max_tokens)):
                yield c.index, c.count, c.text, c.context, c.boundary, list(c.heading_path), c.char_start, c.char_length, c.token_start, c.token_count, c.document_tokens, c.context_tokens, c.special_tokens, c.input_tokens

    named = {"vec_cosine": vec_cosine, "vec_normalize": vec_normalize, "vec_encode": vec_encode, "vec_decode": V.decode_udf, "vec_reduce": vec_reduce, "count_tokens": chunking.count_tokens_udf(tokenizer)}
    for name, f in named.items():
        spark.udf.register(name, f)
    spark.udtf.register("chunk_text", ChunkText)
    return [*named, "chunk_text"]
