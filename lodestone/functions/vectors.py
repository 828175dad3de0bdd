"""Vectors: cosine, normalisation, and encodings in 32, 16, 8 and 4 bits.

Up to WIDE dimensions cosine stays in JVM expressions; wider vectors go through Arrow and numpy, which
cost less there. All encodings are little-endian; the envelope is a self-describing binary form.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..errors import RecordVersionError, VectorFormatError

WIDE = 512
SCHEMES = {int(S.VectorFormat.INT8): int(S.Quantization.INT8), int(S.VectorFormat.INT4): int(S.Quantization.INT4)}


def dot(a: Column, b: Column) -> Column:
    """Products in the vectors' own precision, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x.cast("double"))


def squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + (x * x).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero; an error where lengths differ."""
    norms = F.sqrt(squares(a)) * F.sqrt(squares(b))
    checked = F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error("vectors of different dimensions").cast("double"))
    return F.when(norms == 0, F.lit(0.0)).otherwise(checked / norms)


def cosine_to(a: Column, query: list[float] | np.ndarray) -> Column:
    """Cosine to one query vector, which goes into the plan as a literal; no join is needed."""
    q = np.asarray(query, dtype=np.float32)
    norm = float(np.sqrt((q * q).astype(np.float64).sum()))
    if len(q) > WIDE:
        return wide_cosine_to(q)(a)
    literal = F.lit([float(x) for x in q]).cast("array<float>")
    own = F.sqrt(squares(a))
    checked = F.when(F.size(a) == len(q), dot(a, literal)).otherwise(F.raise_error("vectors of different dimensions").cast("double"))
    return F.when((own == 0) | F.lit(norm == 0), F.lit(0.0)).otherwise(checked / (own * F.lit(norm)))


def wide_cosine_to(query: np.ndarray):
    q = np.asarray(query, dtype=np.float64)
    norm = np.sqrt((q * q).sum())

    @F.pandas_udf("double")
    def run(vectors: pd.Series) -> pd.Series:
        m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, len(q)))
        norms = np.sqrt((m * m).sum(axis=1)) * norm
        return pd.Series(np.divide(m @ q, norms, out=np.zeros(len(m)), where=norms > 0))

    return run


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector is an error."""
    made = _let(1.0 / F.sqrt(squares(a)), lambda inverse: F.transform(a, lambda x: (x * inverse).cast("float")))
    return F.when(squares(a) > 0, made).otherwise(F.raise_error("a zero vector has no direction").cast("array<float>"))


def _scale(a: Column, levels: int) -> Column:
    return (F.array_max(F.transform(a, F.abs)) / F.lit(levels)).cast("float")


def quantize(a: Column, bits: int) -> Column:
    """struct<values array<int>, scale float, inverse_integer_norm float> of a symmetric quantisation, rounded half to even."""
    levels = (1 << (bits - 1)) - 1

    def values(scale: Column) -> Column:
        return F.transform(a, lambda x: F.greatest(F.lit(-levels), F.least(F.lit(levels), F.rint((x / scale).cast("float")).cast("int"))))

    def made(v: Column, scale: Column) -> Column:
        squared = F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x * x)
        return F.struct(v.alias("values"), scale.alias("scale"), (1.0 / F.sqrt(squared)).cast("float").alias("inverse_integer_norm"))

    out = _let(_scale(a, levels), lambda scale: _let(values(scale), lambda v: made(v, scale)))
    return F.when(F.array_max(F.transform(a, F.abs)) > 0, out).otherwise(F.raise_error("a zero vector can't be quantised").cast("struct<values:array<int>,scale:float,inverse_integer_norm:float>"))


def dequantize(q: Column) -> Column:
    return _let(q, lambda z: F.transform(z["values"], lambda x: (x * z["scale"]).cast("float")))


def integer_cosine(a: Column, b: Column) -> Column:
    """Of two quantised vectors, from their integers alone."""
    product = F.aggregate(F.zip_with(a["values"], b["values"], lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    return product * a["inverse_integer_norm"].cast("double") * b["inverse_integer_norm"].cast("double")


@dataclass(frozen=True)
class Vector:
    """An encoded vector on the driver or in a worker."""

    format: int
    dimensions: int
    data: bytes
    scheme: int = 0
    scale: float = 0.0
    inverse_norm: float = 0.0
    encoding_version: int = S.ENCODING_VERSION

    def check(self) -> Vector:
        if self.encoding_version != S.ENCODING_VERSION:
            raise RecordVersionError(f"vector encoding {self.encoding_version}")
        d = self.dimensions
        want = {S.VectorFormat.FLOAT32: 4 * d, S.VectorFormat.FLOAT16: 2 * d, S.VectorFormat.INT8: d, S.VectorFormat.INT4: (d + 1) // 2}.get(self.format)
        if want is None or self.dimensions < 1 or len(self.data) != want:
            raise VectorFormatError("format, dimensions and payload don't agree")
        scheme = SCHEMES.get(self.format, 0)
        if self.scheme != scheme or scheme and not (self.scale > 0 and self.inverse_norm > 0):
            raise VectorFormatError("quantisation doesn't agree with the format")
        return self


def encode(x: np.ndarray, format: int) -> Vector:
    """From float32."""
    x = np.asarray(x, dtype=np.float32)
    if x.ndim != 1 or not len(x):
        raise VectorFormatError("a vector needs a dimension")
    if not np.isfinite(x).all():
        raise VectorFormatError("a vector has finite components only")
    if format == S.VectorFormat.FLOAT32:
        return Vector(int(format), len(x), x.astype("<f4").tobytes())
    if format == S.VectorFormat.FLOAT16:
        half = x.astype("<f2")
        if not np.isfinite(half).all():
            raise VectorFormatError("a component is beyond half precision")
        return Vector(int(format), len(x), half.tobytes())
    levels = {S.VectorFormat.INT8: 127, S.VectorFormat.INT4: 7}.get(format)
    if levels is None:
        raise VectorFormatError(f"no vector format {format}")
    most = np.abs(x).max()
    if most == 0:
        raise VectorFormatError("a zero vector can't be quantised")
    scale = np.float32(most / np.float32(levels))
    q = np.clip(np.rint(x / scale), -levels, levels).astype(np.int8)
    inverse = float(np.float32(1.0 / np.sqrt((q.astype(np.int64) ** 2).sum())))
    if format == S.VectorFormat.INT8:
        return Vector(int(format), len(x), q.tobytes(), SCHEMES[format], float(scale), inverse)
    nibbles = np.append(q, np.int8(0))[: (len(q) + 1) // 2 * 2].astype(np.uint8) & 15
    return Vector(int(format), len(x), (nibbles[::2] | nibbles[1::2] << 4).astype(np.uint8).tobytes(), SCHEMES[format], float(scale), inverse)


def integers(v: Vector) -> np.ndarray:
    if v.format == S.VectorFormat.INT8:
        return np.frombuffer(v.data, dtype=np.int8).astype(np.int64)
    b = np.frombuffer(v.data, dtype=np.uint8)
    q = np.stack((b & 15, b >> 4), axis=1).ravel()[: v.dimensions].astype(np.int64)
    return np.where(q > 7, q - 16, q)


def decode(v: Vector) -> np.ndarray:
    """To float32."""
    v.check()
    if v.format == S.VectorFormat.FLOAT32:
        return np.frombuffer(v.data, dtype="<f4").astype(np.float32)
    if v.format == S.VectorFormat.FLOAT16:
        return np.frombuffer(v.data, dtype="<f2").astype(np.float32)
    return (integers(v).astype(np.float32) * np.float32(v.scale)).astype(np.float32)


def convert(v: Vector, format: int) -> Vector:
    return v if v.format == format else encode(decode(v), format)


def similarity(a: Vector, b: Vector) -> float:
    """Cosine of two encoded vectors of any formats."""
    if a.dimensions != b.dimensions:
        raise VectorFormatError("vectors of different dimensions")
    if a.scheme and b.scheme:
        return float(int((integers(a) * integers(b)).sum()) * a.inverse_norm * b.inverse_norm)
    x, y = decode(a), decode(b)
    p = (x * y).astype(np.float64).sum()
    n = np.sqrt((x * x).astype(np.float64).sum()) * np.sqrt((y * y).astype(np.float64).sum())
    return float(p / n) if n else 0.0


MAGIC = bytes((0x4F, 0x54, 0x45, 0x56))
_HEAD = struct.Struct("<4sHBBiii")


def to_envelope(v: Vector) -> bytes:
    v.check()
    extra = struct.pack("<ff", v.scale, v.inverse_norm) if v.scheme else b""
    return _HEAD.pack(MAGIC, v.encoding_version, v.format, v.scheme, v.dimensions, len(extra), len(v.data)) + extra + v.data


def from_envelope(raw: bytes) -> Vector:
    if len(raw) < _HEAD.size:
        raise VectorFormatError("shorter than a header")
    magic, version, format_, scheme, dims, n_extra, n_data = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise VectorFormatError("not a vector envelope")
    if version != S.ENCODING_VERSION:
        raise RecordVersionError(f"vector encoding {version}")
    if n_extra not in (0, 8) or bool(n_extra) != bool(scheme) or n_data < 0 or len(raw) != _HEAD.size + n_extra + n_data:
        raise VectorFormatError("lengths don't add up")
    scale, inverse = struct.unpack_from("<ff", raw, _HEAD.size) if n_extra else (0.0, 0.0)
    return Vector(format_, dims, raw[_HEAD.size + n_extra :], scheme, scale, inverse, version).check()


def encode_udf(format: int):
    """array<float> to the envelope, in Arrow batches; null for null."""

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else to_envelope(encode(v, format)))

    return run


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_udf(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else decode(from_envelope(b)))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def half_udf(vectors: pd.Series) -> pd.Series:
    """Components rounded to half precision."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype=np.float32).astype(np.float16).astype(np.float32))


def vector_struct(raw: bytes | Vector) -> dict:
    """The record form of an encoded vector."""
    v = from_envelope(raw) if isinstance(raw, bytes) else raw
    quantization = {"scheme": v.scheme, "scale": v.scale, "inverseIntegerNorm": v.inverse_norm} if v.scheme else None
    return {"encodingVersion": v.encoding_version, "format": v.format, "dimensions": v.dimensions, "data": v.data, "quantization": quantization}


def from_struct(s) -> Vector:
    q = s["quantization"]
    return Vector(s["format"], s["dimensions"], bytes(s["data"]), q["scheme"] if q else 0, q["scale"] if q else 0.0, q["inverseIntegerNorm"] if q else 0.0, s["encodingVersion"]).check()
