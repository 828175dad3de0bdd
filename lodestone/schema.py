"""Schemas of embedding records, and the stable codes of their enumerations."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T

SCHEMA_VERSION = 1
ENCODING_VERSION = 1


class VectorFormat(IntEnum):
    INT4 = 1
    INT8 = 2
    FLOAT16 = 3
    FLOAT32 = 4


class Quantization(IntEnum):
    NONE = 0
    INT4 = 1
    INT8 = 2


class Boundary(IntEnum):
    UNKNOWN = 0
    WHOLE_DOCUMENT = 1
    SECTION = 2
    PARAGRAPHS = 3
    PARAGRAPH = 4
    SENTENCES = 5
    SENTENCE = 6
    WORDS = 7
    TOKENS = 8


class Purpose(IntEnum):
    UNKNOWN = 0
    DOCUMENT = 1
    QUERY = 2


class Mass(IntEnum):
    RANGE_COVERAGE = 1
    TOKEN_COUNT = 2


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


RANGE = _struct(start=T.IntegerType(), length=T.IntegerType())
QUANTIZATION = _struct(scheme=T.IntegerType(), scale=T.FloatType(), inverseIntegerNorm=T.FloatType())
VECTOR = _struct(encodingVersion=T.IntegerType(), format=T.IntegerType(), dimensions=T.IntegerType(), data=T.BinaryType(), quantization=QUANTIZATION)
IDENTITY = _struct(modelId=T.StringType(), sourceRevision=T.StringType(), embeddingSpaceFingerprint=T.StringType(), isNormalized=T.BooleanType())
SOURCE = _struct(documentTokenCount=T.IntegerType(), characterRange=RANGE, tokenRange=RANGE, tokenCount=T.IntegerType(), tokenCapacity=T.IntegerType())
CHUNK = _struct(index=T.IntegerType(), count=T.IntegerType(), boundaryKind=T.IntegerType(), headingPath=T.ArrayType(T.StringType()), contextTokenCount=T.IntegerType(), modelPrefixTokenCount=T.IntegerType(), specialTokenCount=T.IntegerType(), inputTokenCount=T.IntegerType())
REDUCTION = _struct(strategy=T.StringType(), sourceDimensions=T.IntegerType(), outputDimensions=T.IntegerType(), sourceFingerprint=T.StringType())
CHUNK_RECORD = _struct(schemaVersion=T.IntegerType(), vector=VECTOR, identity=IDENTITY, source=SOURCE, chunk=CHUNK, dimensionReduction=REDUCTION, text=T.StringType(), context=T.StringType())
QUERY_RECORD = _struct(schemaVersion=T.IntegerType(), vector=VECTOR, identity=IDENTITY, sourceTokenCount=T.IntegerType(), inputTokenCount=T.IntegerType(), dimensionReduction=REDUCTION)
AGGREGATION = _struct(method=T.StringType(), massMethod=T.IntegerType(), sourceCount=T.IntegerType(), sourceTokens=T.DoubleType(), coherence=T.DoubleType(), minSimilarity=T.DoubleType(), medoidFallback=T.BooleanType())
SINGLE_RECORD = _struct(schemaVersion=T.IntegerType(), vector=VECTOR, identity=IDENTITY, aggregation=AGGREGATION, dimensionReduction=REDUCTION)
