"""Records of chunks, queries and single embeddings as JSON text and as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import OptionError
from ..functions.vectors import vector_struct

KINDS = {"chunk": S.CHUNK_RECORD, "query": S.QUERY_RECORD, "single": S.SINGLE_RECORD}


def to_json(record: Column) -> Column:
    """Binary fields become base64; absent ones are left out."""
    return F.to_json(record)


def from_json(text: Column, kind: str) -> Column:
    """A record of a kind; unknown properties are passed over, other versions and malformed texts are errors. Null for null."""
    if kind not in KINDS:
        raise OptionError(f"no record kind {kind}")
    schema = KINDS[kind]
    record = F.from_json(text, schema)
    version = F.get_json_object(text, "$.schemaVersion").cast("int")
    dims, data, format_ = (F.from_json(text, schema)[f"vector"][c] for c in ("dimensions", "data", "format"))
    want = F.when(format_ == int(S.VectorFormat.FLOAT32), dims * 4).when(format_ == int(S.VectorFormat.FLOAT16), dims * 2).when(format_ == int(S.VectorFormat.INT8), dims).when(format_ == int(S.VectorFormat.INT4), F.floor((dims + 1) / 2))
    bad = F.raise_error(F.concat(F.lit("record version "), F.coalesce(version.cast("string"), F.lit("missing")))).cast(schema)
    malformed = F.raise_error(F.lit("the record's vector is malformed")).cast(schema)
    return F.when(text.isNull(), F.lit(None).cast(schema)).when(F.coalesce(version, F.lit(0)) != S.SCHEMA_VERSION, bad).when(F.coalesce(F.octet_length(data) == want, F.lit(False)), record).otherwise(malformed)


@F.pandas_udf(S.VECTOR)
def vector_of(encoded: pd.Series) -> pd.DataFrame:
    """The record form of a vector envelope."""
    return pd.DataFrame([vector_struct(bytes(e)) for e in encoded], columns=S.VECTOR.fieldNames())


def chunk_record(rows: DataFrame) -> Column:
    """The record of rows that embed_documents() returns."""
    return F.struct(
        F.col("schema_version").alias("schemaVersion"),
        vector_of("encoded").alias("vector"),
        F.struct(F.col("model_id").alias("modelId"), F.col("revision").alias("sourceRevision"), F.col("fingerprint").alias("embeddingSpaceFingerprint"), F.lit(True).alias("isNormalized")).alias("identity"),
        F.struct(F.col("document_tokens").alias("documentTokenCount"), F.struct(F.col("char_start").alias("start"), F.col("char_length").alias("length")).alias("characterRange"), F.struct(F.col("token_start").alias("start"), F.col("token_count").alias("length")).alias("tokenRange"), F.col("token_count").alias("tokenCount"), F.col("token_capacity").alias("tokenCapacity")).alias("source"),
        F.struct(F.col("chunk").alias("index"), F.col("chunks").alias("count"), F.col("boundary").alias("boundaryKind"), F.col("heading_path").alias("headingPath"), F.col("context_tokens").alias("contextTokenCount"), F.lit(0).alias("modelPrefixTokenCount"), F.col("special_tokens").alias("specialTokenCount"), F.col("input_tokens").alias("inputTokenCount")).alias("chunk"),
        F.lit(None).cast(S.REDUCTION).alias("dimensionReduction"),
        F.col("text").alias("text"),
        F.col("context").alias("context"),
    )


def write_records(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet in a folder a space, so that a search of one space reads no other."""
    rows.write.mode(mode).partitionBy("fingerprint").parquet(path)


def read_records(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("fingerprint") == fingerprint) if fingerprint else rows


def capabilities(spark: SparkSession) -> dict[str, object]:
    """What this session can do."""
    import importlib.util

    return {"spark": spark.version, "exact": True, "approximate": True, "half_precision": True, "onnx": importlib.util.find_spec("onnxruntime") is not None, "tokenizers": importlib.util.find_spec("tokenizers") is not None}
