"""Documents as they arrive: cut, embedded and filtered in Structured Streaming.

All of it works on each row by itself, so the stream keeps no state; corpus statistics and best-of
lists need a batch, for which search_batches() hands each micro-batch to a batch search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import semantic
from ..operators.chunking import Tokenizer
from ..operators.embedding import Embedder, embed_documents
from ..operators.filters import Filter, Resolve, condition
from ..options import ChunkOptions


def read_documents(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def ingest(docs: DataFrame, key: str, text: str, embedder: Embedder, tokenizer: Tokenizer, path: str, checkpoint: str, chunking: ChunkOptions | None = None) -> StreamingQuery:
    """Appends the embedded chunks of arriving documents to a table in a folder a space; once for each document."""
    rows = embed_documents(docs, key, text, embedder, tokenizer, chunking)
    return rows.writeStream.format("parquet").partitionBy("fingerprint").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def filter_stream(rows: DataFrame, f: Filter, resolve: Resolve) -> DataFrame:
    return rows.where(condition(f, resolve))


def score_stream(rows: DataFrame, query: semantic.QueryVector, least: float) -> DataFrame:
    """Arriving chunks (item, field, weight, vector, tokens, capacity, fingerprint, chunk) whose adjusted similarity to a standing query is at least that."""
    return semantic.chunk_scores(rows, query, strict=False).where(F.col("adjusted") >= least)


def search_batches(rows: DataFrame, search: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(lambda batch, n: sink(search(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, ts: str, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Counts and sums of arriving events by window and kind; state of windows older than the lateness is let go."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
