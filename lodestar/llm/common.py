"""What the text operators share: bounded Arrow batches, worker-lifetime caches, columns that may be absent."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a few very long texts never meet in one batch.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds. The settings only change batching, never results."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as the Python worker, across tasks."""
    store = sys.modules.setdefault("_lodestar_worker", type(sys)("_lodestar_worker"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def byte_list(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def text_list(column: pa.Array) -> list[str]:
    """Each text; null becomes empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def map_text(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def id_and_text(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under names of its own."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
