"""Incremental forms of table operations, as Structured Streaming queries run to the end of their input.

Batches are written to the shared folder under their number, so a batch that is run again
replaces its own output and a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import app_folder


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A stream over the files of one table."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def rolling(stream: DataFrame, by: str, value: str, ts: str = "ts", width: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window, by, n, cents): sliding counts and sums; rows later than ``late`` are left out."""
    cents = F.round(F.col(value) * 100).cast("long")
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width, slide), by).agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))


def latest_of(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream over what there is now; the last version of each key's row."""
    spark = stream.sparkSession
    root = f"{app_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch_", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out/n={n}")

    run = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    schema = stream.schema.add("batch_", "integer")
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")
    w = Window.partitionBy(*keys).orderBy(F.desc("batch_"))
    return rows.withColumn("i_", F.row_number().over(w)).where("i_ = 1").drop("i_", "batch_")


def upserted(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key by ``order``, kept as a bounded state for each key."""
    best = stream.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("row_"))
    return latest_of(best, [key]).select("row_.*")
