"""Blob index kept by a stream of puts and accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store


def apply_batch(index: DataFrame, batch: DataFrame) -> DataFrame:
    """One micro-batch of (kind, digest, algorithm, size, at) over an index: puts
    replace rows, then accesses count."""
    puts = store.new_rows(batch.where("kind = 'put'"))
    return store.touch(store.upsert(index, puts), batch.where("kind = 'access'").select("digest", "at"))


def maintain(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the index under ``path`` in versioned folders; each micro-batch reads the
    version before it and writes its own, so a repeated batch gives the same result."""

    def step(batch: DataFrame, number: int) -> None:
        index = read_version(batch.sparkSession, path, number - 1)
        apply_batch(index, batch).write.mode("overwrite").parquet(f"{path}/v={number}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_version(spark: SparkSession, path: str, number: int) -> DataFrame:
    if number < 0:
        return spark.createDataFrame([], store.INDEX_SCHEMA)
    return spark.read.schema(store.INDEX_SCHEMA).parquet(f"{path}/v={number}")


def access_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Accesses per digest and hour of a stream (digest, ts), with late data up to
    the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "digest").agg(F.count("*").alias("accesses")).select(F.col("window.start").alias("hour"), "digest", "accesses")
