"""Findings from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.plans.engine import Engine

DOCS = "doc_id bigint, name string, format string, source string, at timestamp"


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of document rows from JSON files that arrive in a folder."""
    return spark.readStream.schema(DOCS).json(folder)


def once_each(docs: DataFrame, within: str = "30 minutes") -> DataFrame:
    """Drops what came before with the same content within a span of event time; state is bounded by the watermark."""
    return docs.withColumn("_key", F.xxhash64("name", "source")).withWatermark("at", within).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def lint_stream(docs: DataFrame, engine: Engine, out: str, checkpoint: str):
    """Starts a query that lints each micro-batch with the batch engine and appends findings as Parquet."""
    def each(batch: DataFrame, batch_id: int) -> None:
        engine.lint(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)
        engine.release()

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events by hour and type with late data up to a bound (ts, event_type)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
