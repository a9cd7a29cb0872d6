"""Live summary of appended traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def windowed_summary(traces: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(window_start, action, count, duration_ms, errors) by event time.

    The watermark bounds the state of a stream; on a batch it has no effect.
    """
    seen = traces.withWatermark("timestamp", lateness) if traces.isStreaming else traces
    zero = F.coalesce("duration_ms", F.lit(0.0))
    return (
        seen.groupBy(F.window("timestamp", width).alias("w"), "action")
        .agg(F.count("*").alias("count"), F.sum(zero).alias("duration_ms"), F.count_if(F.col("error").isNotNull()).alias("errors"))
        .select(F.col("w.start").alias("window_start"), "action", "count", "duration_ms", "errors")
    )


def follow_summary(traces: DataFrame, out: str, checkpoint: str, width: str = "1 hour", lateness: str = "10 minutes", **trigger) -> object:
    """Keep the summary up to date at ``out``: every trigger appends the rows
    that changed, numbered by batch; :func:`read_summary` takes the latest.

    A repeated batch writes the same folder again, so nothing counts twice.
    """

    def append(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    options = trigger or {"availableNow": True}
    return (
        windowed_summary(traces, width, lateness).writeStream.outputMode("update").foreachBatch(append)
        .option("checkpointLocation", checkpoint).trigger(**options).start()
    )


def read_summary(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.parquet(out)
    last = rows.groupBy("window_start", "action").agg(F.max_by(F.struct("count", "duration_ms", "errors"), "batch").alias("r"))
    return last.select("window_start", "action", "r.*")
