"""Attempt logs as streams: canonical attempts, resumed prompts, windowed error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def canonical(attempts: DataFrame) -> DataFrame:
    """Of each prompt, the earliest attempt without error, else the earliest: a running minimum, for update or complete mode."""
    order = F.struct("is_error", "created_at", "idx")
    return attempts.groupBy("prompt_id").agg(F.min(order).alias("a"), F.count("*").alias("attempts")).select("prompt_id", "a.*", "attempts")


def error_rates(attempts: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Attempts and errors of each window; rows later than the watermark are dropped, windows are final once it has passed."""
    return attempts.withWatermark("created_at", late).groupBy(F.window("created_at", window).alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("is_error").cast("long")).alias("errors")).select("w.start", "w.end", "n", "errors")


def first_per_prompt(attempts: DataFrame, late: str = "30 days") -> DataFrame:
    """One durable record for each prompt; state older than the watermark is let go."""
    return attempts.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["prompt_id"])


def append_log(attempts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet log, exactly once: file sink with a checkpoint."""
    return attempts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def unfinished(prompts: DataFrame, log: DataFrame) -> DataFrame:
    """Prompts to resume: those without an attempt free of error."""
    return prompts.join(log.where(~F.col("is_error")).select("prompt_id").distinct(), "prompt_id", "left_anti")
