"""The usage log as a stream: records are appended exactly once, late ones are counted as long as they are awaited."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "timestamp TIMESTAMP, agent_name STRING, model_name STRING, prompt_tokens BIGINT, completion_tokens BIGINT"


def append_once(records: DataFrame, log: str, run: str, checkpoint: str) -> StreamingQuery:
    """Appends all that a stream has now to the log, a folder for each run and batch of it: run=.../batch=.... A batch
    that is written again after a failure, since its end was not noted, replaces its own folder: nothing is
    added twice. What has been noted in checkpoint is not read again."""
    if "/" in run or "=" in run or not run:
        raise ValueError("a run's name stands in a path: it has neither / nor =")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/run={run}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, log: str, schema: str = SCHEMA) -> DataFrame:
    """All runs' records, with run and batch."""
    return spark.read.schema(f"{schema}, run STRING, batch BIGINT").option("basePath", log).parquet(log)


def windowed(records: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tokens by agent and window of a stream or a frame. In a stream, a window is open until records a day later
    (late) are seen; records for a window that is closed are not counted any more."""
    out = records.withWatermark("timestamp", late) if records.isStreaming else records
    return out.groupBy(F.window("timestamp", width), "agent_name").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def usage_by_window(spark: SparkSession, path: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """windowed over a folder to which JSON records are added."""
    return windowed(spark.readStream.schema(SCHEMA).json(path), width, late)
