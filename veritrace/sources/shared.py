"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _prepared(spark: SparkSession) -> str:
    """The folder: spark.checkpoint.dir or what the session has set. A session on one machine without either gets
    one of its own; on a cluster that is an error, since a machine's own folder would lose data there."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veritrace-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{_prepared(spark)}/veritrace-{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: each use sees the same rows, also after an executor is lost."""
    _prepared(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan whose work is in each row's text, dealt over the cores if it has fewer than half as many splits: a
    small table may be one file, or one row group of it. A table of more splits is read as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
