"""Resumable ingestion: only files that no earlier run has taken."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ingest_new(spark: SparkSession, path: str, schema, checkpoint: str, each: Callable[[DataFrame, int], None], form: str = "parquet", name: str | None = None) -> None:
    """Gives each micro-batch of new files to ``each``; a second run with the checkpoint gives nothing new."""
    stream = spark.readStream.format(form).schema(schema)
    if name:
        stream = stream.option("pathGlobFilter", name)
    query = stream.load(path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset a temporary one, on one machine only (an error elsewhere)."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
