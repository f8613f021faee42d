"""A folder for derived files: under the one the session names for checkpoints, a temporary one only in a local session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path that nothing has written to."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="trackworks-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to a new path and read again: what comes after has a short plan and survives lost executors."""
    path = scratch(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drained(stream: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """All that a stream appends from what there is now, through a Parquet sink with a checkpoint of its own.

    out: the folder of an earlier run, which is resumed where it stopped.
    """
    spark = stream.sparkSession
    out = out or scratch(spark, name)
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def settled(stream: DataFrame, name: str) -> DataFrame:
    """The last state of an aggregate that a stream keeps (complete mode), written as Parquet by each batch."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    put = lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows")
    q = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
