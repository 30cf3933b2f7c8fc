"""Sinks that may be written again: a batch replaces what an earlier try of it has left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillmark.operators.numbering import LOCAL_CHECKPOINTS


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster's shared files go."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", LOCAL_CHECKPOINTS)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df computed once into a table in the shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """df as the partition `batch` of a Parquet table: only that partition is replaced, so a batch that is written again
    after a failure leaves its rows once. An empty batch clears its partition."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def write_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A query that writes each of a stream's batches once, however often it is tried, over all that is there."""
    return stream.writeStream.foreachBatch(lambda df, n: write_batch(df, path, n)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_stream(stream: DataFrame, name: str, mode: str = "append", reader: SparkSession | None = None) -> DataFrame:
    """All rows of a stream over what is there now, from a table in the shared folder, read in the stream's session or
    in another one."""
    path = shared_folder(stream.sparkSession, name)
    write_stream(stream, f"{path}/rows", f"{path}/checkpoint", mode).awaitTermination()
    return (reader or stream.sparkSession).read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)
