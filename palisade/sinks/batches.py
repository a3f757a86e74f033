"""Streaming sinks: each micro-batch is committed once, whatever is run again.

A folder belongs to one stream: batch numbers rise, and the highest committed one is kept in ``_commits``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.sinks.outputs import with_day


def store(spark: SparkSession, folder: str):
    """The folder's file system and the class of its paths."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(folder).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = store(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path(folder))] if fs.exists(path(folder)) else []


def delete(spark: SparkSession, folder: str) -> None:
    fs, path = store(spark, folder)
    fs.delete(path(folder), True)


def last_commit(spark: SparkSession, folder: str) -> int:
    """The highest committed batch, -1 where none is."""
    return max([int(n) for n in names(spark, f"{folder}/_commits") if n.isdigit()], default=-1)


def _commit(spark: SparkSession, folder: str, batch_id: int) -> None:
    fs, path = store(spark, folder)
    fs.create(path(f"{folder}/_commits/{batch_id}"), True).close()
    for n in names(spark, f"{folder}/_commits"):
        if n.isdigit() and int(n) < batch_id:
            fs.delete(path(f"{folder}/_commits/{n}"), False)


def write_batch(rows: DataFrame, batch_id: int, folder: str, by: list[str]) -> None:
    """Write a micro-batch into partitions of its own below ``by``, then commit it.

    A committed batch is left alone; one that was cut short before its commit replaces only its own partitions.  Days
    that the first try had and the second has not are never read, as its partitions go first.
    """
    spark = rows.sparkSession
    if batch_id <= last_commit(spark, folder):
        return
    for at in _partitions(spark, f"{folder}/data", by, batch_id):
        delete(spark, at)
    (rows.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by, "batch").parquet(f"{folder}/data"))
    _commit(spark, folder, batch_id)


def _partitions(spark: SparkSession, folder: str, by: list[str], batch_id: int) -> list[str]:
    """Folders of a batch below the partitions of ``by``."""
    tops = [folder]
    for column in by:
        tops = [f"{t}/{n}" for t in tops for n in names(spark, t) if n.startswith(f"{column}=")]
    return [f"{t}/batch={batch_id}" for t in tops if f"batch={batch_id}" in names(spark, t)]


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the committed batches; a filter on ``dt`` prunes folders."""
    return spark.read.parquet(f"{folder}/data").where(F.col("batch") <= last_commit(spark, folder))


def write_event_batch(events: DataFrame, batch_id: int, folder: str) -> None:
    write_batch(with_day(events), batch_id, folder, ["dt"])


def stream_events(events: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Persist a stream of sanitised events in day partitions, each micro-batch once."""
    return (events.writeStream.foreachBatch(lambda batch, n: write_event_batch(batch, n, folder))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
