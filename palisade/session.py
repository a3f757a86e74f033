"""Session settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "palisade", cpus: int | str = "*", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster the submitter owns the session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Hour buckets and dates are defined in UTC.  Classification compiles to methods the JVM refuses to
# optimise above 8000 bytes; below that limit Spark splits them into small ones (2x faster here).
# Its long CASE columns also make constraint inference cost half a minute of planning per join.
# A stream of sessions merges those of each task before its shuffle, so a busy source moves as few rows.
REQUIRED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def pin(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED_SETTINGS.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a private one only in a local session that names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palisade-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write a table below the shared folder and read it again: cuts the lineage, survives the loss of executors.

    A reliable checkpoint does the same but computes its rows twice, once to count them and once to write them.
    """
    folder = new_folder(df.sparkSession, "step")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/palisade/{label}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The same rows, dealt evenly to as many tasks as they need with some `rows` each.

    A file may be one row group, which one task reads however large it is; few rows stay where they are.
    """
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > 1 else df
