"""Config corpora and their snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BACKUP = r"^(.*)\.bak\.(\d{8}-\d{6}(?:-\d{3})?)$"
SIDECAR = "run_id string, size_bytes bigint, sha256 string"


def read_config_corpus(spark: SparkSession, root: str, host: str = "local",
                       snapshot_id: str = "current") -> DataFrame:
    """Every *.conf below a folder, one row per file."""
    rows = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.conf")
            .text(root, wholetext=True))
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    return rows.select(F.lit(host).alias("host"), path.alias("path"), F.lit(snapshot_id).alias("snapshot_id"),
                       F.concat_ws("|", F.lit(host), path, F.lit(snapshot_id)).alias("file_id"),
                       F.col("value").alias("text"))


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(name, length, content) of backups and sidecars below a folder."""
    rows = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.bak.*").load(folder))
    return rows.select(F.regexp_replace("path", "^file:/+", "/").alias("name"), "length", "content")


def backup_time(backup_id: Column) -> Column:
    return F.date_format(F.try_to_timestamp(F.substring(backup_id, 1, 15), F.lit("yyyyMMdd-HHmmss")),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")


def snapshot_catalog(stored: DataFrame) -> DataFrame:
    """Backups with what their sidecar says; a missing or broken sidecar leaves NULLs.

    Only names, sizes, digests and sidecar fields are joined; file contents stay where they were read.
    """
    is_meta = F.col("name").endswith(".meta.json")
    backups = stored.where(~is_meta & F.col("name").rlike(BACKUP)).select(
        "name", F.regexp_extract("name", BACKUP, 1).alias("path"),
        F.regexp_extract("name", BACKUP, 2).alias("backup_id"),
        F.col("length").cast("bigint").alias("size_bytes"), F.sha2("content", 256).alias("actual_sha256"))
    meta = stored.where(is_meta).select(
        F.regexp_replace("name", r"\.meta\.json$", "").alias("name"),
        F.from_json(F.col("content").cast("string"), SIDECAR).alias("m"))
    return (backups.join(meta, "name", "left")
            .select("path", "backup_id", backup_time(F.col("backup_id")).alias("timestamp"), "size_bytes",
                    F.col("m.run_id").alias("run_id"), "actual_sha256",
                    F.col("m.sha256").alias("stated_sha256"), F.col("m.size_bytes").alias("stated_size")))


def snapshot_integrity(catalog: DataFrame) -> DataFrame:
    ok = (F.col("actual_sha256").eqNullSafe(F.col("stated_sha256"))
          & F.col("size_bytes").eqNullSafe(F.col("stated_size")))
    return catalog.select("path", "backup_id", F.when(F.col("stated_sha256").isNull(), F.lit("no sidecar"))
                          .when(ok, F.lit("intact")).otherwise(F.lit("damaged")).alias("state"))
