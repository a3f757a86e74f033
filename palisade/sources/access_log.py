"""Access logs, parsed-event JSON and sanitised-event JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions import sanitize as S
from palisade.session import materialize

COMBINED = (r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (.*?)(?: HTTP/[0-9.]+)?" (\d{3}) (\d+|-) '
            r'"([^"]*)" "([^"]*)"')
PARSED = ("remote_addr string, timestamp string, method string, hex_path string, status int, bytes bigint, "
          "hex_referer string, hex_user_agent string, count bigint")
EVENT = ("event_id string, timestamp_bucket string, path_class string, scanner_family string, "
         "status_bucket string, count bigint")


#: Blocks of files whose offsets are broadcast: about 64 MB in a table keyed by one number.
BROADCAST_BLOCKS = 1_000_000


def _placed(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of a file scan with their file, their block of it, and their rank in the scan."""
    return rows.select(*columns, F.col("_metadata.file_path").alias("log_source"),
                       F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))


def in_file_order(placed: DataFrame, most: int = BROADCAST_BLOCKS) -> DataFrame:
    """``ord`` from 0 by file name, then place in the file, for rows that ``_placed`` made.

    The rows are landed below the shared folder first: a later scan may cut the files in other places and pack the
    pieces otherwise, as that follows the number of cores, so ranks are only ever compared within the one scan that
    was written.  Blocks are then counted, their counts summed per range of blocks and over the ranges (one row per
    shuffle task), and each row adds its block's offset.  The offsets are broadcast up to ``most`` blocks, keyed by a
    hash that was found to be free of collisions; beyond, rows meet them by file and block.
    """
    keys = ["log_source", "_block"]
    landed = materialize(placed)
    blocks = materialize(landed.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
                         .repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    before = blocks.groupBy("_range").agg(F.sum("_n").alias("_rows")).select(
        "_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_past"))
    inside = F.sum("_n").over(Window.partitionBy("_range").orderBy(*keys)) - F.col("_n")
    offsets = blocks.withColumn("_inside", inside).join(F.broadcast(before), "_range").select(
        *keys, (F.col("_past") + F.col("_inside") - F.col("_first")).alias("_shift"))
    mark = F.xxhash64(*keys).alias("_mark")
    size = blocks.select(mark).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_mark").alias("marks")).first()
    if size.n <= most and size.n == size.marks:
        met = landed.withColumn("_mark", mark).join(F.broadcast(offsets.select(mark, "_shift")), "_mark").drop("_mark")
    else:
        met = landed.join(offsets, keys)
    return met.withColumn("ord", F.col("_shift") + F.col("_at")).drop("_block", "_at", "_shift")


def read_access_log(spark: SparkSession, *paths: str) -> DataFrame:
    """Plain and .gz logs; ``ord`` counts lines from 0 in order of file name, then place in the file.

    Lines are read from the files once and written below the shared folder; they are neither sorted nor shuffled.
    """
    return in_file_order(_placed(spark.read.text(list(paths)), "value"))


def parse_access_log(lines: DataFrame) -> DataFrame:
    """Combined-format columns; ``parsed`` is false where the line does not fit."""
    groups = {"remote_addr": 1, "raw_time": 2, "method": 3, "path": 4, "status": 5, "bytes": 6,
              "referer": 7, "user_agent": 8}
    cut = lines.withColumn("parsed", F.col("value").rlike(COMBINED)).withColumns(
        {n: F.regexp_extract("value", COMBINED, g) for n, g in groups.items()})
    ts = F.try_to_timestamp("raw_time", F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return (cut.withColumn("ts", ts).withColumn("parsed", F.col("parsed") & F.col("ts").isNotNull())
            .withColumn("status", F.col("status").try_cast("int"))
            .withColumn("bytes", F.coalesce(F.col("bytes").try_cast("bigint"), F.lit(0)))
            .withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).drop("raw_time"))


def l1_rows(parsed: DataFrame) -> DataFrame:
    """Parsed lines as rows the event operators take: texts in hex, one hit each."""
    return parsed.where("parsed").select(
        "ord", "remote_addr", "ts", "timestamp", "method", S.hex_encode(F.col("path")).alias("hex_path"), "status", "bytes",
        S.hex_encode(F.col("referer")).alias("hex_referer"), S.hex_encode(F.col("user_agent")).alias("hex_user_agent"),
        F.lit(1).cast("bigint").alias("count"))


def parse_counts(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count(F.lit(1)).alias("lines"), F.count_if("parsed").alias("parsed"),
                      F.count_if(~F.col("parsed")).alias("skipped"))


def read_parsed_events(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON arrays of parsed rows; anything but an array of objects fails the read.

    ``ord`` counts rows from 0 in order of file name, then place in the array.  An array has no place where it could
    be cut without reading it, so one file is one task: large inputs come as many files.
    """
    rows = spark.read.schema(PARSED).option("multiLine", True).option("mode", "FAILFAST").json(list(paths))
    return with_defaults(in_file_order(_placed(rows, *rows.columns)).drop("log_source"))


def parse_parsed_events(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.inline(F.from_json("value", f"array<struct<{PARSED.replace(' string', ':string').replace(' int', ':int').replace(' bigint', ':bigint')}>>",
                                           {"mode": "FAILFAST"})))
    return with_defaults(rows)


def with_defaults(rows: DataFrame) -> DataFrame:
    text = ["remote_addr", "timestamp", "method", "hex_path", "hex_referer", "hex_user_agent"]
    return rows.withColumns({
        **{c: F.trim(F.coalesce(c, F.lit(""))) for c in text},
        "status": F.coalesce("status", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0)),
        "count": F.coalesce("count", F.lit(1))})


def parse_sanitized_events(docs: DataFrame) -> DataFrame:
    """Bare event lists and enveloped ones alike."""
    item = "array<struct<path_class:string,count:bigint>>"
    bare = F.from_json("value", item)
    wrapped = F.from_json("value", f"events {item}")["events"]
    events = F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped)
    return (docs.select(F.inline(events))
            .select(F.coalesce("path_class", F.lit("unknown")).alias("path_class"),
                    F.coalesce("count", F.lit(1)).alias("count")))


def read_sanitized_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_sanitized_events(spark.read.text(path, wholetext=True))
