"""Where results go: partitioned events, JSON reports, append-only logs, annotated rule files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_day(events: DataFrame) -> DataFrame:
    day = F.when(F.col("timestamp_bucket") == "unknown", F.lit("unknown")).otherwise(
        F.substring("timestamp_bucket", 1, 10))
    return events.withColumn("dt", day)


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Day-partitioned parquet; later day filters prune whole folders."""
    with_day(events).write.mode(mode).partitionBy("dt").parquet(path)


def report_json(totals: DataFrame, detail: DataFrame) -> DataFrame:
    """One JSON row of totals and one for each detail row; nothing is cut or gathered.

    Returns (part, report): part 0 holds the totals, part 1 the details.
    """
    part = lambda n: F.lit(n).cast("bigint").alias("part")
    return totals.select(part(0), F.to_json(F.struct(F.struct(*totals.columns).alias("totals"))).alias("report")).unionByName(
        detail.select(part(1), F.to_json(F.struct(F.struct(*detail.columns).alias("row"))).alias("report")))


def append_changelog(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def annotate_rules(lines: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """Config lines with an ageing comment above each rule, replacing the one already there.

    Returns (file_id, line_number, part, text): ``part`` 0 is the inserted comment, 1 the line.
    """
    aged = rules.select("file_id", "line_number", F.concat(
        F.lit("# aging: hits="), F.col("hits_in_period").cast("string"),
        F.lit(f", last-analyzed={as_of}")).alias("note"))
    w = Window.partitionBy("file_id").orderBy("line_number")
    joined = lines.join(aged, ["file_id", "line_number"], "left")
    replaced = F.lead("note").over(w).isNotNull() & F.col("line").startswith("# aging:")
    kept = joined.withColumn("_gone", replaced).where("NOT _gone")
    parts = F.array_compact(F.array(
        F.when(F.col("note").isNotNull(), F.struct(F.lit(0).cast("bigint").alias("part"), F.col("note").alias("text"))),
        F.struct(F.lit(1).cast("bigint").alias("part"), F.col("raw").alias("text"))))
    return kept.select("file_id", "line_number", F.inline(parts))
