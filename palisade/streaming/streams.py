"""Streaming forms of the detectors.

Each takes a streaming or a batch DataFrame; only streams get a watermark, so a batch run over the
same rows is the reference for the stream's output.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palisade.operators.events import daily_sketches
from palisade.operators.ioc import address_part
from palisade.session import materialize
from palisade.sinks.batches import delete, names, write_batch

ISO = "yyyy-MM-dd'T'HH:mm:ss"

# The state function travels with the query: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def watermarked(df: DataFrame, delay: str) -> DataFrame:
    return df.withWatermark("ts", delay) if df.isStreaming else df


def hourly_classes(clean: DataFrame, delay: str = "2 hours") -> DataFrame:
    return (watermarked(clean, delay)
            .groupBy(F.window("ts", "1 hour").alias("w"), "path_class",
                     F.coalesce("scanner_family", F.lit("none")).alias("scanner"))
            .agg(F.sum("count").alias("hits"))
            .select(F.date_format("w.start", ISO).alias("hour"), "path_class", "scanner", "hits"))


def burst(clean: DataFrame, size: str = "2 seconds", slide: str = "1 second", at_least: int = 3,
          delay: str = "1 minute") -> DataFrame:
    # Counted, not filtered: a filter on the class would be pushed below what computes it.
    return (watermarked(clean, delay)
            .groupBy(F.window("ts", size, slide).alias("w"), "remote_addr", "path_class")
            .agg(F.count_if(F.col("path_class") != "unknown").alias("probes")).where(F.col("probes") >= at_least)
            .select(F.date_format("w.start", ISO).alias("start"), "remote_addr", "path_class", "probes"))


def sessions(clean: DataFrame, gap: str = "10 minutes", delay: str = "30 minutes") -> DataFrame:
    """Requests of one source with no more than ``gap`` between them; a session ends ``gap`` after its last request.

    A batch is first summed per source and slot of ``gap`` length.  Rows of one slot always belong together, so a
    source that holds most of the rows meets its task as one row per slot.  A stream merges the sessions of each task
    before they are shuffled (a setting that ``pin`` makes).  Rows without a time are in no session.
    """
    if clean.isStreaming:
        return (watermarked(clean, delay).groupBy(F.session_window("ts", gap).alias("w"), "remote_addr")
                .agg(F.count(F.lit(1)).alias("requests"), F.sum("count").alias("hits"))
                .select(F.date_format("w.start", ISO).alias("start"), F.date_format("w.end", ISO).alias("end"),
                        "remote_addr", "requests", "hits"))
    width = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {gap}"))
    micros = F.unix_micros("ts")
    slots = clean.where("ts IS NOT NULL").groupBy("remote_addr", F.floor(micros / width).alias("_slot")).agg(
        F.min(micros).alias("_first"), F.max(micros).alias("_last"), F.count(F.lit(1)).alias("requests"), F.sum("count").alias("hits"))
    order = Window.partitionBy("remote_addr").orderBy("_slot")
    opens = F.coalesce(F.col("_first") > F.lag("_last").over(order) + width, F.lit(True))
    return (slots.withColumn("_opens", opens.cast("int")).withColumn("_session", F.sum("_opens").over(order))
            .groupBy("remote_addr", "_session").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"),
                                                    F.sum("requests").alias("requests"), F.sum("hits").alias("hits"))
            .select(F.date_format(F.timestamp_micros("_first"), ISO).alias("start"),
                    F.date_format(F.timestamp_micros(F.col("_last") + width), ISO).alias("end"), "remote_addr", "requests", "hits"))


def ioc_hits(clean: DataFrame, indicators: DataFrame) -> DataFrame:
    """Live rows on indicator addresses; the static side is re-read with every micro-batch."""
    ips = (indicators.where("type = 'ip'").select(address_part(F.col("value")).alias("remote_addr"))
           .distinct())
    return clean.join(ips, "remote_addr").select("ord", "remote_addr", "path_class", "count")


REPLAY_KEY = ["remote_addr", "timestamp", "method", "hex_path", "status", "hex_user_agent"]


def drop_replays(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    if rows.isStreaming:
        return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(REPLAY_KEY)
    return rows.dropDuplicates(REPLAY_KEY)


def stream_traffic(clean: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Sums and sketches of each day, one row per day and micro-batch, committed once; ``summary_of`` folds them."""
    return (clean.writeStream.foreachBatch(lambda batch, n: write_batch(daily_sketches(batch), n, folder, ["dt"]))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


# --- temporary rules ---------------------------------------------------------------------------

def ttl_hours(kind: Column, profile: Column) -> Column:
    """Life of a temporary rule: a week for indicators, 30 days for addresses, a day in emergencies."""
    return (F.when((kind == "emergency") & (profile == "high-risk-lockdown"), 48)
            .when(kind == "emergency", 24).when(kind == "ip", 30 * 24).otherwise(7 * 24))


def rule_ttl(rules: DataFrame, as_of: str) -> DataFrame:
    expires = F.col("ts") + F.make_interval(hours=ttl_hours(F.col("kind"), F.col("profile")))
    return rules.withColumn("expires_at", F.date_format(expires, ISO)).withColumn(
        "expired", expires <= F.lit(as_of).cast("timestamp"))


def stream_rule_expiry(rules: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Emits a rule once event time passes its end of life; a renewal moves the end."""
    def expire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (end,) = state.get
            state.remove()
            yield pd.DataFrame({"rule_id": [key[0]], "expired_at_ms": [end]})
            return
        end = max(int((b["ts"].astype("datetime64[ms]").astype("int64")
                       + b["ttl_h"].astype("int64") * 3_600_000).max()) for b in batches)
        if state.exists:
            end = max(end, state.get[0])
        state.update((end,))
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    timed = rules.withWatermark("ts", delay).withColumn("ttl_h", ttl_hours(F.col("kind"), F.col("profile")))
    return timed.groupBy("rule_id").applyInPandasWithState(
        expire, "rule_id string, expired_at_ms long", "end long", "append",
        GroupStateTimeout.EventTimeTimeout)


# --- feed landing ------------------------------------------------------------------------------

def latest_indicators(rows: DataFrame) -> DataFrame:
    cols = [c for c in rows.columns if c not in ("type", "value")]
    return rows.groupBy("type", "value").agg(
        F.max_by(F.struct(*cols), F.struct("seen_at", "confidence", "source")).alias("x")).select("type", "value", "x.*")


def _manifest(spark: SparkSession, table: str) -> tuple[int, dict[int, str]]:
    """The newest committed version (-1 if there is none) and the folder of each of its buckets."""
    done = [int(n[2:]) for n in names(spark, f"{table}/manifest")
            if n.startswith("v=") and "_SUCCESS" in names(spark, f"{table}/manifest/{n}")]
    if not done:
        return -1, {}
    # One row per bucket: bounded by the number of buckets.
    return max(done), {r.bucket: r.folder for r in spark.read.parquet(f"{table}/manifest/v={max(done)}").collect()}


def feed_upsert(batch: DataFrame, batch_id: int, table: str, buckets: int = 64) -> None:
    """Merge a micro-batch into a table of hash buckets; only buckets that the batch touches are written anew.

    A version is a manifest that names each bucket's folder, written last, so a batch that was cut short changes
    nothing and one that is committed is not merged again.  Folders that neither this version nor the one before
    names are dropped; readers of the version before stay whole.  A table keeps its number of buckets.
    """
    spark: SparkSession = batch.sparkSession
    version, old = _manifest(spark, table)
    if batch_id <= version:
        return
    bucket = F.pmod(F.xxhash64("type", "value"), F.lit(buckets)).cast("int")
    fresh = materialize(latest_indicators(batch).withColumn("bucket", bucket))
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
    known = [f"{table}/{old[b]}" for b in touched if b in old]
    rows = fresh.drop("bucket")
    if known:
        rows = rows.unionByName(spark.read.parquet(*known))
    merged = latest_indicators(rows).withColumn("bucket", bucket)
    merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/data/v={batch_id}")
    now = old | {b: f"data/v={batch_id}/bucket={b}" for b in touched}
    if not now:
        return
    spark.createDataFrame(sorted(now.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(
        f"{table}/manifest/v={batch_id}")
    named = {*now.values(), *old.values()}
    for v in names(spark, f"{table}/data"):
        left = [b for b in names(spark, f"{table}/data/{v}") if b.startswith("bucket=")]
        gone = [b for b in left if f"data/{v}/{b}" not in named]
        for b in gone:
            delete(spark, f"{table}/data/{v}/{b}")
        if len(gone) == len(left):
            delete(spark, f"{table}/data/{v}")
    for m in names(spark, f"{table}/manifest"):
        if m.startswith("v=") and int(m[2:]) < version:
            delete(spark, f"{table}/manifest/{m}")


def read_indicators(spark: SparkSession, table: str) -> DataFrame:
    """The newest committed version of an indicator table."""
    _, folders = _manifest(spark, table)
    if not folders:
        raise ValueError(f"no committed version in {table}")
    return spark.read.parquet(*[f"{table}/{f}" for f in folders.values()])


def stream_ioc(clean: DataFrame, table: str, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Live rows on indicator addresses, each micro-batch against the table's newest version, committed once."""
    def match(batch: DataFrame, batch_id: int) -> None:
        write_batch(ioc_hits(batch, read_indicators(batch.sparkSession, table)), batch_id, folder, [])

    return (clean.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
