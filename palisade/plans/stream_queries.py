"""Registered batch forms of the streaming jobs, and the snapshot catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators.detect import hashed
from palisade.plans import oracle as O
from palisade.plans.detect_queries import SALT
from palisade.plans.fixtures import view, with_views
from palisade.plans.log_queries import access, clean
from palisade.session import new_folder, table
from palisade.sources import configs as F_
from palisade.streaming import streams as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name, run, oracle=None):
    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = oracle


_ISO = "'%Y-%m-%dT%H:%M:%S'"
_ADDR = f"sha256(concat('{SALT}', remote_addr)) AS remote_addr"

add("stream_hourly_classes", lambda s, d: R.hourly_classes(clean(s, d)), O.over_sanitized(f"""
SELECT strftime(date_trunc('hour', ts), {_ISO}) AS hour, path_class, coalesce(scanner_family, 'none') AS scanner, CAST(sum(count) AS BIGINT) AS hits
FROM sanitized GROUP BY 1, 2, 3"""))
# Hours instead of the default seconds, so that the sparse test data has bursts at all.
add("stream_burst", lambda s, d: hashed(R.burst(clean(s, d), "2 hours", "1 hour", 2), SALT), O.over_sanitized(f"""
SELECT strftime(w, {_ISO}) AS start, {_ADDR}, path_class, count(*) AS probes FROM (
  SELECT date_trunc('hour', ts) AS w, remote_addr, path_class FROM sanitized WHERE path_class <> 'unknown'
  UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR, remote_addr, path_class FROM sanitized WHERE path_class <> 'unknown') x
GROUP BY w, remote_addr, path_class HAVING count(*) >= 2"""))
add("stream_sessions", lambda s, d: hashed(R.sessions(clean(s, d), "60 minutes"), SALT), O.over_sanitized(f"""
SELECT strftime(date_trunc('second', min(ts)), {_ISO}) AS start, strftime(date_trunc('second', max(ts) + INTERVAL 60 MINUTES), {_ISO}) AS "end", {_ADDR},
  count(*) AS requests, CAST(sum(count) AS BIGINT) AS hits FROM (
  SELECT *, sum(CASE WHEN ts > prev + INTERVAL 60 MINUTES OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY remote_addr ORDER BY ts) AS s FROM (
    SELECT *, lag(ts) OVER (PARTITION BY remote_addr ORDER BY ts) AS prev FROM sanitized) a) b GROUP BY remote_addr, s"""))
add("stream_ioc", lambda s, d: hashed(R.ioc_hits(clean(s, d), view(s, d, "indicators")), SALT), O.over_sanitized(f"""
SELECT ord, {_ADDR}, path_class, count FROM sanitized WHERE remote_addr IN (SELECT split_part(value, ':', 1) FROM indicators WHERE type = 'ip')""", "indicators"))


def stream_dedup(s, d):
    rows = access(s, d)
    twice = rows.unionByName(rows)
    return R.drop_replays(twice).groupBy("method", F.col("status").cast("bigint").alias("status")).agg(
        F.count(F.lit(1)).alias("rows"))


add("stream_dedup", stream_dedup, O.over_access(f"""
SELECT method, CAST(status AS BIGINT) AS status, count(*) AS rows FROM (SELECT DISTINCT {', '.join(R.REPLAY_KEY)} FROM access_events) x GROUP BY 1, 2"""))

_TEMP = """SELECT event_id AS ord, CAST(ts AS TIMESTAMP) AS ts, CASE event_id % 3 WHEN 0 THEN 'ioc' WHEN 1 THEN 'ip' ELSE 'emergency' END AS kind,
  CASE WHEN event_id % 4 = 0 THEN 'high-risk-lockdown' ELSE 'edge-public' END AS profile FROM events"""


def rule_ttl(s, d):
    table(s, d, "events").createOrReplaceTempView("events")
    return R.rule_ttl(s.sql(_TEMP), "2024-01-25 00:00:00").select("ord", "kind", "profile", "expires_at", "expired")


add("rule_ttl", rule_ttl, f"""SELECT ord, kind, profile, strftime(e, {_ISO}) AS expires_at, e <= TIMESTAMP '2024-01-25 00:00:00' AS expired FROM (
  SELECT *, ts + CASE WHEN kind = 'emergency' AND profile = 'high-risk-lockdown' THEN INTERVAL 48 HOURS WHEN kind = 'emergency' THEN INTERVAL 24 HOURS
    WHEN kind = 'ip' THEN INTERVAL 720 HOURS ELSE INTERVAL 168 HOURS END AS e FROM ({_TEMP}) t) x""")
add("feed_upsert", lambda s, d: R.latest_indicators(view(s, d, "indicators").withColumnRenamed("first_seen", "seen_at"))
    .select("type", "value", "seen_at", "confidence", "source"),
    with_views("""SELECT type, value, first_seen AS seen_at, confidence, source FROM indicators
      QUALIFY row_number() OVER (PARTITION BY type, value ORDER BY first_seen DESC, confidence DESC, source DESC) = 1""", "indicators"))



def feed_upsert_batches(s, d):
    """The table after four micro-batches, some run again, the way a stream writes it."""
    rows = view(s, d, "indicators").withColumnRenamed("first_seen", "seen_at")
    folder = new_folder(s, "indicators")
    for n, part in ((0, 0), (1, 1), (1, 1), (2, 2), (3, 3), (2, 0)):
        R.feed_upsert(rows.where(F.pmod(F.length("value") + F.length("source"), F.lit(4)) == part), n, folder, 16)
    return R.read_indicators(s, folder).select("type", "value", "seen_at", "confidence", "source")


add("feed_upsert_batches", feed_upsert_batches, ORACLES["feed_upsert"])

# --- snapshots as they lie on disk -------------------------------------------------------------


def stored(s, d):
    """Backup files and sidecars of the fleet; some sidecars are missing or state a wrong digest."""
    files = view(s, d, "config_files").withColumn("name", F.concat_ws("", "host", "path", F.lit(".bak."), "snapshot_id"))
    digest = F.when(F.col("host").endswith("3"), F.lit("0")).otherwise(F.sha2(F.encode("text", "UTF-8"), 256))
    side = F.to_json(F.struct(F.concat(F.lit("run-"), "snapshot_id").alias("run_id"),
                              F.octet_length("text").cast("bigint").alias("size_bytes"), digest.alias("sha256")))
    backups = files.select("name", F.octet_length("text").cast("bigint").alias("length"), F.encode("text", "UTF-8").alias("content"))
    sidecars = files.where(~F.col("host").endswith("4")).select(
        F.concat("name", F.lit(".meta.json")).alias("name"), F.octet_length(side).cast("bigint").alias("length"),
        F.encode(side, "UTF-8").alias("content"))
    return backups.unionByName(sidecars)


_DATE = "concat(substr(snapshot_id, 1, 4), '-', substr(snapshot_id, 5, 2), '-', substr(snapshot_id, 7, 2), 'T', substr(snapshot_id, 10, 2), ':', substr(snapshot_id, 12, 2), ':', substr(snapshot_id, 14, 2), 'Z')"
_HAS = "host NOT LIKE '%4'"
add("snapshot_catalog", lambda s, d: F_.snapshot_catalog(stored(s, d)), with_views(f"""
SELECT concat(host, path) AS path, snapshot_id AS backup_id, {_DATE} AS timestamp, CAST(strlen(text) AS BIGINT) AS size_bytes,
  CASE WHEN {_HAS} THEN concat('run-', snapshot_id) END AS run_id, sha256(text) AS actual_sha256,
  CASE WHEN {_HAS} THEN CASE WHEN host LIKE '%3' THEN '0' ELSE sha256(text) END END AS stated_sha256,
  CASE WHEN {_HAS} THEN CAST(strlen(text) AS BIGINT) END AS stated_size FROM config_files""", "config_files"))
add("snapshot_integrity", lambda s, d: F_.snapshot_integrity(F_.snapshot_catalog(stored(s, d))), with_views(f"""
SELECT concat(host, path) AS path, snapshot_id AS backup_id, CASE WHEN NOT ({_HAS}) THEN 'no sidecar' WHEN host LIKE '%3' THEN 'damaged' ELSE 'intact' END AS state
FROM config_files""", "config_files"))
add("read_config_corpus", lambda s, d: view(s, d, "config_files").groupBy("path", "snapshot_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).alias("bytes")),
    with_views("SELECT path, snapshot_id, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM config_files GROUP BY 1, 2", "config_files"))
