"""Detectors over cleaned access rows.

Per-source windows are cut by time: a busy source is spread over many tasks, and each slice also
reads the few seconds before it, so results equal those of one window over the whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import sanitize as S
from palisade.operators.events import hits_by_label

#: Slices are this many times the reach, so that a row is carried once in as many slices at most.
REACHES = 30


def sliced(rows: DataFrame, reach: int, keep: Column | None = None) -> DataFrame:
    """Rows with ``_slice``; rows within ``reach`` seconds of a slice's end also lead the next one.

    Rows that fail ``keep`` get no slice.  A filter on a label would be pushed below the columns
    that compute it and run the whole classification twice.
    """
    size = REACHES * reach
    micros = F.unix_micros("ts")
    at = F.floor(micros / (size * 1_000_000))
    carried = F.floor((micros + reach * 1_000_000) / (size * 1_000_000))
    return (rows.withColumn("_us", micros).withColumn("_own", at)
            .withColumn("_slice", F.explode(F.when(F.lit(True) if keep is None else keep,
                                                   F.sequence(at, carried)))))


def burst_detect(clean: DataFrame, seconds: int = 2, at_least: int = 3) -> DataFrame:
    """Rows that complete ``at_least`` probes of one class by one source within ``seconds``."""
    window = (Window.partitionBy("remote_addr", "path_class", "_slice").orderBy("_us")
              .rangeBetween(-seconds * 1_000_000, 0))
    probes = clean.select("ord", "remote_addr", "path_class", "ts")
    return (sliced(probes, seconds, F.col("path_class") != "unknown").withColumn("probes", F.count(F.lit(1)).over(window))
            .where((F.col("_slice") == F.col("_own")) & (F.col("probes") >= at_least))
            .select("ord", "remote_addr", "path_class", "probes"))


def sequence_probe(clean: DataFrame, seconds: int = 60, steps: tuple[str, ...] = ("health", "env", "info")) -> DataFrame:
    """Requests that complete an ordered sequence of path parts by one source within ``seconds``.

    Other requests may lie between the steps.  For each step, a request that holds it carries the latest start of a
    sequence up to the step before; all steps share one order, so they cost one shuffle and one sort.
    """
    order = Window.partitionBy("remote_addr", "_slice").orderBy("_us", "ord")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = sliced(clean.select("ord", "remote_addr", "path", "ts"), seconds)
    rows = rows.withColumn("_start", F.when(F.col("path").contains(steps[0]), F.col("_us")))
    for step in steps[1:]:
        rows = rows.withColumn("_earlier", F.max("_start").over(before)).withColumn(
            "_start", F.when(F.col("path").contains(step), F.col("_earlier"))).drop("_earlier")
    return (rows.where((F.col("_slice") == F.col("_own")) & (F.col("_us") - F.col("_start") <= seconds * 1_000_000))
            .select("ord", "remote_addr", F.col("path").alias("last_path")))


def brute_force(clean: DataFrame, minutes: int = 5, above: int = 5,
                auth: str = r"(?i)(login|signin|auth|session|xmlrpc)") -> DataFrame:
    slots = clean.where(F.col("path").rlike(auth)).groupBy(
        F.window("ts", f"{minutes} minutes").alias("w"), "remote_addr").agg(
        F.sum("count").alias("requests"))
    return slots.where(F.col("requests") > above).select(
        F.date_format("w.start", "yyyy-MM-dd'T'HH:mm:ss").alias("slot"), "remote_addr", "requests")


def hourly(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(F.date_trunc("hour", "ts").alias("hour"), *keys).agg(
        F.sum("count").alias("hits"))


def trailing(partition: list[str], hours: int = 24):
    return Window.partitionBy(*partition).orderBy("hour").rowsBetween(-hours, -1)


def _anomaly(series: DataFrame, keys: list[str], factor: float, floor: int) -> DataFrame:
    """Hours far above the trailing mean; a series has one row per hour, which bounds the window."""
    past = trailing(keys)
    scored = series.withColumns({"mean": F.avg("hits").over(past), "sd": F.stddev_pop("hits").over(past),
                                 "seen": F.count("hits").over(past)})
    far = (F.col("seen") >= 3) & (F.col("hits") >= floor) & (
        F.col("hits") > F.col("mean") + factor * F.col("sd"))
    return scored.where(far).select(
        F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss").alias("hour"), *keys, "hits",
        F.round("mean", 4).alias("mean"))


def status_anomaly(clean: DataFrame, factor: float = 3.0) -> DataFrame:
    return _anomaly(hourly(clean, "status_bucket"), ["status_bucket"], factor, 1)


def rate_anomaly(clean: DataFrame, factor: float = 3.0) -> DataFrame:
    """Per address and per /24 network against their own past."""
    net = F.when(F.col("remote_addr").rlike(r"^\d+\.\d+\.\d+\.\d+$"),
                 F.concat(F.substring_index("remote_addr", ".", 3), F.lit(".0/24")))
    both = clean.select("ts", "count", F.explode(F.array_compact(F.array("remote_addr", net))).alias("source"))
    return _anomaly(hourly(both, "source"), ["source"], factor, 10)


def method_anomaly(clean: DataFrame, options_above: int = 3) -> DataFrame:
    odd = clean.where(F.col("method_class").isin("TRACE", "CONNECT", "INVALID", "OPTIONS"))
    counts = odd.groupBy(F.date_trunc("hour", "ts").alias("hour"), "remote_addr", "method_class").agg(
        F.sum("count").alias("hits"))
    return (counts.where((F.col("method_class") != "OPTIONS") | (F.col("hits") > options_above))
            .withColumn("hour", F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss")))


def uncovered_patterns(clean: DataFrame, rules: DataFrame, to_classes: Column) -> DataFrame:
    """Attack classes in traffic that no rule category covers."""
    covered = rules.select(F.explode(to_classes).alias("path_class")).distinct()
    return (hits_by_label(clean, "path_class").where("path_class <> 'unknown'")
            .join(covered, "path_class", "left_anti"))


def upstream_correlation(gateway: DataFrame, upstream: DataFrame, seconds: int = 300) -> DataFrame:
    """Gateway errors (502/503) within ``seconds`` of an upstream's errors, per slot and upstream.

    Both sides are counted per second first, so busy moments do not multiply; a second meets those of
    its own and the two neighbouring slots by equality, and only pairs within reach count.
    """
    second = F.floor(F.unix_micros("ts") / 1_000_000)
    slot = F.floor(F.col("at") / seconds)
    errors = gateway.groupBy(second.alias("at")).agg(F.sum("count").alias("g")).withColumn("slot", slot)
    causes = (upstream.groupBy(second.alias("at"), "upstream").agg(F.count(F.lit(1)).alias("u"))
              .withColumn("_slot", slot))
    near = errors.join(
        causes.select(F.col("at").alias("_at"), "upstream", "u",
                      F.explode(F.array(F.col("_slot") - 1, F.col("_slot"), F.col("_slot") + 1)).alias("slot")), "slot"
    ).where(F.abs(F.col("at") - F.col("_at")) <= seconds)
    per_second = near.groupBy("slot", "upstream", "at").agg(F.first("g").alias("g"), F.sum("u").alias("pairs"))
    return per_second.groupBy("slot", "upstream").agg(
        F.sum("g").alias("gateway_errors"), F.sum(F.col("pairs") * F.col("g")).alias("near_pairs"))


def rule_classes_of(category: Column) -> Column:
    from palisade.functions import catalog as C
    known = F.create_map(*[x for k, v in C.RULE_CATEGORY_TO_CLASSES.items()
                           for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    return F.coalesce(F.element_at(known, category), F.array(category))


def scanners_not_blocked(clean: DataFrame, blocked: DataFrame) -> DataFrame:
    """Scanner families in traffic that are not on the block list."""
    return (hits_by_label(clean, "scanner_family").where("scanner_family IS NOT NULL")
            .join(blocked, "scanner_family", "left_anti"))


def hashed(df: DataFrame, salt: str, column: str = "remote_addr") -> DataFrame:
    """Detector output as presented: the address is replaced by its salted hash."""
    return df.withColumn(column, S.hash_ip(F.col(column), salt))
