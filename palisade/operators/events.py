"""Access rows to sanitised, numbered events, and the summaries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import catalog as C
from palisade.functions import sanitize as S
from palisade.operators.numbering import number_rows
from palisade.session import materialize
from palisade.sinks.batches import names
from palisade.sources.access_log import l1_rows, parse_access_log

KEY4 = ["path_class", "user_agent_family", "method_class", "status_bucket"]
KEY5 = KEY4 + ["remote_addr"]


def l1_group(rows: DataFrame) -> DataFrame:
    """Identical (method, path, status, agent) rows to one; `top_groups` orders them."""
    return (
        rows.groupBy("method", "hex_path", "status", "hex_user_agent")
        .agg(F.sum("count").alias("count"), F.min("timestamp").alias("timestamp"),
             F.min_by("remote_addr", "ord").alias("remote_addr"), F.min("ord").alias("ord"))
    )


#: Most bytes of distinct raw values that go out as a dictionary; beyond it every row is cleaned where it is.
DICTIONARY_BYTES = 32_000_000


def _cleaned(values: DataFrame, *fields: str) -> DataFrame:
    """Raw hex columns ``_hex_<field>`` to cleaned text, and the labels of the text."""
    decoded = values.withColumns({f: S.hex_decode(F.col(f"_hex_{f}")) for f in fields})
    # Each stage is its own projection: later ones read a column, not a copy of its expression.
    searched = decoded.withColumns({f"_{f}": F.lower(f) for f in fields})
    stripped = searched.withColumns({
        f: S.strip_injection(F.col(f), S.may_hold_injection(f"_{f}")) for f in fields})
    safe = stripped.withColumns({f: S.truncate(S.drop_unsafe(S.strip_templates(F.col(f)))) for f in fields})
    out = safe.withColumns({f"_{f}": F.lower(f) for f in fields})
    if "path" in fields:
        out = out.withColumn("path_class", S.classify_path("_path"))
    if "ua" in fields:
        out = out.withColumn("scanner_family", S.scanner_family("_ua")).withColumn(
            "user_agent_family", S.ua_family(F.col("ua"), F.col("scanner_family")))
    return out.drop(*[f"_{f}" for f in fields])


def _dictionaries(rows: DataFrame, folder: str | None) -> tuple[DataFrame, DataFrame] | None:
    """Distinct raw paths and agents with all that is made of them; None where they are too many to broadcast.

    A ``folder`` keeps them between runs: then only values that it lacks are cleaned.
    """
    spark = rows.sparkSession
    seen = materialize(rows.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"_hex_{f}").alias("hex")) for f in ("path", "ua")])).alias("v")).select("v.*").distinct())
    size = seen.agg(F.coalesce(F.sum(F.octet_length("hex") + 64), F.lit(0))).first()[0]
    if size > DICTIONARY_BYTES:
        return None

    def of(field: str) -> DataFrame:
        values = seen.where(F.col("field") == field).select(F.col("hex").alias(f"_hex_{field}"))
        if folder is None:
            return _cleaned(values, field)
        known = f"{folder}/{field}"
        fresh = values
        if names(spark, known):
            fresh = values.join(spark.read.parquet(known).select(f"_hex_{field}"), f"_hex_{field}", "left_anti")
        _cleaned(fresh, field).write.mode("append").parquet(known)
        # A value may be stored twice, by two jobs at once.
        return spark.read.parquet(known).join(values, f"_hex_{field}", "left_semi").dropDuplicates([f"_hex_{field}"])

    # Written, so that a filter on a label is a filter on a table and not on all the expressions that make it.
    made = materialize(of("path").unionByName(of("ua"), allowMissingColumns=True))
    return (made.where("_hex_path IS NOT NULL").select("_hex_path", "path", "path_class"),
            made.where("_hex_ua IS NOT NULL").select("_hex_ua", "ua", "scanner_family", "user_agent_family"))


def sanitize_events(rows: DataFrame, dictionary: str | None = None) -> DataFrame:
    """Typed columns from raw ones; rows are not moved.

    Distinct raw paths and agents are few next to rows.  They are cleaned and classified once and rows meet them by
    value, by broadcast up to a checked size.  Beyond it, and in streams, each row is cleaned in the scan stage; the
    result is the same.  ``dictionary`` is a folder that keeps the cleaned values between runs.
    """
    raw = rows.select(
        "ord", F.trim("remote_addr").alias("remote_addr"), F.trim("timestamp").alias("timestamp"),
        *([F.col("ts")] if "ts" in rows.columns else []),
        S.validate_method(F.col("method")).alias("method_class"),
        S.status_bucket(F.col("status")).alias("status_bucket"), F.col("count"),
        F.coalesce(F.trim("hex_path"), F.lit("")).alias("_hex_path"),
        F.coalesce(F.trim("hex_user_agent"), F.lit("")).alias("_hex_ua"))
    found = None if rows.isStreaming else _dictionaries(raw, dictionary)
    if found is None:
        labelled = _cleaned(raw, "path", "ua")
    else:
        labelled = raw.join(F.broadcast(found[0]), "_hex_path", "left").join(F.broadcast(found[1]), "_hex_ua", "left")
    return labelled.withColumn("remote_addr_class", S.classify_ip(F.col("remote_addr"))).select(
        *[c for c in raw.columns if not c.startswith("_")], "path", "ua", "path_class", "scanner_family",
        "user_agent_family", "remote_addr_class")


def dedup_events(clean: DataFrame) -> DataFrame:
    """One event per (class, agent, method, status, address), first row by ``ord`` kept.

    Counts of repeats go to the first event that shares all but the address.  Rows shrink to one
    per key by partial aggregation and are checkpointed: they are read twice here and again by
    numbering, and the checkpoint spares each reader the scan and the cleaning.  Repeat totals have
    one row per combination of closed label sets (33 x 33 x 10 x 5 at most), which bounds the
    broadcast.
    """
    first = F.min_by(F.struct("timestamp", "path", "count", "scanner_family", "remote_addr_class"),
                     "ord").alias("first")
    groups = materialize(
        clean.groupBy(*KEY5).agg(first, F.min("ord").alias("ord"), F.sum("count").alias("total"))
        .select(*KEY5, "ord", "total", "first.*"))
    repeats = groups.groupBy(*KEY4).agg(F.sum(F.col("total") - F.col("count")).alias("repeats"),
                                        F.min("ord").alias("leader"))
    merged = groups.join(F.broadcast(repeats), KEY4)
    own = F.col("count")
    return merged.select(
        "ord", "timestamp",
        S.timestamp_bucket(F.col("timestamp")).alias("timestamp_bucket"),
        "remote_addr", "remote_addr_class", *KEY4, "scanner_family",
        S.rate_signal(own).alias("rate_signal"),
        S.match_type(F.col("path_class")).alias("indicator_match_type"),
        S.mitigation_type(F.col("path_class")).alias("candidate_mitigation_type"),
        S.confidence(F.col("path_class"), F.col("scanner_family")).alias("confidence"),
        F.lit(C.PROVENANCE).alias("provenance"),
        S.ttl(F.col("path_class")).alias("ttl_recommendation"),
        S.safe_note(F.col("path_class"), F.col("path"), own).alias("safe_notes"),
        (own + F.when(F.col("ord") == F.col("leader"), F.col("repeats")).otherwise(0)).alias("count"),
    )


def event_numbering(events: DataFrame, buckets: int | None = None) -> DataFrame:
    """``evt-YYYYMMDD-NNNN`` with one counter over all events in first-seen order.

    Reads its input three times (bounds, counts, rows): give it checkpointed events, such as
    those of ``dedup_events``.
    """
    numbered = number_rows(events, "ord", into="_n", buckets=buckets)
    number = F.col("_n").cast("string")
    padded = F.lpad(number, F.greatest(F.length(number), F.lit(4)), F.lit("0"))
    return numbered.withColumn("event_id", F.concat(
        F.lit("evt-"), S.event_date(F.col("timestamp")), F.lit("-"), padded)).drop("_n")


def published_events(events: DataFrame, source_type: str = "access_log",
                     log_source: str = "/var/log/nginx/access.log") -> DataFrame:
    """The published contract: no raw address, no raw text."""
    return events.select(
        "event_id", F.lit(source_type).alias("source_type"),
        F.lit(log_source).alias("log_source_path"), "timestamp_bucket", "remote_addr_class",
        "method_class", "path_class", "status_bucket", "user_agent_family", "rate_signal",
        "scanner_family", "indicator_match_type", "candidate_mitigation_type", "confidence",
        "provenance", "ttl_recommendation", "safe_notes", "count")


def analyze_logs(lines: DataFrame) -> DataFrame:
    """Log lines (value, ord) to published, numbered events, each with the contract's verdict."""
    groups = l1_group(l1_rows(parse_access_log(lines)))
    events = event_numbering(dedup_events(sanitize_events(groups)))
    return event_contract(published_events(events))


def graded(clean: DataFrame) -> DataFrame:
    """Hits per closed labels under every profile (six at most), with the profile's severity.

    Rows shrink to combinations of labels before they are repeated per profile.
    """
    c = F.col
    base = (F.when(c("path_class") == "unknown", F.lit("low")).when(c("scanner_family").isNotNull(), F.lit("high"))
            .otherwise(F.lit("medium")))
    labels = ["path_class", "scanner_family", "user_agent_family", "remote_addr_class", "method_class"]
    small = clean.groupBy(*labels).agg(F.count(F.lit(1)).alias("events"), F.sum("count").alias("hits"),
                                       F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    each = small.withColumn("profile", F.explode(F.array(*[F.lit(p) for p in C.PROFILES])))
    severity = S.profile_severity(c("profile"), base, c("user_agent_family"), c("remote_addr_class"), c("method_class"),
                                  c("path_class"))
    return each.withColumn("severity", severity).where("severity IS NOT NULL")


def log_findings(clean: DataFrame, covered: DataFrame) -> DataFrame:
    """Findings of a run per profile and pattern; ``covered`` lists path classes that a rule blocks.

    A single hit is a finding under lockdown only.  A pattern without a rule gets one proposed.
    """
    worst = F.min(S.ordinal(F.col("severity"), C.SEVERITY_ORDER))
    found = graded(clean).where("path_class <> 'unknown'").groupBy("profile", "path_class").agg(
        F.sum("hits").alias("hit_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        S.label_of(worst, C.SEVERITY_ORDER).alias("severity"))
    known = covered.select("path_class").distinct().withColumn("_covered", F.lit(True))
    return (found.where((F.col("hit_count") > 1) | (F.col("profile") == "high-risk-lockdown"))
            .join(known, "path_class", "left")
            .select("profile", F.col("path_class").alias("pattern"), "hit_count", "first_seen", "last_seen", "severity",
                    F.when(F.col("_covered").isNull(), S.mitigation_type(F.col("path_class"))).alias("proposed_rule")))


def hits_by_label(clean: DataFrame, label: str) -> DataFrame:
    """Hits per value of a label column, ready to be joined.

    The label comes out as an aggregate of itself (a second pass over a handful of rows, without
    a shuffle).  Join planning would otherwise trace a join key back through the whole
    classification and inline it many times over.
    """
    counts = clean.groupBy(label).agg(F.sum("count").alias("hits"))
    return (counts.groupBy(label).agg(F.first(label).alias("_label"), F.sum("hits").alias("hits"))
            .select(F.col("_label").alias(label), "hits"))


def hits_by_class(clean: DataFrame) -> DataFrame:
    return hits_by_label(clean, "path_class")


#: What is counted distinct, and the name of the count.
DISTINCT = {"remote_addr": "unique_ips", "path": "unique_paths", "ua": "unique_user_agents"}


def traffic_summary(clean: DataFrame, approximate: bool = False) -> DataFrame:
    """Totals and distinct counts; the approximate ones are within about one percent.

    Rows are first summed per address, path and agent, so what multiplies rows by the number of distinct counts
    works on groups.
    """
    if approximate:
        return summary_of(daily_sketches(clean))
    groups = clean.groupBy(*DISTINCT).agg(
        F.count(F.lit(1)).alias("n"), F.sum("count").alias("count"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sum("count").alias("total_events"),
                      *[F.count_distinct(c).alias(a) for c, a in DISTINCT.items()],
                      F.min("first").alias("first_seen"), F.max("last").alias("last_seen"))


def daily_sketches(clean: DataFrame, lg_k: int = 14) -> DataFrame:
    """Sums of each day with a sketch per distinct count (at most 16 kB each at ``lg_k`` 14), for ``summary_of``.

    A day's rows may come in any number of parts, each sketched by itself.  Rows without a time are of day `unknown`.
    """
    day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("unknown")).alias("dt")
    return clean.groupBy(day).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("count").alias("total_events"), F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"), *[F.hll_sketch_agg(c, lg_k).alias(a) for c, a in DISTINCT.items()])


def summary_of(sketches: DataFrame, *by: str) -> DataFrame:
    """The summary over any rows of ``daily_sketches``, per ``by`` where given, without reading the events again."""
    return sketches.groupBy(*by).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("total_events").alias("total_events"),
        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(a)), F.lit(0)).alias(a) for a in DISTINCT.values()],
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def class_scanner_cube(clean: DataFrame) -> DataFrame:
    """Hits with subtotals; the cube is made of sums per combination, not of rows."""
    dims = ["path_class", "scanner", "status_bucket"]
    sums = clean.withColumn("scanner", F.coalesce("scanner_family", F.lit("none"))).groupBy(*dims).agg(F.sum("count").alias("hits"))
    return (sums.cube(*dims).agg(F.sum("hits").alias("hits"),
                                 F.grouping_id(*dims).cast("bigint").alias("level"))
            .select(*[F.coalesce(d, F.lit("(all)")).alias(d) for d in dims], "level", "hits"))


def status_distribution(clean: DataFrame, by: str = "path_class") -> DataFrame:
    """Share of each status bucket per class, or per another column such as the source.

    Totals are sums of sums and meet their parts by value, so a busy source is a few rows.
    """
    counts = clean.groupBy(by, "status_bucket").agg(F.sum("count").alias("hits"))
    total = F.sum("hits").over(Window.partitionBy(by))
    return counts.withColumn("share", F.round(F.col("hits") / total, 6))


def top_groups(rows: DataFrame, k: int = 20) -> DataFrame:
    grouped = rows.groupBy("method", "hex_path", "status", "hex_user_agent").agg(
        F.sum("count").alias("count"))
    return grouped.orderBy(F.desc("count"), "method", "hex_path", "status",
                           "hex_user_agent").limit(k)


def lookback(rows: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Rows of the last hours; on a table partitioned by ``dt`` the day bound prunes partitions."""
    end = F.lit(as_of).cast("timestamp")
    kept = rows.where((F.col("ts") > end - F.make_interval(hours=F.lit(hours)))
                      & (F.col("ts") <= end))
    if "dt" in rows.columns:
        kept = kept.where(F.col("dt") >= F.to_date(end - F.make_interval(hours=F.lit(hours))))
    return kept


def event_contract(events: DataFrame) -> DataFrame:
    """An ``errors`` array per event; empty means accepted.

    Repeated ids are found by counting ids (partial aggregation) and joined back only when they
    repeat, so clean tables add no wide join output.
    """
    required = ["event_id", "source_type", "log_source_path", "timestamp_bucket",
                "remote_addr_class", "method_class", "path_class", "status_bucket",
                "user_agent_family", "rate_signal", "confidence", "provenance", "safe_notes",
                "count"]
    errors = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in required]
    errors += [F.when(~F.col(c).isin(*allowed), F.lit(f"enum:{c}"))
               for c, allowed in C.EVENT_ENUMS.items()]
    errors += [
        F.when(~F.col("confidence").between(0.0, 1.0), F.lit("range:confidence")),
        F.when(F.col("count") < 1, F.lit("range:count")),
        F.when(F.length("safe_notes") > 200, F.lit("length:safe_notes")),
        F.when(~F.col("timestamp_bucket").rlike(r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):00Z$"),
               F.lit("format:timestamp_bucket")),
    ]
    errors += [F.when(F.col(c).isNotNull(), F.lit(f"forbidden:{c}"))
               for c in C.FORBIDDEN_EVENT_FIELDS if c in events.columns]
    repeated = (events.groupBy("event_id").agg(F.count(F.lit(1)).alias("_n"))
                .where("_n > 1").select("event_id", F.lit("duplicate:event_id").alias("_dup")))
    checked = events.join(repeated, "event_id", "left")
    return (checked.withColumn("errors", F.array_compact(F.array(*errors, F.col("_dup"))))
            .withColumn("accepted", F.size("errors") == 0).drop("_dup"))
