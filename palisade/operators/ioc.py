"""Indicators against traffic and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import catalog as C
from palisade.functions import sanitize as S
from palisade.operators.matching import contains_join, prefix_join, regex_join
from palisade.session import materialize


def indicator_consolidate(indicators: DataFrame) -> DataFrame:
    """One row per (type, value): best confidence, worst severity, all tags and sources."""
    worst = F.min(S.ordinal(F.col("severity"), C.SEVERITY_ORDER, len(C.SEVERITY_ORDER)))
    return (indicators.groupBy("type", "value").agg(
        F.max("confidence").alias("confidence"),
        S.label_of(worst, C.SEVERITY_ORDER).alias("severity"),
        F.array_sort(F.collect_set("tag")).alias("tags"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min("first_seen").alias("first_seen")).withColumn("source_count", F.size("sources").cast("bigint")))


def confidence_gate(indicators: DataFrame, floor: float = 0.5) -> DataFrame:
    return indicators.where(F.col("confidence") >= floor)


def address_part(value: Column) -> Column:
    """``ip:port`` without its port; a bare address, v6 included, stays as it is."""
    return F.when(value.rlike(r"^[0-9.]+:\d+$"), F.substring_index(value, ":", 1)).otherwise(value)


def _sightings(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("count").alias("count"), F.min("timestamp").alias("first_hit"),
                                   F.max("timestamp").alias("last_hit"))


def _totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy("type", "value").agg(
        F.sum("count").alias("match_count"), F.min("first_hit").alias("first_seen"),
        F.max("last_hit").alias("last_seen"))


def ioc_match_ip(clean: DataFrame, indicators: DataFrame) -> DataFrame:
    """Traffic is summed per address before the join: a hot address is one row in it."""
    ips = (indicators.where("type = 'ip'").select("type", "value").distinct()
           .withColumn("remote_addr", address_part(F.col("value"))))
    return _totals(_sightings(clean, "remote_addr").join(ips, "remote_addr"))


def ioc_match_url(requests: DataFrame, indicators: DataFrame) -> DataFrame:
    """``requests`` hold full urls.  Domain indicators meet hosts, url indicators host and path.

    An indicator with a query string meets requests with that query only; one without meets any.
    """
    def parts(col: str):
        return {"host": F.lower(F.try_parse_url(F.col(col), F.lit("HOST"))),
                "path": F.coalesce(F.try_parse_url(F.col(col), F.lit("PATH")), F.lit("")),
                "query": F.coalesce(F.try_parse_url(F.col(col), F.lit("QUERY")), F.lit(""))}

    known = requests.withColumns(parts("url")).where("host IS NOT NULL")
    seen = _sightings(known, "host", "path", "query")
    by_host = seen.groupBy("host").agg(F.sum("count").alias("count"), F.min("first_hit").alias("first_hit"),
                                       F.max("last_hit").alias("last_hit"))
    wanted = indicators.select("type", "value").distinct()
    domains = wanted.where("type = 'domain'").withColumn("host", F.lower("value"))
    urls = wanted.where("type = 'url'").withColumns(parts("value")).where("host IS NOT NULL").withColumnRenamed("query", "_query")
    return _totals(by_host.join(domains, "host").select("type", "value", "count", "first_hit", "last_hit")
                   .unionByName(seen.join(urls, ["host", "path"]).where("_query = '' OR _query = query")
                                .select("type", "value", "count", "first_hit", "last_hit")))


def ioc_match_pattern(clean: DataFrame, indicators: DataFrame) -> DataFrame:
    """Path indicators as prefixes of paths, agent indicators as parts of agents.

    Only distinct values are matched; hits go back to counts by equality.  Traffic is cleaned once, summed per
    pair of path and agent and checkpointed, because every step reads it.
    """
    pairs = materialize(_sightings(clean, "path", "ua"))
    wanted = (indicators.where("type IN ('path', 'ua')").select("type", "value").distinct()
              .withColumn("needle", S.clean_text(F.col("value"))).where("needle <> ''"))

    def match(kind: str, text: str, how) -> DataFrame:
        seen = pairs.groupBy(text).agg(F.sum("count").alias("count"), F.min("first_hit").alias("first_hit"),
                                       F.max("last_hit").alias("last_hit"))
        of_kind = wanted.where(F.col("type") == kind)
        hits = how(seen.select(text), text, of_kind.select("needle").distinct(), "needle")
        return (hits.join(seen, text).groupBy("needle").agg(
            F.sum("count").alias("count"), F.min("first_hit").alias("first_hit"),
            F.max("last_hit").alias("last_hit")).join(of_kind, "needle"))

    return _totals(match("path", "path", prefix_join).unionByName(match("ua", "ua", contains_join)))


def ioc_sightings(clean: DataFrame, requests: DataFrame, indicators: DataFrame, rules: DataFrame) -> DataFrame:
    """Every indicator with its hits over all match kinds and the rule that blocks it; never seen gives zero."""
    found = (ioc_match_ip(clean, indicators).unionByName(ioc_match_url(requests, indicators))
             .unionByName(ioc_match_pattern(clean, indicators)))
    return (indicators.select("type", "value").distinct()
            .join(found, ["type", "value"], "left")
            .join(ioc_coverage(indicators, rules).where("blocked").select(
                F.lit("path").alias("type"), "value", "blocked_by"), ["type", "value"], "left")
            .withColumn("match_count", F.coalesce("match_count", F.lit(0))))


def rule_hits(paths: DataFrame, path: str, rules: DataFrame) -> DataFrame:
    """(path, modifier, pattern) for each location rule that takes a distinct path."""
    wanted = rules.select("modifier", "pattern").distinct()
    exact = wanted.where("modifier = '='")
    plain = wanted.where("modifier IN ('', '^~')")
    regex = wanted.where("modifier IN ('~', '~*')").withColumn("icase", F.col("modifier") == "~*")
    texts = paths.select(path).distinct()
    out = texts.join(exact, F.col(path) == F.col("pattern")).select(path, "modifier", "pattern")
    out = out.unionByName(
        prefix_join(texts, path, plain.select("pattern").distinct(), "pattern")
        .join(plain, "pattern").select(path, "modifier", "pattern"))
    return out.unionByName(
        regex_join(texts, path, regex, "pattern", "icase")
        .select(path, F.when(F.col("icase"), F.lit("~*")).otherwise(F.lit("~")).alias("modifier"), "pattern"))


def ioc_coverage(indicators: DataFrame, rules: DataFrame) -> DataFrame:
    """Path indicators with the number of rules that block them; zero means not blocked."""
    wanted = (indicators.where("type = 'path'").select("value").distinct()
              .withColumn("path", S.clean_text(F.col("value"))))
    blocking = rule_hits(wanted, "path", rules).groupBy("path").agg(
        F.count(F.lit(1)).alias("patterns"), F.min("pattern").alias("blocked_by"))
    return (wanted.join(blocking, "path", "left")
            .select("value", F.coalesce("patterns", F.lit(0)).alias("patterns"), "blocked_by",
                    F.col("patterns").isNotNull().alias("blocked")))


def uncovered_indicators(indicators: DataFrame, rules: DataFrame) -> DataFrame:
    return ioc_coverage(indicators, rules).where("NOT blocked").select("value")


def rule_impact(clean: DataFrame, rules: DataFrame) -> DataFrame:
    """Traffic each proposed rule would have taken.

    Hits are joined to traffic summed per path; sources are counted over distinct (path, address)
    rows, checkpointed because every step reads them, so no path is expanded row by row.
    """
    pairs = materialize(clean.groupBy("path", "remote_addr").agg(
        F.sum("count").alias("hits"),
        F.sum(F.when(F.col("status_bucket") == "2xx", F.col("count")).otherwise(0)).alias("ok")))
    per_path = pairs.groupBy("path").agg(F.sum("hits").alias("hits"), F.sum("ok").alias("ok"))
    hits = rule_hits(per_path.select("path"), "path", rules)
    sources = pairs.select("path", "remote_addr")
    rule = ["modifier", "pattern"]
    counted = hits.join(per_path, "path").groupBy(*rule).agg(
        F.sum("hits").alias("hits"), F.sum("ok").alias("ok"))
    addresses = (hits.join(sources, "path").select(*rule, "remote_addr").distinct()
                 .groupBy(*rule).agg(F.count(F.lit(1)).alias("sources")))
    return (counted.join(addresses, rule)
            .select(*rule, "hits", "sources", F.round(F.col("ok") / F.col("hits"), 6).alias("ok_share")))


def emergency_eligible(findings: DataFrame) -> DataFrame:
    """Refusal reasons per proposed rule; none means it may go out in an emergency.

    A value that is not known is refused, and so is a change of which it is not known whether it passes all
    invariants: a table without ``invariants_pass`` has no eligible row.
    """
    refuse = lambda ok, reason: F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason))  # noqa: E731  unknown is refused
    checks = [(F.col("rule_class") == "A", "class"), (F.col("blast_radius").isin("exact-location", "server-block"), "scope"),
              (F.col("confidence") >= 0.8, "confidence"), (F.col("ttl").isNotNull(), "ttl"),
              (F.col("provenance").isNotNull(), "provenance"),
              (F.col("invariants_pass") if "invariants_pass" in findings.columns else F.lit(False), "invariants")]
    reasons = F.array_compact(F.array(*[refuse(ok, reason) for ok, reason in checks]))
    return findings.withColumn("refusals", reasons).withColumn("eligible", F.size("refusals") == 0)
