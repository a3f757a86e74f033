"""Threat-feed documents and lists to one indicator schema.

``parse_*`` take a DataFrame with raw text in ``value``; ``read_*`` land files into that shape.  One
JSON response is one row, so every document is parsed and exploded where it was read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.functions import catalog as C
from palisade.functions import sanitize as S

KEV = ("vulnerabilities array<struct<cveID:string,vendorProject:string,product:string,"
       "knownRansomwareCampaignUse:string,dateAdded:string,vulnerabilityName:string>>")
URLS = "urls array<struct<url:string,url_status:string,date_added:string,threat:string,tags:array<string>>>"
IOCS = ("query_status string, data array<struct<ioc_value:string,ioc_type:string,malware:string,"
        "threat_type:string,confidence_level:string,first_seen_utc:string>>")
CVES = ("vulnerabilities array<struct<cve:struct<id:string,descriptions:array<struct<lang:string,value:string>>,"
        "metrics:struct<cvssMetricV40:{m},cvssMetricV31:{m},cvssMetricV30:{m},cvssMetricV2:{m}>>>>"
        ).format(m="array<struct<cvssData:struct<baseScore:double>>>")
STIX = "objects array<struct<type:string,id:string,pattern_type:string,pattern:string>>"


def _text(value: Column) -> Column:
    return S.sanitize_indicator(F.coalesce(value, F.lit("")))


def _slug(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), " ", "_")


def _tags(*tags: Column) -> Column:
    return F.filter(F.array(*tags), lambda t: t.isNotNull() & (t != ""))


def _indicator(kind, value, confidence, source, severity, tags, first_seen, *more: Column):
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [lit(kind).alias("type"), value.alias("value"), lit(confidence).cast("double").alias("confidence"),
            lit(source).alias("source"), lit(severity).alias("severity"), tags.alias("tags"),
            lit(first_seen).alias("first_seen"), *more]


def _entries(docs: DataFrame, schema: str, field: str, cap: int | None, where: str = "true") -> DataFrame:
    """Array entries of every document; a cap, when asked for, cuts before validity is checked."""
    parsed = docs.select(F.from_json("value", schema).alias("d")).select("d.*").where(where)
    entries = F.col(field) if cap is None else F.slice(field, 1, cap)
    return parsed.select(F.explode(entries).alias("e")).select("e.*")


def rejected(docs: DataFrame, schema: str) -> DataFrame:
    """How many documents of a JSON feed do not parse; the parsers pass over them."""
    return docs.select(F.from_json("value", f"{schema}, _corrupt_record string",
                                   {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("d")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("d").isNull() | F.col("d._corrupt_record").isNotNull()).alias("rejected"))


def parse_kev(docs: DataFrame, cap: int | None = None) -> DataFrame:
    e = _entries(docs, KEV, "vulnerabilities", cap).withColumn("value", _text(F.col("cveID")))
    tags = _tags(F.lit("known_exploited"), _slug(_text(F.col("vendorProject"))),
                 _slug(_text(F.col("product"))),
                 F.when(F.col("knownRansomwareCampaignUse") == "Known", F.lit("ransomware")))
    return e.where("value <> ''").select(*_indicator(
        "cve", F.col("value"), 1.0, "cisa_kev", "critical", tags, _text(F.col("dateAdded")),
        _text(F.col("vulnerabilityName")).alias("description")))


def parse_malware_urls(docs: DataFrame, cap: int | None = None) -> DataFrame:
    e = _entries(docs, URLS, "urls", cap).withColumn("value", _text(F.col("url")))
    tags = F.concat(S.sanitize_tags(F.col("tags")), _tags(_text(F.col("threat"))))
    confidence = F.when(F.col("url_status") == "online", 0.9).otherwise(0.6)
    return e.where("value <> ''").select(*_indicator(
        "url", F.col("value"), confidence, "urlhaus", "high", tags, _text(F.col("date_added"))))


def parse_ioc_mixed(docs: DataFrame, cap: int | None = None) -> DataFrame:
    e = _entries(docs, IOCS, "data", cap, "query_status = 'ok'").withColumn(
        "value", _text(F.col("ioc_value")))
    level = F.coalesce(F.col("confidence_level").try_cast("double").try_cast("int"), F.lit(50))
    confidence = F.least(F.greatest(level / 100, F.lit(0.0)), F.lit(1.0))
    tags = _tags(_slug(_text(F.col("malware"))), _text(F.col("threat_type")))
    return e.where("value <> ''").select(*_indicator(
        S.lookup(F.col("ioc_type"), C.IOC_TYPES, "unknown"), F.col("value"), confidence,
        "threatfox", "high", tags, _text(F.col("first_seen_utc"))))


def _lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("value", F.trim("value"))


def _const_tags(*tags: str) -> Column:
    return F.array(*[F.lit(t) for t in tags])


def parse_url_list(lines: DataFrame) -> DataFrame:
    urls = _lines(lines).withColumn("value", _text(F.col("value")))
    return urls.where(F.col("value").startswith("http")).select(*_indicator(
        "url", F.col("value"), 0.85, "openphish", "high", _const_tags("phishing"), ""))


def parse_ip_list(lines: DataFrame) -> DataFrame:
    return _lines(lines).where(F.col("value").rlike(C.IPV4)).select(*_indicator(
        "ip", F.col("value"), 0.8, "blocklist_de", "medium",
        _const_tags("attacking_ip", "blocklist"), ""))


def parse_c2_list(lines: DataFrame) -> DataFrame:
    kept = _lines(lines).where(~F.col("value").startswith("#"))
    first = kept.withColumn("value", F.split("value", r"\s+")[0])
    return first.where(F.col("value").rlike(C.IPV4)).select(*_indicator(
        "ip", F.col("value"), 0.95, "feodo_tracker", "critical",
        _const_tags("botnet", "c2", "feodo"), ""))


def parse_custom(lines: DataFrame, feeds: DataFrame) -> DataFrame:
    """Lines tagged with their feed id; ``feeds`` is the operator's own short list of feeds."""
    kept = _lines(lines).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return kept.join(feeds, "feed").select(*_indicator(
        F.coalesce("indicator_type", F.lit("unknown")), _text(F.col("value")), 0.7, F.col("feed"),
        "medium", S.sanitize_tags(F.col("tags")), ""))


def cvss_severity(score: Column) -> Column:
    return (F.when(score >= 9, F.lit("critical")).when(score >= 7, F.lit("high"))
            .when(score >= 4, F.lit("medium")).when(score.isNotNull(), F.lit("low")))


def parse_cve_catalog(docs: DataFrame) -> DataFrame:
    """Severity from the newest score that a record has; without a score it is not known."""
    e = _entries(docs, CVES, "vulnerabilities", None).select("cve.*")
    score = F.coalesce(*[F.get(f"metrics.cvssMetric{v}", F.lit(0))["cvssData"]["baseScore"]
                         for v in ("V40", "V31", "V30", "V2")])
    text = F.get(F.filter("descriptions", lambda x: x["lang"] == "en"), F.lit(0))["value"]
    return e.select(F.col("id").alias("value"), score.alias("cvss"),
                    cvss_severity(score).alias("severity"), _text(text).alias("description"))


def parse_stix(docs: DataFrame) -> DataFrame:
    """Every quoted comparison in a STIX pattern, typed by the object it compares."""
    e = _entries(docs, STIX, "objects", None).where("type = 'indicator' AND pattern_type = 'stix'")
    terms = F.regexp_extract_all("pattern", F.lit(r"([A-Za-z0-9_.:-]+ *= *'[^']*')"), F.lit(1))
    one = e.select(F.col("id"), F.explode(terms).alias("term"))
    left = F.regexp_extract("term", r"^([A-Za-z0-9_.:-]+)", 1)
    kind = (F.when(left.startswith("url:"), F.lit("url"))
            .when(left.startswith("ipv4-addr:"), F.lit("ip"))
            .when(left.startswith("domain-name:"), F.lit("domain"))
            .when(left.contains("User-Agent"), F.lit("ua")).otherwise(F.lit("unknown")))
    return one.select("id", kind.alias("type"),
                      _text(F.regexp_extract("term", "'([^']*)'", 1)).alias("value"))


def parse_indicator_list(lines: DataFrame) -> DataFrame:
    """Untyped list; addresses are informational only, servers block those elsewhere."""
    kept = _lines(lines).where("value <> ''")
    v = F.col("value")
    kind = (F.when(v.startswith("/"), F.lit("path"))
            .when(F.lower(v).contains("user-agent:"), F.lit("ua"))
            .when(v.rlike(C.IPV4), F.lit("ip")).otherwise(F.lit("unknown")))
    bare = F.when(kind == "ua", F.trim(F.regexp_replace(v, "(?i)^.*user-agent:", ""))).otherwise(v)
    return kept.select(kind.alias("type"), _text(bare).alias("value"),
                       (kind == "ip").alias("informational"))


def indicator_union(*feeds: DataFrame) -> DataFrame:
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


def per_feed_cap(entries: DataFrame, feed: str, order: str, cap: int = C.FEED_CAP) -> DataFrame:
    """First ``cap`` raw entries of each feed; off unless asked for.

    The rank filter is pushed below the shuffle (window group limit), so a task sends at most
    ``cap`` rows per feed.
    """
    rank = F.row_number().over(Window.partitionBy(feed).orderBy(order))
    return entries.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


JSON_FEEDS = {"cisa_kev": parse_kev, "urlhaus": parse_malware_urls, "threatfox": parse_ioc_mixed}
LIST_FEEDS = {"openphish": parse_url_list, "blocklist_de": parse_ip_list,
              "feodo_tracker": parse_c2_list}


def read_feed(spark: SparkSession, feed: str, path: str, cap: int | None = None) -> DataFrame:
    if feed in JSON_FEEDS:
        return JSON_FEEDS[feed](read_documents(spark, path), cap)
    return LIST_FEEDS[feed](read_lines(spark, path))


def feed_rollup(results: DataFrame) -> DataFrame:
    """Poll results (feed, status, indicators_count, rejected) to counts per feed and in total.

    ``rejected`` counts the documents of a poll that did not parse; a table without it has none.
    """
    ok = F.col("status") == "success"
    if "rejected" not in results.columns:
        results = results.withColumn("rejected", F.lit(0).cast("bigint"))
    return results.rollup("feed").agg(
        F.sum("rejected").alias("rejected"),
        F.count_if(ok).alias("polled"), F.count_if(~ok).alias("skipped"),
        F.coalesce(F.sum(F.when(ok, F.col("indicators_count"))), F.lit(0)).alias("indicators")
    ).withColumn("feed", F.coalesce("feed", F.lit("(total)")))
