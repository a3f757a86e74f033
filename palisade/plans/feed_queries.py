"""Registered queries over sources, threat feeds and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import catalog as C
from palisade.functions import sanitize as S
from palisade.operators import events as E
from palisade.operators import ioc as I
from palisade.plans import oracle as O
from palisade.plans.fixtures import view, with_views
from palisade.plans.log_queries import access, clean
from palisade.session import new_folder, table
from palisade.sources import access_log as A
from palisade.sources import feeds as Fd

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name, run, oracle=None):
    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = oracle


def _flat(df):
    return df.withColumn("tags", F.array_join("tags", ","))


def _safe(v, size=500):
    return f"trim({O.sub(f'substr({v}, 1, {size})', C.DISALLOWED_INDICATOR_CHARS)})"


def _entries(view_name, field, where="true"):
    return (f"(SELECT unnest(CAST(json_extract(value, '$.{field}') AS JSON[])) AS e FROM {view_name} WHERE {where}) x")


def _js(field):
    return f"coalesce(json_extract_string(e, '$.{field}'), '')"


def _slug(v):
    return f"replace(lower({v}), ' ', '_')"


def _join_tags(*tags):
    return "concat_ws(',', " + ", ".join(f"nullif({t}, '')" for t in tags) + ")"


# --- sources -----------------------------------------------------------------------------------

_LOG_RX = A.COMBINED


def _log(i):
    return f"regexp_extract(value, {O.q(_LOG_RX)}, {i})"


add("read_access_log", lambda s, d: A.parse_access_log(view(s, d, "log_lines")).where("parsed").select(
        "ord", "remote_addr", "timestamp", "method", "path", F.col("status").cast("bigint").alias("status"),
        "bytes", "referer", "user_agent"),
    with_views(f"""SELECT ord, {_log(1)} AS remote_addr, strftime(strptime(substr({_log(2)}, 1, 20), '%d/%b/%Y:%H:%M:%S'), '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
      {_log(3)} AS method, {_log(4)} AS path, CAST({_log(5)} AS BIGINT) AS status,
      CASE {_log(6)} WHEN '-' THEN 0 ELSE CAST({_log(6)} AS BIGINT) END AS bytes, {_log(7)} AS referer, {_log(8)} AS user_agent
      FROM log_lines WHERE value NOT LIKE 'garbage%'""", "log_lines"))


def read_access_log_files(spark, d):
    """The lines as plain files in order, read back by the reader."""
    folder = new_folder(spark, "logs")
    (view(spark, d, "log_lines").repartitionByRange(16, "ord").sortWithinPartitions("ord").select("value")
     .write.option("compression", "gzip").text(folder))
    return A.read_access_log(spark, folder).select("ord", "value")


add("read_access_log_files", read_access_log_files,
    with_views("SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, value FROM log_lines", "log_lines"))
add("access_log_rejects", lambda s, d: A.parse_counts(A.parse_access_log(view(s, d, "log_lines"))),
    with_views("""SELECT count(*) AS lines, count(*) FILTER (WHERE value NOT LIKE 'garbage%') AS parsed,
      count(*) FILTER (WHERE value LIKE 'garbage%') AS skipped FROM log_lines""", "log_lines"))

_PARSED_DOCS = """SELECT concat('[{"remote_addr":" 203.0.113.', CAST(user_id AS STRING), '","method":"GET","hex_path":"2f2e656e76"',
  CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(',"status":404,"count":', CAST(event_id % 9 AS STRING)) END, '}]') AS value FROM events"""


def read_parsed_events(spark, d):
    table(spark, d, "events").createOrReplaceTempView("events")
    rows = A.parse_parsed_events(spark.sql(_PARSED_DOCS))
    return rows.groupBy("remote_addr", F.col("status").cast("bigint").alias("status")).agg(
        F.sum("count").alias("count"), F.count(F.lit(1)).alias("rows"))


add("read_parsed_events", read_parsed_events, """SELECT concat('203.0.113.', CAST(user_id AS VARCHAR)) AS remote_addr,
  CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 404 END AS BIGINT) AS status,
  CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 9 END) AS BIGINT) AS count, count(*) AS rows FROM events GROUP BY 1, 2""")

_SANITIZED_DOCS = """SELECT CASE WHEN event_id % 2 = 0 THEN concat('[{"path_class":"', event_type, '","count":', CAST(event_id % 7 AS STRING), '},{"count":2}]')
  ELSE concat('{"schema_version":"1.0","events":[{"path_class":"', event_type, '"}]}') END AS value FROM events"""


def read_sanitized_events(spark, d):
    table(spark, d, "events").createOrReplaceTempView("events")
    return E.hits_by_class(A.parse_sanitized_events(spark.sql(_SANITIZED_DOCS)))


add("read_sanitized_events", read_sanitized_events, """SELECT path_class, CAST(sum(n) AS BIGINT) AS hits FROM (
  SELECT event_type AS path_class, CASE WHEN event_id % 2 = 0 THEN event_id % 7 ELSE 1 END AS n FROM events
  UNION ALL SELECT 'unknown', 2 FROM events WHERE event_id % 2 = 0) x GROUP BY 1""")

# --- feeds -------------------------------------------------------------------------------------

add("read_feed_kev", lambda s, d: _flat(Fd.parse_kev(view(s, d, "kev_docs"))), with_views(f"""
SELECT 'cve' AS type, {_safe(_js('cveID'))} AS value, CAST(1.0 AS DOUBLE) AS confidence, 'cisa_kev' AS source, 'critical' AS severity,
  {_join_tags("'known_exploited'", _slug(_safe(_js('vendorProject'))), _slug(_safe(_js('product'))), f"CASE WHEN {_js('knownRansomwareCampaignUse')} = 'Known' THEN 'ransomware' END")} AS tags,
  {_safe(_js('dateAdded'))} AS first_seen, {_safe(_js('vulnerabilityName'))} AS description
FROM {_entries('kev_docs', 'vulnerabilities')} WHERE {_js('cveID')} <> ''""", "kev_docs"))
add("read_feed_malware_urls", lambda s, d: _flat(Fd.parse_malware_urls(view(s, d, "malware_url_docs"))), with_views(f"""
SELECT 'url' AS type, {_safe(_js('url'))} AS value, CAST(CASE WHEN {_js('url_status')} = 'online' THEN 0.9 ELSE 0.6 END AS DOUBLE) AS confidence,
  'urlhaus' AS source, 'high' AS severity,
  {_join_tags("CASE WHEN json_type(e, '$.tags') = 'ARRAY' THEN 'elf' END", "CASE WHEN json_type(e, '$.tags') = 'ARRAY' THEN 'mozi' END", _js('threat'))} AS tags,
  {_safe(_js('date_added'))} AS first_seen FROM {_entries('malware_url_docs', 'urls')} WHERE {_js('url')} <> ''""", "malware_url_docs"))
add("read_feed_ioc_mixed", lambda s, d: _flat(Fd.parse_ioc_mixed(view(s, d, "ioc_docs"))), with_views(f"""
SELECT {O.lookup(_js('ioc_type'), C.IOC_TYPES, "'unknown'")} AS type, {_safe(_js('ioc_value'))} AS value,
  least(greatest(coalesce(TRY_CAST(json_extract_string(e, '$.confidence_level') AS DOUBLE), 50) / 100, 0.0), 1.0) AS confidence,
  'threatfox' AS source, 'high' AS severity, {_join_tags(_slug(_safe(_js('malware'))), _safe(_js('threat_type')))} AS tags,
  {_safe(_js('first_seen_utc'))} AS first_seen
FROM {_entries('ioc_docs', 'data', "json_extract_string(value, '$.query_status') = 'ok'")} WHERE {_js('ioc_value')} <> ''""", "ioc_docs"))
add("read_feed_url_list", lambda s, d: _flat(Fd.parse_url_list(view(s, d, "url_lines"))), with_views(f"""
SELECT 'url' AS type, {_safe('trim(value)')} AS value, CAST(0.85 AS DOUBLE) AS confidence, 'openphish' AS source, 'high' AS severity,
  'phishing' AS tags, '' AS first_seen FROM url_lines WHERE trim(value) LIKE 'http%'""", "url_lines"))
add("read_feed_ip_list", lambda s, d: _flat(Fd.parse_ip_list(view(s, d, "ip_lines"))), with_views(f"""
SELECT 'ip' AS type, trim(value) AS value, CAST(0.8 AS DOUBLE) AS confidence, 'blocklist_de' AS source, 'medium' AS severity,
  'attacking_ip,blocklist' AS tags, '' AS first_seen FROM ip_lines WHERE {O.hit('trim(value)', C.IPV4)}""", "ip_lines"))
add("read_feed_c2_list", lambda s, d: _flat(Fd.parse_c2_list(view(s, d, "c2_lines"))), with_views(f"""
SELECT 'ip' AS type, split_part(trim(value), ' ', 1) AS value, CAST(0.95 AS DOUBLE) AS confidence, 'feodo_tracker' AS source,
  'critical' AS severity, 'botnet,c2,feodo' AS tags, '' AS first_seen FROM c2_lines WHERE value NOT LIKE '#%'""", "c2_lines"))


def read_feed_custom(spark, d):
    feeds = spark.createDataFrame([("team_feed", "domain", ["team", ""]), ("lab_feed", None, ["lab<1>"])],
                                  "feed string, indicator_type string, tags array<string>")
    return _flat(Fd.parse_custom(view(spark, d, "custom_lines"), feeds))


add("read_feed_custom", read_feed_custom, with_views("""
SELECT CASE feed WHEN 'team_feed' THEN 'domain' ELSE 'unknown' END AS type, replace(value, '<>', '') AS value, CAST(0.7 AS DOUBLE) AS confidence,
  feed AS source, 'medium' AS severity, CASE feed WHEN 'team_feed' THEN 'team' ELSE 'lab1' END AS tags, '' AS first_seen
FROM custom_lines WHERE trim(value) <> '' AND value NOT LIKE '#%'""", "custom_lines"))
add("read_cve_catalog", lambda s, d: Fd.parse_cve_catalog(view(s, d, "cve_docs")), with_views("""
SELECT value, cvss, CASE WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' WHEN cvss IS NOT NULL THEN 'low' END AS severity, description
FROM (SELECT json_extract_string(value, '$.vulnerabilities[0].cve.id') AS value,
  CAST(coalesce(json_extract_string(value, '$.vulnerabilities[0].cve.metrics.cvssMetricV31[0].cvssData.baseScore'),
    json_extract_string(value, '$.vulnerabilities[0].cve.metrics.cvssMetricV2[0].cvssData.baseScore')) AS DOUBLE) AS cvss,
  json_extract_string(value, '$.vulnerabilities[0].cve.descriptions[0].value') AS description FROM cve_docs) x""", "cve_docs"))
add("read_stix_bundle", lambda s, d: Fd.parse_stix(view(s, d, "stix_docs")), with_views(f"""
SELECT id, CASE WHEN term LIKE 'url:%' THEN 'url' WHEN term LIKE 'ipv4-addr:%' THEN 'ip' WHEN term LIKE 'domain-name:%' THEN 'domain'
  WHEN term LIKE '%User-Agent%' THEN 'ua' ELSE 'unknown' END AS type, {_safe("split_part(term, chr(39), 2)")} AS value
FROM (SELECT {_js('id')} AS id, unnest(string_split(trim({_js('pattern')}, '[]'), '] OR [')) AS term
  FROM {_entries('stix_docs', 'objects')} WHERE {_js('type')} = 'indicator' AND {_js('pattern_type')} = 'stix') y""", "stix_docs"))
add("read_indicator_list", lambda s, d: Fd.parse_indicator_list(view(s, d, "indicator_lines")), with_views(f"""
SELECT type, {_safe("replace(v, 'User-Agent: ', '')")} AS value, type = 'ip' AS informational FROM (SELECT trim(value) AS v,
  CASE WHEN value LIKE '/%' THEN 'path' WHEN value LIKE 'User-Agent:%' THEN 'ua' WHEN {O.hit('value', C.IPV4)} THEN 'ip' ELSE 'unknown' END AS type
  FROM indicator_lines WHERE trim(value) <> '') x""", "indicator_lines"))


def indicator_union(spark, d):
    feeds = Fd.indicator_union(
        Fd.parse_kev(view(spark, d, "kev_docs")), Fd.parse_malware_urls(view(spark, d, "malware_url_docs")),
        Fd.parse_ioc_mixed(view(spark, d, "ioc_docs")), Fd.parse_url_list(view(spark, d, "url_lines")),
        Fd.parse_ip_list(view(spark, d, "ip_lines")), Fd.parse_c2_list(view(spark, d, "c2_lines")))
    return feeds.groupBy("source", "type").agg(
        F.count(F.lit(1)).alias("indicators"), F.count("description").alias("described"),
        F.sum(F.size("tags")).alias("tags"))


add("indicator_union", indicator_union, with_views(f"""
SELECT 'cisa_kev' AS source, 'cve' AS type, count(*) AS indicators, count(*) AS described,
  CAST(sum(1 + CASE WHEN {_js('vendorProject')} <> '' THEN 1 ELSE 0 END + CASE WHEN {_js('product')} <> '' THEN 1 ELSE 0 END
      + CASE WHEN {_js('knownRansomwareCampaignUse')} = 'Known' THEN 1 ELSE 0 END) AS BIGINT) AS tags
  FROM {_entries('kev_docs', 'vulnerabilities')} WHERE {_js('cveID')} <> ''
UNION ALL SELECT 'urlhaus', 'url', count(*), 0, CAST(sum(CASE WHEN json_type(e, '$.tags') = 'ARRAY' THEN 2 ELSE 0 END
      + CASE WHEN {_js('threat')} <> '' THEN 1 ELSE 0 END) AS BIGINT) FROM {_entries('malware_url_docs', 'urls')} WHERE {_js('url')} <> ''
UNION ALL SELECT 'threatfox', {O.lookup(_js('ioc_type'), C.IOC_TYPES, "'unknown'")}, count(*), 0,
  CAST(sum(CASE WHEN {_js('malware')} <> '' THEN 1 ELSE 0 END + CASE WHEN {_js('threat_type')} <> '' THEN 1 ELSE 0 END) AS BIGINT)
  FROM {_entries('ioc_docs', 'data', "json_extract_string(value, '$.query_status') = 'ok'")} WHERE {_js('ioc_value')} <> '' GROUP BY 2
UNION ALL SELECT 'openphish', 'url', count(*), 0, count(*) FROM url_lines WHERE trim(value) LIKE 'http%'
UNION ALL SELECT 'blocklist_de', 'ip', count(*), 0, 2 * count(*) FROM ip_lines WHERE {O.hit('trim(value)', C.IPV4)}
UNION ALL SELECT 'feodo_tracker', 'ip', count(*), 0, 3 * count(*) FROM c2_lines WHERE value NOT LIKE '#%'
""", "kev_docs", "malware_url_docs", "ioc_docs", "url_lines", "ip_lines", "c2_lines"))
add("per_feed_cap", lambda s, d: Fd.per_feed_cap(view(s, d, "custom_lines").withColumn("ord", F.col("ord").cast("bigint")), "feed", "ord", 5),
    with_views("SELECT ord, feed, value FROM custom_lines QUALIFY row_number() OVER (PARTITION BY feed ORDER BY ord) <= 5", "custom_lines"))


def feed_rollup(spark, d):
    polls = view(spark, d, "indicators").groupBy("source").agg(F.count(F.lit(1)).alias("indicators_count"))
    results = polls.select(F.col("source").alias("feed"), F.when(F.col("source") == "lab_feed", F.lit("error"))
                           .otherwise(F.lit("success")).alias("status"), "indicators_count", F.lit(0).cast("bigint").alias("rejected"))
    # A feed of one JSON document per page; every seventh document was cut short on its way.
    whole = F.to_json(F.struct(F.lit("ok").alias("query_status"), F.array(F.struct(
        F.col("url").alias("ioc_value"), F.lit("url").alias("ioc_type"), F.lit(80).alias("confidence_level"))).alias("data")))
    docs = table(spark, d, "pages").select(F.when(F.col("page_id") % 7 == 0, F.substring(whole, 1, 30)).otherwise(whole).alias("value"))
    landed = Fd.parse_ioc_mixed(docs).agg(F.count(F.lit(1)).alias("indicators_count"))
    polled = Fd.rejected(docs, Fd.IOCS).select(F.lit("page_feed").alias("feed"), F.lit("success").alias("status"), "rejected").withColumn(
        "indicators_count", landed.scalar())
    return Fd.feed_rollup(results.unionByName(polled))


add("feed_rollup", feed_rollup, with_views("""
SELECT coalesce(feed, '(total)') AS feed, count(*) FILTER (WHERE ok) AS polled, count(*) FILTER (WHERE NOT ok) AS skipped,
  CAST(coalesce(sum(n) FILTER (WHERE ok), 0) AS BIGINT) AS indicators, CAST(sum(bad) AS BIGINT) AS rejected
FROM (SELECT source AS feed, source <> 'lab_feed' AS ok, count(*) AS n, 0 AS bad FROM indicators GROUP BY 1, 2
  UNION ALL SELECT 'page_feed', true, count(*) FILTER (WHERE page_id % 7 <> 0), count(*) FILTER (WHERE page_id % 7 = 0) FROM pages) x GROUP BY ROLLUP (feed)""", "indicators"))

add("sanitize_indicator", lambda s, d: table(s, d, "documents").select(
        "doc_id", S.sanitize_indicator(F.col("text")).alias("value"),
        F.array_join(S.sanitize_tags(F.split("text", r"\.")), "|").alias("tags")),
    f"""SELECT doc_id, {_safe('text')} AS value, coalesce((SELECT string_agg(t, '|' ORDER BY i) FROM (
      SELECT i, substr({_safe('raw')}, 1, 50) AS t FROM (SELECT unnest(list_slice(string_split(d.text, '.'), 1, 20)) AS raw,
      unnest(range(1, 1 + least(20, len(string_split(d.text, '.'))))) AS i) r) s WHERE t <> ''), '') AS tags FROM documents d""")

# --- indicators against traffic and rules ------------------------------------------------------

_REQUESTS = """SELECT url, CAST(1 + page_id % 5 AS BIGINT) AS count,
  concat('2024-01-0', CAST(1 + page_id % 9 AS STRING), 'T00:00:00Z') AS timestamp FROM pages"""


def requests(spark, d):
    table(spark, d, "pages").createOrReplaceTempView("pages")
    return spark.sql(_REQUESTS)


def ind(spark, d):
    return view(spark, d, "indicators")


add("indicator_consolidate", lambda s, d: I.indicator_consolidate(ind(s, d)).withColumns(
        {"tags": F.array_join("tags", ","), "sources": F.array_join("sources", ",")}),
    with_views(f"""SELECT type, value, max(confidence) AS confidence,
      {O.label_of(f"min({O.ordinal('severity', C.SEVERITY_ORDER)})", C.SEVERITY_ORDER)} AS severity,
      string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
      min(first_seen) AS first_seen, count(DISTINCT source) AS source_count FROM indicators GROUP BY 1, 2""", "indicators"))
add("confidence_gate", lambda s, d: I.confidence_gate(ind(s, d)).groupBy("type", "source").agg(F.count(F.lit(1)).alias("kept")),
    with_views("SELECT type, source, count(*) AS kept FROM indicators WHERE confidence >= 0.5 GROUP BY 1, 2", "indicators"))

MATCHES = (
    ("i_want", "SELECT DISTINCT type, value FROM indicators"),
    ("m_ip", """SELECT type, value, s.count AS n, s.timestamp AS t FROM sanitized s JOIN i_want i
        ON i.type = 'ip' AND s.remote_addr = split_part(i.value, ':', 1)"""),
    ("requests", _REQUESTS),
    ("r_parts", """SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host,
        regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM requests"""),
    ("m_url", """SELECT i.type, i.value, r.count AS n, r.timestamp AS t FROM r_parts r JOIN i_want i
        ON i.type = 'domain' AND r.host = lower(i.value)
        UNION ALL SELECT i.type, i.value, r.count, r.timestamp FROM r_parts r JOIN i_want i
        ON i.type = 'url' AND r.host = lower(regexp_extract(i.value, '^[a-z]+://([^/:?#]+)', 1))
        AND r.path = regexp_extract(i.value, '^[a-z]+://[^/?#]*([^?#]*)', 1)
        AND regexp_extract(i.value, '[?]([^#]*)', 1) IN ('', regexp_extract(r.url, '[?]([^#]*)', 1))"""),
    ("m_pattern", """SELECT i.type, i.value, s.count AS n, s.timestamp AS t FROM sanitized s JOIN i_want i
        ON (i.type = 'path' AND starts_with(s.path, i.value)) OR (i.type = 'ua' AND contains(lower(s.ua), lower(i.value)))"""),
)


def _totals(source):
    return (f"SELECT type, value, CAST(sum(n) AS BIGINT) AS match_count, min(t) AS first_seen, max(t) AS last_seen "
            f"FROM {source} GROUP BY 1, 2")


add("ioc_match_ip", lambda s, d: I.ioc_match_ip(clean(s, d), ind(s, d)),
    O.over_sanitized(_totals("m_ip"), "indicators", ctes=MATCHES[:2]))
add("ioc_match_url", lambda s, d: I.ioc_match_url(requests(s, d), ind(s, d)),
    with_views(_totals("m_url"), "indicators", ctes=(MATCHES[0],) + MATCHES[2:5]))
add("ioc_match_pattern", lambda s, d: I.ioc_match_pattern(clean(s, d), ind(s, d)),
    O.over_sanitized(_totals("m_pattern"), "indicators", ctes=(MATCHES[0], MATCHES[5])))
RULE_PAIRS = (
    ("r_want", "SELECT DISTINCT modifier, pattern FROM rules WHERE category <> 'broken'"),
)


def _takes(path):
    return (f"CASE r.modifier WHEN '=' THEN {path} = r.pattern WHEN '~' THEN regexp_matches({path}, r.pattern) "
            f"WHEN '~*' THEN regexp_matches({path}, concat('(?i)', r.pattern)) ELSE starts_with({path}, r.pattern) END")


_COVERED = f"""SELECT i.value, CAST(count(r.pattern) AS BIGINT) AS patterns, min(r.pattern) AS blocked_by, count(r.pattern) > 0 AS blocked
  FROM (SELECT DISTINCT value FROM indicators WHERE type = 'path') i LEFT JOIN r_want r ON {_takes('i.value')} GROUP BY 1"""
add("ioc_sightings", lambda s, d: I.ioc_sightings(clean(s, d), requests(s, d), ind(s, d), view(s, d, "rules")),
    O.over_sanitized(f"""SELECT i.type, i.value, coalesce(match_count, 0) AS match_count, first_seen, last_seen, c.blocked_by FROM i_want i LEFT JOIN
      ({_totals('(SELECT * FROM m_ip UNION ALL SELECT * FROM m_url UNION ALL SELECT * FROM m_pattern) a')}) m
      ON i.type = m.type AND i.value = m.value LEFT JOIN ({_COVERED}) c ON i.type = 'path' AND c.value = i.value AND c.blocked""",
        "indicators", "rules", ctes=MATCHES + RULE_PAIRS))

add("ioc_coverage", lambda s, d: I.ioc_coverage(ind(s, d), view(s, d, "rules")),
    with_views(_COVERED, "indicators", "rules", ctes=RULE_PAIRS))
add("uncovered_indicators", lambda s, d: I.uncovered_indicators(ind(s, d), view(s, d, "rules")),
    with_views(f"SELECT value FROM ({_COVERED}) c WHERE NOT blocked", "indicators", "rules", ctes=RULE_PAIRS))
add("rule_impact", lambda s, d: I.rule_impact(clean(s, d), view(s, d, "rules")),
    O.over_sanitized(f"""SELECT r.modifier, r.pattern, CAST(sum(s.count) AS BIGINT) AS hits, count(DISTINCT s.remote_addr) AS sources,
      round(CAST(sum(CASE WHEN s.status_bucket = '2xx' THEN s.count ELSE 0 END) AS DOUBLE) / CAST(sum(s.count) AS DOUBLE), 6) AS ok_share
      FROM sanitized s JOIN r_want r ON {_takes('s.path')} GROUP BY 1, 2""", "rules", ctes=RULE_PAIRS))
