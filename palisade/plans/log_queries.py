"""Registered queries over access logs: parsing, cleaning, events, detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import catalog as C
from palisade.functions import sanitize as S
from palisade.operators import events as E
from palisade.plans import oracle as O
from palisade.plans.fixtures import view, with_views
from palisade.session import new_folder
from palisade.sinks import batches as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, run, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = oracle


def access(spark, d):
    return view(spark, d, "access_events")


def clean(spark, d):
    return E.sanitize_events(access(spark, d))


# --- cleaning and classifying, one query per column expression ---------------------------------

_DOC = "SELECT doc_id AS ord, text AS raw FROM documents"
_TALK = "SELECT conv_id * 1000 + turn AS ord, text AS raw FROM conversations"


def _text_query(name, source, spark_expr, duck_expr):
    """Expressions over whole free texts, spiked with the literals they must remove."""
    spiked = ("concat(raw, ' IGNORE previous sysSYSTEM:tem: ', chr(36), '{jndi:x} ', chr(36), '{y}', chr(36), '(id)`z` [INST] "
              "password=hunter', CAST(ord AS STRING), ' a<b>c;d|e&f')")
    sql = f"SELECT ord, {spiked} AS t FROM ({source}) r"

    def run(spark, d):
        from palisade.session import table
        for base in ("documents", "conversations"):
            table(spark, d, base).createOrReplaceTempView(base)
        return spark.sql(sql).select("ord", spark_expr(F.col("t")).alias("value"))

    add(name, run, f"SELECT ord, {duck_expr('t')} AS value FROM ({sql}) s")


def _column_query(name, spark_expr, duck_expr):
    add(name, lambda s, d: access(s, d).select("ord", spark_expr().alias("value")),
        O.over_access(f"SELECT ord, {duck_expr} AS value FROM access_events"))


def _clean_query(name, spark_expr, duck_expr):
    add(name, lambda s, d: clean(s, d).select("ord", spark_expr().alias("value")),
        O.over_sanitized(f"SELECT ord, {duck_expr} AS value FROM sanitized"))


def _redact(v):
    for _, pattern in C.SECRET_PATTERNS:
        v = O.sub(v, pattern, O.q(C.REDACTED))
    return v


c = F.col
_column_query("hex_decode", lambda: S.hex_decode(c("hex_path")), O.decode("hex_path"))
_text_query("strip_injection", _TALK, S.strip_injection, O.strip_injection)
_text_query("strip_templates", _DOC, S.strip_templates, O.strip_templates)
_text_query("apply_allowlist", _DOC, S.apply_allowlist, O.allowlist)
_text_query("strip_shell_meta", _DOC, S.strip_shell_meta, O.strip_shell)
_text_query("truncate", _DOC, S.truncate, lambda v: f"substr({v}, 1, 200)")
_text_query("redact_secrets", _DOC, S.redact_secrets, _redact)
_text_query("hex_encode_fields", _TALK, S.hex_encode,
            lambda v: f"lower(hex(encode(substr({v}, 1, 200))))")


_clean_query("classify_path", lambda: c("path_class"), "path_class")
add("classify_ua", lambda s, d: clean(s, d).select("ord", "user_agent_family", "scanner_family"),
    O.over_sanitized("SELECT ord, user_agent_family, scanner_family FROM sanitized"))
_column_query("status_bucket", lambda: S.status_bucket(c("status")), O.status_bucket("status"))
_column_query("classify_ip", lambda: S.classify_ip(c("remote_addr")), O.classify_ip("remote_addr"))
_column_query("rate_signal", lambda: S.rate_signal(c("count")), O.rate_signal("count"))
_column_query("validate_method", lambda: S.validate_method(c("method")), O.method("method"))
_clean_query("mitigation_type", lambda: S.mitigation_type(c("path_class")),
             "CASE path_class WHEN 'unknown' THEN 'monitor' ELSE 'location_block' END")
_clean_query("confidence", lambda: S.confidence(c("path_class"), c("scanner_family")),
             O.confidence("path_class", "scanner_family"))
_clean_query("safe_note", lambda: S.safe_note(c("path_class"), c("path"), c("count")),
             O.safe_note("path_class", "path", "count"))
_column_query("timestamp_bucket", lambda: S.timestamp_bucket(c("timestamp")), O.HOUR)
add("match_type_ttl", lambda s, d: clean(s, d).select(
        "ord", S.match_type(c("path_class")).alias("match_type"), S.ttl(c("path_class")).alias("ttl")),
    O.over_sanitized("""SELECT ord, CASE WHEN path_class = 'unknown' THEN 'none' ELSE 'regex_path' END AS match_type,
        CASE WHEN path_class = 'unknown' THEN 'review' ELSE 'permanent' END AS ttl FROM sanitized"""))
_column_query("hash_ip", lambda: S.hash_ip(c("remote_addr"), "salt-1"), "sha256(concat('salt-1', remote_addr))")

_PROFILE_CASE = """CASE WHEN profile = 'internal-only' AND remote_addr_class = 'private_ipv4' THEN NULL
  WHEN profile = 'internal-only' AND user_agent_family IN ('go-http-client','python-requests','curl') THEN 'info'
  WHEN profile = 'static-site' AND method_class = 'PUT' THEN 'critical'
  WHEN profile = 'static-site' AND method_class IN ('POST','DELETE') THEN 'high'
  WHEN profile = 'api-gateway' AND (method_class IN ('TRACE','CONNECT','INVALID') OR path_class = 'path_traversal') THEN 'high'
  WHEN profile = 'high-risk-lockdown' AND severity = 'medium' THEN 'high'
  WHEN profile = 'high-risk-lockdown' AND severity = 'high' THEN 'critical' ELSE severity END"""


def profile_severity(spark, d):
    return E.graded(clean(spark, d)).groupBy("profile", "severity").agg(
        F.sum("events").alias("events"), F.sum("hits").alias("hits"))


add("profile_severity", profile_severity, O.over_sanitized(f"""
SELECT profile, {_PROFILE_CASE} AS severity, count(*) AS events, CAST(sum(count) AS BIGINT) AS hits
FROM (SELECT *, CASE WHEN path_class = 'unknown' THEN 'low' WHEN scanner_family IS NOT NULL THEN 'high' ELSE 'medium' END AS severity
      FROM sanitized) s, (VALUES {', '.join(f"('{p}')" for p in C.PROFILES)}) AS v(profile)
WHERE ({_PROFILE_CASE}) IS NOT NULL GROUP BY 1, 2"""))


def redaction_counts(spark, d):
    from palisade.session import table
    docs = table(spark, d, "documents")
    kinds = [F.struct(F.lit(k).alias("kind"), S.secret_hits(c("text"), k).alias("hits"))
             for k, _ in C.SECRET_PATTERNS]
    return (docs.select(F.inline(F.array(*kinds))).groupBy("kind")
            .agg(F.sum("hits").alias("hits"), F.count_if(c("hits") > 0).alias("documents")))


def _redaction_oracle():
    parts, value = [], "text"
    for kind, pattern in C.SECRET_PATTERNS:
        found = f"length(regexp_extract_all({value}, {O.q(pattern)}))"
        parts.append(f"SELECT '{kind}' AS kind, CAST(sum({found}) AS BIGINT) AS hits, "
                     f"count(*) FILTER (WHERE {found} > 0) AS documents FROM documents")
        value = O.sub(value, pattern, O.q(C.REDACTED))
    return " UNION ALL ".join(parts)


add("redaction_counts", redaction_counts, _redaction_oracle())

# --- events ------------------------------------------------------------------------------------

add("l1_group", lambda s, d: E.l1_group(access(s, d)).withColumn("status", c("status").cast("bigint")), O.over_access("""
SELECT method, hex_path, CAST(status AS BIGINT) AS status, hex_user_agent, CAST(sum(count) AS BIGINT) AS count, min(timestamp) AS timestamp,
       arg_min(remote_addr, ord) AS remote_addr, min(ord) AS ord
FROM access_events GROUP BY 1, 2, 3, 4"""))
add("sanitize_events", lambda s, d: clean(s, d).drop("ts"), O.over_sanitized("SELECT * EXCLUDE (ts) FROM sanitized"))
add("hits_by_class", lambda s, d: E.hits_by_class(clean(s, d)), O.over_sanitized(
    "SELECT path_class, CAST(sum(count) AS BIGINT) AS hits FROM sanitized GROUP BY 1"))

# Row-wise restatement: a row opens an event when its five-part key is new; other rows add their
# count to the earliest event with the same four-part key.
DEDUP = (
    ("d_rows", """SELECT *, row_number() OVER (PARTITION BY path_class, user_agent_family, method_class, status_bucket,
        remote_addr ORDER BY ord) AS nth FROM sanitized"""),
    ("d_events", f"""SELECT ord, timestamp, {O.HOUR} AS timestamp_bucket, remote_addr, remote_addr_class, path_class,
        user_agent_family, method_class, status_bucket, scanner_family, {O.rate_signal('count')} AS rate_signal,
        CASE path_class WHEN 'unknown' THEN 'none' ELSE 'regex_path' END AS indicator_match_type,
        CASE path_class WHEN 'unknown' THEN 'monitor' ELSE 'location_block' END AS candidate_mitigation_type,
        {O.confidence('path_class', 'scanner_family')} AS confidence, '{C.PROVENANCE}' AS provenance,
        CASE path_class WHEN 'unknown' THEN 'review' ELSE 'permanent' END AS ttl_recommendation,
        {O.safe_note('path_class', 'path', 'count')} AS safe_notes,
        CAST(count + CASE WHEN ord = min(ord) OVER k4 THEN sum(CASE WHEN nth > 1 THEN count ELSE 0 END) OVER k4 ELSE 0 END AS BIGINT) AS count,
        nth FROM d_rows WINDOW k4 AS (PARTITION BY path_class, user_agent_family, method_class, status_bucket)"""),
    ("deduped", "SELECT * EXCLUDE (nth) FROM d_events WHERE nth = 1"),
    ("numbered", """SELECT *, concat('evt-', replace(substr(timestamp, 1, 10), '-', ''), '-',
        CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END) AS event_id
        FROM (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM deduped) x"""),
)
add("dedup_events", lambda s, d: E.dedup_events(clean(s, d)),
    O.over_sanitized("SELECT * FROM deduped", ctes=DEDUP))
add("event_numbering", lambda s, d: E.event_numbering(E.dedup_events(clean(s, d))).select("ord", "event_id"),
    O.over_sanitized("SELECT ord, event_id FROM numbered", ctes=DEDUP))
add("published_events", lambda s, d: E.published_events(E.event_numbering(E.dedup_events(clean(s, d)))),
    O.over_sanitized("""SELECT event_id, 'access_log' AS source_type, '/var/log/nginx/access.log' AS log_source_path,
      timestamp_bucket, remote_addr_class, method_class, path_class, status_bucket, user_agent_family, rate_signal,
      scanner_family, indicator_match_type, candidate_mitigation_type, confidence, provenance, ttl_recommendation,
      safe_notes, count FROM numbered""", ctes=DEDUP))

L1 = (
    ("log_cut", r"""SELECT ord, regexp_extract(value, '^(\S+)', 1) AS remote_addr, split_part(value, '"', 2) AS request,
        split_part(value, '"', 6) AS ua, trim(split_part(value, '"', 3)) AS numbers,
        strptime(regexp_extract(value, '\[([^\]]+) ', 1), '%d/%b/%Y:%H:%M:%S') AS ts FROM log_lines WHERE value NOT LIKE 'garbage%'"""),
    ("log_rows", r"""SELECT ord, remote_addr, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, split_part(request, ' ', 1) AS method,
        CAST(split_part(numbers, ' ', 1) AS INT) AS status,
        lower(hex(encode(substr(regexp_extract(request, '^\S+ (.*?)( HTTP/[0-9.]+)?$', 1), 1, 200)))) AS hex_path, lower(hex(encode(substr(ua, 1, 200)))) AS hex_user_agent FROM log_cut"""),
    ("access_events", """SELECT min(ord) AS ord, arg_min(remote_addr, ord) AS remote_addr, min(timestamp) AS timestamp, method, hex_path, status, hex_user_agent,
        CAST(count(*) AS BIGINT) AS count, CAST(min(timestamp) AS TIMESTAMP) AS ts FROM log_rows GROUP BY method, hex_path, status, hex_user_agent"""),
) + O.SANITIZED + DEDUP
add("analyze_logs", lambda s, d: E.analyze_logs(view(s, d, "log_lines")).select(
        "event_id", "timestamp_bucket", "remote_addr_class", "method_class", "path_class", "status_bucket", "user_agent_family",
        "scanner_family", "confidence", "safe_notes", "count", "accepted"),
    with_views("""SELECT event_id, timestamp_bucket, remote_addr_class, method_class, path_class, status_bucket, user_agent_family,
      scanner_family, confidence, safe_notes, count, true AS accepted FROM numbered""", "log_lines", ctes=L1))


def log_findings(spark, d):
    from palisade.operators.detect import rule_classes_of
    rules = view(spark, d, "rules").select(F.explode(rule_classes_of(c("category"))).alias("path_class"))
    return E.log_findings(clean(spark, d), rules)


_CLASS_LIST = "CASE category " + " ".join(
    f"WHEN '{k}' THEN [{', '.join(O.q(x) for x in v)}]" for k, v in C.RULE_CATEGORY_TO_CLASSES.items()) + " ELSE [category] END"
add("log_findings", log_findings, O.over_sanitized(f"""
SELECT profile, path_class AS pattern, CAST(sum(count) AS BIGINT) AS hit_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  {O.label_of(f"min({O.ordinal('sev', C.SEVERITY_ORDER)})", C.SEVERITY_ORDER)} AS severity,
  CASE WHEN path_class NOT IN (SELECT unnest({_CLASS_LIST}) FROM rules) THEN 'location_block' END AS proposed_rule
FROM (SELECT *, {_PROFILE_CASE} AS sev FROM (SELECT *, CASE WHEN path_class = 'unknown' THEN 'low' WHEN scanner_family IS NOT NULL THEN 'high' ELSE 'medium' END AS severity
      FROM sanitized) s, (VALUES {', '.join(f"('{p}')" for p in C.PROFILES)}) AS v(profile)) g
WHERE sev IS NOT NULL AND path_class <> 'unknown' GROUP BY profile, path_class HAVING sum(count) > 1 OR profile = 'high-risk-lockdown'""", "rules"))

add("traffic_summary", lambda s, d: E.traffic_summary(clean(s, d)), O.over_sanitized("""
SELECT count(*) AS rows, CAST(sum(count) AS BIGINT) AS total_events, count(DISTINCT remote_addr) AS unique_ips,
  count(DISTINCT path) AS unique_paths, count(DISTINCT ua) AS unique_user_agents,
  min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM sanitized"""))


def traffic_summary_folded(spark, d):
    """Day sketches landed in two batches and folded, beside the exact counts that they must be close to."""
    rows, folder = clean(spark, d), new_folder(spark, "sketches")
    for n in (0, 1):
        B.write_batch(E.daily_sketches(rows.where(f"ord % 2 = {n}")), n, folder, ["dt"])
    folded = E.summary_of(B.read_batches(spark, folder))
    counts = list(E.DISTINCT.values())
    exact = E.traffic_summary(rows).select(*[c(x).alias(f"exact_{x}") for x in counts])
    both = folded.unionByName(exact, allowMissingColumns=True).groupBy().agg(*[F.max(x).alias(x) for x in [*folded.columns, *exact.columns]])
    return both.select("rows", "total_events", "first_seen", "last_seen", *[
        (F.abs(c(x) - c(f"exact_{x}")) <= 0.03 * c(f"exact_{x}")).alias(f"{x}_close") for x in counts])


add("traffic_summary_folded", traffic_summary_folded, O.over_sanitized("""
SELECT count(*) AS rows, CAST(sum(count) AS BIGINT) AS total_events, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  true AS unique_ips_close, true AS unique_paths_close, true AS unique_user_agents_close FROM sanitized"""))
add("class_scanner_cube", lambda s, d: E.class_scanner_cube(clean(s, d)), O.over_sanitized("""
SELECT coalesce(path_class, '(all)') AS path_class, coalesce(scanner, '(all)') AS scanner,
  coalesce(status_bucket, '(all)') AS status_bucket, CAST(grouping(path_class, scanner, status_bucket) AS BIGINT) AS level,
  CAST(sum(count) AS BIGINT) AS hits
FROM (SELECT *, coalesce(scanner_family, 'none') AS scanner FROM sanitized) s GROUP BY CUBE (path_class, scanner, status_bucket)"""))
add("status_distribution", lambda s, d: E.status_distribution(clean(s, d)), O.over_sanitized("""
SELECT path_class, status_bucket, hits, round(CAST(hits AS DOUBLE) / CAST(sum(hits) OVER (PARTITION BY path_class) AS DOUBLE), 6) AS share
FROM (SELECT path_class, status_bucket, CAST(sum(count) AS BIGINT) AS hits FROM sanitized GROUP BY 1, 2) x"""))
add("top_groups", lambda s, d: E.top_groups(access(s, d)).withColumn("status", c("status").cast("bigint")), O.over_access("""
SELECT method, hex_path, CAST(status AS BIGINT) AS status, hex_user_agent, CAST(sum(count) AS BIGINT) AS count FROM access_events
GROUP BY 1, 2, 3, 4 ORDER BY 5 DESC, 1, 2, 3, 4 LIMIT 20"""))
add("lookback", lambda s, d: E.hits_by_class(E.sanitize_events(E.lookback(access(s, d), "2024-01-20 00:00:00", 72))), O.over_sanitized("""
SELECT path_class, CAST(sum(count) AS BIGINT) AS hits FROM sanitized
WHERE ts > TIMESTAMP '2024-01-17 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1"""))

# Events with planted contract breaks.
CONTRACT = """SELECT event_id AS ord, CASE WHEN event_id % 50 = 1 THEN 'evt-20240101-0000'
      ELSE concat('evt-20240101-', CAST(event_id AS STRING)) END AS event_id,
  CASE WHEN event_id % 31 = 4 THEN 'ftp_log' ELSE 'access_log' END AS source_type, '/var/log/nginx/access.log' AS log_source_path,
  CASE WHEN event_id % 37 = 5 THEN '2024-01-01T25:00Z' ELSE '2024-01-01T05:00Z' END AS timestamp_bucket,
  'public_ipv4' AS remote_addr_class, CASE WHEN event_id % 23 = 2 THEN 'YELL' ELSE 'GET' END AS method_class,
  CASE WHEN event_id % 29 = 3 THEN NULL ELSE 'dotfile' END AS path_class, '4xx' AS status_bucket, 'curl' AS user_agent_family,
  'normal' AS rate_signal, CASE WHEN event_id % 41 = 6 THEN 1.5 ELSE value / 1000000 END AS confidence, 'p' AS provenance,
  CASE WHEN event_id % 43 = 7 THEN repeat('x', 201) ELSE 'note' END AS safe_notes, event_id % 19 AS count,
  CASE WHEN event_id % 47 = 8 THEN 'Mozilla' ELSE NULL END AS raw_user_agent FROM events"""


def event_contract(spark, d):
    from palisade.session import table
    table(spark, d, "events").createOrReplaceTempView("events")
    checked = E.event_contract(spark.sql(CONTRACT))
    return checked.select("ord", "accepted", F.array_join("errors", ",").alias("errors"))


add("event_contract", event_contract, f"""
SELECT ord, errors = '' AS accepted, errors FROM (SELECT ord, concat_ws(',',
  CASE WHEN path_class IS NULL THEN 'missing:path_class' END,
  CASE WHEN source_type = 'ftp_log' THEN 'enum:source_type' END,
  CASE WHEN method_class = 'YELL' THEN 'enum:method_class' END,
  CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'range:confidence' END,
  CASE WHEN count < 1 THEN 'range:count' END,
  CASE WHEN length(safe_notes) > 200 THEN 'length:safe_notes' END,
  CASE WHEN timestamp_bucket LIKE '%T25%' THEN 'format:timestamp_bucket' END,
  CASE WHEN raw_user_agent IS NOT NULL THEN 'forbidden:raw_user_agent' END,
  CASE WHEN count(*) OVER (PARTITION BY event_id) > 1 THEN 'duplicate:event_id' END) AS errors FROM ({CONTRACT}) c) x""")
