"""Registered queries over detectors, rule ageing and outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import catalog as C
from palisade.functions import sanitize as S
from palisade.operators import aging as G
from palisade.operators import detect as D
from palisade.operators import events as E
from palisade.plans import oracle as O
from palisade.plans.fixtures import view, with_views
from palisade.plans.log_queries import DEDUP, clean
from palisade.session import materialize, new_folder, table
from palisade.sinks import batches as B
from palisade.sinks import outputs as K
from palisade.sinks.outputs import with_day

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SALT = "palisade"


def add(name, run, oracle=None):
    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = oracle


_ADDR = f"sha256(concat('{SALT}', remote_addr)) AS remote_addr"
_ISO = "'%Y-%m-%dT%H:%M:%S'"

# A wide burst window keeps the query busy on sparse test data; 2 s is the operator's default.
add("burst_detect", lambda s, d: D.hashed(D.burst_detect(clean(s, d), 7200, 2), SALT), O.over_sanitized(f"""
SELECT ord, {_ADDR}, path_class, probes FROM (SELECT *, count(*) OVER (PARTITION BY remote_addr, path_class ORDER BY ts
  RANGE BETWEEN INTERVAL 7200 SECONDS PRECEDING AND CURRENT ROW) AS probes FROM sanitized WHERE path_class <> 'unknown') x
WHERE probes >= 2"""))
add("brute_force", lambda s, d: D.hashed(D.brute_force(clean(s, d)), SALT), O.over_sanitized(f"""
SELECT strftime(time_bucket(INTERVAL 5 MINUTES, ts), {_ISO}) AS slot, {_ADDR}, CAST(sum(count) AS BIGINT) AS requests FROM sanitized
WHERE regexp_matches(path, '(?i)(login|signin|auth|session|xmlrpc)') GROUP BY 1, remote_addr HAVING sum(count) > 5"""))
add("status_distribution_by_source", lambda s, d: D.hashed(E.status_distribution(clean(s, d), "remote_addr"), SALT), O.over_sanitized(f"""
SELECT sha256(concat('{SALT}', remote_addr)) AS remote_addr, status_bucket, hits, round(CAST(hits AS DOUBLE) / CAST(sum(hits) OVER (PARTITION BY remote_addr) AS DOUBLE), 6) AS share
FROM (SELECT remote_addr, status_bucket, CAST(sum(count) AS BIGINT) AS hits FROM sanitized GROUP BY 1, 2) x"""))


def _sequence(name, seconds, steps):
    """Any later request of the source may be the next step; the oracle joins the steps in pairs."""
    froms = "sanitized s" + "".join(
        f" JOIN sanitized p{k} ON p{k}.remote_addr = s.remote_addr AND contains(p{k}.path, {O.q(step)}) AND (p{k}.ts, p{k}.ord) < ({nxt}.ts, {nxt}.ord)"
        for k, step, nxt in reversed([(k, step, f"p{k + 1}" if k + 2 < len(steps) else "s") for k, step in enumerate(steps[:-1])]))
    add(name, lambda s, d: D.hashed(D.sequence_probe(clean(s, d), seconds, steps), SALT), O.over_sanitized(f"""
SELECT DISTINCT s.ord, sha256(concat('{SALT}', s.remote_addr)) AS remote_addr, s.path AS last_path FROM {froms}
WHERE contains(s.path, {O.q(steps[-1])}) AND epoch_us(s.ts) - epoch_us(p0.ts) <= {seconds}000000"""))


# Hours instead of seconds, so that the sparse test data has sequences at all.
_sequence("sequence_probe", 14400, ("login", "env", "api"))
_sequence("sequence_probe_long", 86400, ("index", "login", "env", "git"))


# Each event as a scanner's run of requests: (seconds after the event, path).
RUN = ((0, "/health"), (1, "/.env"), (2, "/.env.bak"), (3, "/.git/config"), (4, "/static/a.css"), (5, "/info.php"))


def scanner_runs(spark, d):
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(at).alias("at"), F.lit(path).alias("path")) for k, (at, path) in enumerate(RUN)])
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", F.inline(steps)).where("k <> 1 OR event_id % 3 > 0")
    return rows.select((F.col("event_id") * 10 + F.col("k")).alias("ord"), "path", S.classify_path("path").alias("path_class"),
                       F.concat(F.lit("203.0.113."), F.col("user_id").cast("string")).alias("remote_addr"),
                       (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("at"))).alias("ts"))


_RUNS = f"""(SELECT event_id * 10 + k AS ord, concat('203.0.113.', CAST(user_id AS VARCHAR)) AS remote_addr, path, ts + late * INTERVAL 1 SECOND AS ts,
  {O.first_match('path', C.PATH_CLASSES, "'unknown'")} AS path_class
  FROM events, (VALUES {', '.join(f"({k}, {at}, '{path}')" for k, (at, path) in enumerate(RUN))}) v(k, late, path) WHERE k <> 1 OR event_id % 3 > 0)"""
add("burst_detect_default", lambda s, d: D.hashed(D.burst_detect(scanner_runs(s, d)), SALT), f"""
SELECT ord, {_ADDR}, path_class, probes FROM (SELECT *, count(*) OVER (PARTITION BY remote_addr, path_class ORDER BY ts
  RANGE BETWEEN INTERVAL 2 SECONDS PRECEDING AND CURRENT ROW) AS probes FROM {_RUNS} r WHERE path_class <> 'unknown') x
WHERE probes >= 3""")
add("sequence_probe_default", lambda s, d: D.hashed(D.sequence_probe(scanner_runs(s, d)), SALT), f"""
SELECT DISTINCT c.ord, sha256(concat('{SALT}', c.remote_addr)) AS remote_addr, c.path AS last_path
FROM {_RUNS} c JOIN {_RUNS} b ON b.remote_addr = c.remote_addr AND contains(b.path, 'env') AND (b.ts, b.ord) < (c.ts, c.ord)
JOIN {_RUNS} a ON a.remote_addr = b.remote_addr AND contains(a.path, 'health') AND (a.ts, a.ord) < (b.ts, b.ord)
WHERE contains(c.path, 'info') AND epoch_us(c.ts) - epoch_us(a.ts) <= 60000000 AND c.ts - b.ts <= INTERVAL 60 SECONDS""")


def _anomaly(series, keys, factor, floor):
    k = ", ".join(keys)
    return f"""SELECT strftime(hour, {_ISO}) AS hour, {k}, hits, round(m, 4) AS mean FROM (
      SELECT *, avg(hits) OVER w AS m, stddev_pop(hits) OVER w AS sd, count(hits) OVER w AS seen FROM ({series}) h
      WINDOW w AS (PARTITION BY {k} ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) x
    WHERE seen >= 3 AND hits >= {floor} AND hits > m + {factor} * sd"""


add("status_anomaly", lambda s, d: D.status_anomaly(clean(s, d), 2.0), O.over_sanitized(_anomaly(
    "SELECT date_trunc('hour', ts) AS hour, status_bucket, CAST(sum(count) AS BIGINT) AS hits FROM sanitized GROUP BY 1, 2",
    ["status_bucket"], "2.0", 1)))
add("rate_anomaly", lambda s, d: D.rate_anomaly(clean(s, d)), O.over_sanitized(_anomaly(
    """SELECT date_trunc('hour', ts) AS hour, source, CAST(sum(count) AS BIGINT) AS hits FROM (
       SELECT ts, count, remote_addr AS source FROM sanitized
       UNION ALL SELECT ts, count, concat(regexp_extract(remote_addr, '^(\\d+\\.\\d+\\.\\d+)', 1), '.0/24') FROM sanitized
       WHERE regexp_matches(remote_addr, '^\\d+\\.\\d+\\.\\d+\\.\\d+$')) b GROUP BY 1, 2""", ["source"], "3.0", 10)))
add("method_anomaly", lambda s, d: D.hashed(D.method_anomaly(clean(s, d)), SALT), O.over_sanitized(f"""
SELECT strftime(date_trunc('hour', ts), {_ISO}) AS hour, {_ADDR}, method_class, CAST(sum(count) AS BIGINT) AS hits FROM sanitized
WHERE method_class IN ('TRACE', 'CONNECT', 'INVALID', 'OPTIONS') GROUP BY 1, remote_addr, 3
HAVING method_class <> 'OPTIONS' OR sum(count) > 3"""))

_CLASSES = "CASE category " + " ".join(
    f"WHEN '{k}' THEN [{', '.join(O.q(x) for x in v)}]" for k, v in C.RULE_CATEGORY_TO_CLASSES.items()) + " ELSE [category] END"
add("uncovered_patterns", lambda s, d: D.uncovered_patterns(
        clean(s, d), view(s, d, "rules"), D.rule_classes_of(F.col("category"))),
    O.over_sanitized(f"""SELECT path_class, CAST(sum(count) AS BIGINT) AS hits FROM sanitized WHERE path_class <> 'unknown'
      AND path_class NOT IN (SELECT unnest({_CLASSES}) FROM rules) GROUP BY 1""", "rules"))


def scanners_not_blocked(spark, d):
    blocked = view(spark, d, "indicators").where("type = 'ua'").select(
        F.regexp_replace("value", "/", "").alias("scanner_family")).distinct()
    return D.scanners_not_blocked(clean(spark, d), blocked)


add("scanners_not_blocked", scanners_not_blocked, O.over_sanitized("""
SELECT scanner_family, CAST(sum(count) AS BIGINT) AS hits FROM sanitized s WHERE scanner_family IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM indicators i WHERE i.type = 'ua' AND replace(i.value, '/', '') = s.scanner_family) GROUP BY 1""", "indicators"))


def upstream_correlation(spark, d):
    gateway = view(spark, d, "access_events").where("status IN (502, 503)")
    return D.upstream_correlation(gateway, view(spark, d, "upstream_errors"))


_AT = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"
add("upstream_correlation", upstream_correlation, with_views(f"""
SELECT slot, upstream, CAST(sum(c) AS BIGINT) AS gateway_errors, CAST(sum(c * n) AS BIGINT) AS near_pairs FROM (
  SELECT g.ord, any_value(CAST(floor(g.at / 300) AS BIGINT)) AS slot, u.upstream, any_value(g.count) AS c, count(*) AS n
  FROM (SELECT ord, {_AT} AS at, count FROM access_events WHERE status IN (502, 503)) g
  JOIN (SELECT upstream, {_AT} AS at FROM upstream_errors) u ON u.at BETWEEN g.at - 300 AND g.at + 300 GROUP BY g.ord, u.upstream) x
GROUP BY 1, 2""", "access_events", "upstream_errors"))

# --- rules and ageing --------------------------------------------------------------------------

_COMMENT_CASE = " ".join(f"WHEN contains(comment, {O.q(w)}) THEN {O.q(c)}" for w, c in C.COMMENT_KEYWORDS)
LINES = (
    ("c_lines", """SELECT host, path, snapshot_id, file_id, CAST(n AS BIGINT) AS line_number, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line
        FROM (SELECT *, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS n FROM config_files) x"""),
)
EXTRACTED = LINES + (
    ("c_state", r"""SELECT *, CASE WHEN line LIKE '#%' AND NOT regexp_matches(line, '^#\s*aging:') AND regexp_matches(line, '^#\s*\S')
          THEN lower(trim(regexp_extract(regexp_replace(line, '^#\s*Block\s+(.)', '#\1'), '^#\s*(.+)$', 1)))
          WHEN line NOT LIKE '#%' AND line <> '' THEN '' END AS state FROM c_lines"""),
    ("c_marks", r"""SELECT l.*, last_value(state IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c0,
          (SELECT min(c.line_number) FROM c_lines c WHERE c.file_id = l.file_id AND c.line_number > l.line_number AND contains(c.line, '}')) AS close_at,
          (SELECT arg_min(CASE WHEN c.line LIKE '%return 404%' OR c.line LIKE '%return 403%' THEN 'return_404' ELSE 'deny_all' END, c.line_number)
             FROM c_lines c WHERE c.file_id = l.file_id AND c.line_number > l.line_number AND NOT contains(c.line, '}')
             AND regexp_matches(c.line, 'return 40[34]|deny all')) AS action,
          (SELECT min(c.line_number) FROM c_lines c WHERE c.file_id = l.file_id AND c.line_number > l.line_number AND NOT contains(c.line, '}')
             AND regexp_matches(c.line, 'return 40[34]|deny all')) AS act_at
          FROM c_state l"""),
    ("c_rules", r"""SELECT file_id, host, path, snapshot_id, line_number, regexp_extract(line, '^location\s+(~\*?|=|)\s*(.+?)\s*\{', 2) AS pattern,
          regexp_extract(line, '^location\s+(~\*?|=|)\s*(.+?)\s*\{', 1) AS modifier, action, nullif(c0, '') AS comment
          FROM c_marks WHERE regexp_matches(line, '^location\s+(~\*?|=|)\s*(.+?)\s*\{') AND action IS NOT NULL AND (close_at IS NULL OR act_at < close_at)"""),
    ("extracted", f"""SELECT *, CASE {_COMMENT_CASE} WHEN contains(pattern, '\\.') AND lower(pattern) LIKE '%env%' THEN 'env_variants'
          WHEN contains(pattern, '/\\.') THEN 'dotfile' WHEN contains(pattern, '.map$') THEN 'source_map' WHEN lower(pattern) LIKE '%.php%' THEN 'php'
          WHEN lower(pattern) LIKE '%wp-%' THEN 'wordpress' WHEN lower(pattern) LIKE '%actuator%' THEN 'actuator'
          WHEN regexp_matches(lower(pattern), 'swagger|api-docs') THEN 'swagger' WHEN regexp_matches(lower(pattern), 'debug|trace') THEN 'debug_tools'
          WHEN lower(pattern) LIKE '%admin%' THEN 'admin_panel' ELSE 'uncategorized' END AS category FROM c_rules"""),
)


def extracted(spark, d):
    return G.extract_rules(view(spark, d, "config_files"))


add("extract_rules", lambda s, d: extracted(s, d), with_views("SELECT * FROM extracted", "config_files", ctes=EXTRACTED))

STALE = (
    ("k_hits", "SELECT path_class, CAST(sum(count) AS BIGINT) AS hits FROM sanitized GROUP BY 1"),
    ("k_rules", f"""SELECT r.*, CAST(coalesce((SELECT sum(hits) FROM k_hits h WHERE list_contains({_CLASSES.replace('category', 'r.category')}, h.path_class)), 0) AS BIGINT) AS hits_in_period
        FROM rules r"""),
    ("stale", f"""SELECT *, CASE WHEN hits_in_period > 3 THEN 'keep' WHEN hits_in_period > 0 THEN 'monitor' ELSE 'review' END AS recommendation,
        CASE WHEN hits_in_period > 3 THEN concat('Active: ', hits_in_period, ' hits in period')
             WHEN hits_in_period > 0 THEN concat('Low activity: ', hits_in_period, ' hits in period — may be declining')
             WHEN {O.in_list('category', C.COMMONLY_ATTACKED)} THEN 'No hits in analysis period (commonly-attacked category)'
             ELSE 'No hits in analysis period' END AS reason FROM k_rules"""),
)


def staleness(spark, d):
    return G.rule_staleness(view(spark, d, "rules"), E.hits_by_class(clean(spark, d)))


add("rule_staleness", lambda s, d: staleness(s, d), O.over_sanitized("SELECT * FROM stale", "rules", ctes=STALE))
add("staleness_summary", lambda s, d: G.staleness_summary(staleness(s, d)), O.over_sanitized("""
SELECT count(*) AS total_rules, count(*) FILTER (WHERE recommendation = 'keep') AS active_rules,
  count(*) FILTER (WHERE recommendation = 'review') AS stale_rules, count(*) FILTER (WHERE recommendation = 'monitor') AS monitor_rules FROM stale""",
    "rules", ctes=STALE))


def category_coverage(spark, d):
    listed = spark.createDataFrame([(n,) for n, _ in C.PATH_CLASSES], "path_class string")
    return G.category_coverage(view(spark, d, "rules"), listed)


_LISTED = ", ".join(f"({O.q(n)})" for n, _ in C.PATH_CLASSES)
add("category_coverage", category_coverage, with_views(f"""
SELECT host, count(DISTINCT c) FILTER (WHERE c IN (SELECT n FROM (VALUES {_LISTED}) v(n))) AS covered,
  round(CAST(count(DISTINCT c) FILTER (WHERE c IN (SELECT n FROM (VALUES {_LISTED}) v(n))) AS DOUBLE) / {len(C.PATH_CLASSES)}, 6) AS coverage
FROM (SELECT host, unnest({_CLASSES}) AS c FROM rules) x GROUP BY 1""", "rules"))


def annotate_rules(spark, d):
    found = extracted(spark, d)
    aged = G.rule_staleness(found, E.hits_by_class(clean(spark, d)))
    lines = G.lines_of(view(spark, d, "config_files"))
    return K.annotate_rules(lines, aged, "2026-02-01")


_CLASSES_X = _CLASSES.replace("category", "x.category")
add("annotate_rules", annotate_rules, O.over_sanitized(f"""
SELECT l.file_id, l.line_number, part, text FROM (
  SELECT file_id, line_number, CAST(1 AS BIGINT) AS part, raw AS text FROM c_lines c WHERE NOT (line LIKE '# aging:%' AND EXISTS
    (SELECT 1 FROM extracted x WHERE x.file_id = c.file_id AND x.line_number = c.line_number + 1))
  UNION ALL
  SELECT x.file_id, x.line_number, 0, concat('# aging: hits=', CAST(coalesce((SELECT sum(hits) FROM k_hits h WHERE list_contains({_CLASSES_X}, h.path_class)), 0) AS BIGINT),
    ', last-analyzed=2026-02-01') FROM extracted x) l""", "config_files", ctes=EXTRACTED + STALE[:1]))

# --- outputs -----------------------------------------------------------------------------------


def write_events(spark, d):
    """What the event sink has written, read back per day partition."""
    folder = new_folder(spark, "events")
    K.write_events(E.dedup_events(clean(spark, d)), folder)
    return spark.read.parquet(folder).withColumn("dt", F.col("dt").cast("string")).groupBy("dt", "path_class").agg(
        F.count(F.lit(1)).alias("events"), F.sum("count").alias("hits"))


add("write_events", write_events, O.over_sanitized("""
SELECT substr(timestamp, 1, 10) AS dt, path_class, count(*) AS events, CAST(sum(count) AS BIGINT) AS hits FROM deduped GROUP BY 1, 2""", ctes=DEDUP))


def write_event_batches(spark, d):
    """Three micro-batches by the streaming sink, one of them tried twice and one run again with other rows."""
    folder, events = new_folder(spark, "batches"), materialize(E.dedup_events(clean(spark, d)))
    part = lambda n: events.where(F.col("ord") % 3 == n)
    for n in (0, 1, 2):
        with_day(part(n)).limit(5).withColumn("batch", F.lit(n).cast("bigint")).write.mode("append").partitionBy("dt", "batch").parquet(f"{folder}/data")
        B.write_event_batch(part(n), n, folder)
    B.write_event_batch(part(0), 1, folder)
    return B.read_batches(spark, folder).withColumn("dt", F.col("dt").cast("string")).groupBy("dt", "path_class").agg(
        F.count(F.lit(1)).alias("events"), F.sum("count").alias("hits"))


add("write_event_batches", write_event_batches, O.over_sanitized("""
SELECT substr(timestamp, 1, 10) AS dt, path_class, count(*) AS events, CAST(sum(count) AS BIGINT) AS hits FROM deduped GROUP BY 1, 2""", ctes=DEDUP))


def report_json(spark, d):
    report = K.report_json(G.staleness_summary(staleness(spark, d)), E.hits_by_class(clean(spark, d)))
    field = lambda path: F.get_json_object("report", path)
    return report.select("part", field("$.totals.total_rules").cast("bigint").alias("total_rules"),
                         field("$.row.path_class").alias("path_class"), field("$.row.hits").cast("bigint").alias("hits"))


add("report_json", report_json, O.over_sanitized("""
SELECT CAST(0 AS BIGINT) AS part, count(*) AS total_rules, NULL AS path_class, NULL AS hits FROM stale
UNION ALL SELECT 1, NULL, path_class, hits FROM k_hits""", "rules", ctes=STALE))
