"""Registered queries over governance records and rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import catalog as C
from palisade.functions import sanitize as S
from palisade.operators import governance as G
from palisade.plans import oracle as O
from palisade.plans.fixtures import AS_OF, view, with_views
from palisade.session import new_folder
from palisade.sinks import outputs as K
from palisade.sources import records as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LEARN_AS_OF = "2024-02-05"


def add(name, run, oracle=None):
    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = oracle


# --- records -----------------------------------------------------------------------------------

def _v(f):
    raw = rf"trim(regexp_extract(text, '(?m)^{f}:[ \t]*(.*)$', 1))"
    return f"trim({raw}, '\"')"


def _has(f):
    return f"regexp_matches(text, '(?m)^{f}:')"


def _list(f):
    return rf"regexp_matches(text, '(?m)^{f}:[ \t]*(\[.*\]|(\[\])?\n  - )')"


def _req(fields):
    return [f"CASE WHEN NOT {_has(f)} THEN 'missing:{f}' END" for f in fields]


def _bad(f, ok, code):
    return f"CASE WHEN {_has(f)} AND NOT ({ok}) THEN '{code}:{f}' END"


def _date_ok(f):
    return f"regexp_matches({_v(f)}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND try_cast({_v(f)} AS DATE) IS NOT NULL"


def _d(f):
    return f"CASE WHEN {_date_ok(f)} THEN try_cast({_v(f)} AS DATE) END"


_BOOL = "IN ('true', 'True', 'false', 'False')"
_NUM = "'^[+-]?[0-9]+(\\.[0-9]*)?$'"


def _text_ok(f):
    return f"{_v(f)} <> '' AND NOT {_list(f)} AND NOT regexp_matches({_v(f)}, {_NUM}) AND {_v(f)} NOT {_BOOL}"


EXC = _req(C.EXCEPTION_FIELDS) + [
    _bad("exception_id", f"regexp_matches({_v('exception_id')}, '^EXC-\\d{{4}}$')", "format"),
    _bad("finding_id", f"{_v('finding_id')} LIKE 'NH-%'", "format"),
    _bad("reason", _text_ok("reason"), "empty"), _bad("compensating_control", _text_ok("compensating_control"), "empty"),
    _bad("severity_tier", O.in_list(_v("severity_tier"), C.SEVERITY_TIERS), "enum"), _bad("scope", O.in_list(_v("scope"), C.SCOPES), "enum"),
    *[_bad(f, _date_ok(f), "date") for f in ("created_at", "last_reviewed_at", "review_by")],
    f"CASE WHEN {_d('review_by')} > {_d('created_at')} + 365 THEN 'too_long:review_by' END"]
LEARN = _req(C.LEARNING_FIELDS) + [
    _bad("type", O.in_list(_v("type"), C.LEARNING_TYPES), "enum"), _bad("status", O.in_list(_v("status"), C.LEARNING_STATUSES), "enum"),
    _bad("source", O.in_list(_v("source"), C.LEARNING_SOURCES), "enum"), _bad("discovered", _date_ok("discovered"), "date"),
    _bad("finding_ids", _list("finding_ids"), "type"), _bad("hit_count", f"regexp_matches({_v('hit_count')}, '^[0-9]+$')", "range")]
RECIPE = _req(C.RECIPE_FIELDS) + [
    _bad("name", f"regexp_matches({_v('name')}, '^[a-z0-9]+(-[a-z0-9]+)*$')", "format"), _bad("description", _text_ok("description"), "empty"),
    _bad("profile", O.in_list(_v("profile"), C.PROFILES), "enum"),
    _bad("execution_class", f"regexp_matches({_v('execution_class')}, '^[RWX]\\d(\\+[RWX]\\d)*$')", "format"),
    *[_bad(f, f"{_v(f)} {_BOOL}", "type") for f in ("requires_network", "requires_remote_exec", "allows_emergency_mode")],
    *[_bad(f, _list(f), "type") for f in ("required_env_vars", "confirmation_checkpoints", "outputs", "steps")],
    f"CASE WHEN {_v('steps')} = '[]' THEN 'empty:steps' END",
    _bad("max_privilege_level", O.in_list(_v("max_privilege_level"), C.PRIVILEGES), "enum"),
    _bad("schedule_mode", O.in_list(_v("schedule_mode"), C.SCHEDULES), "enum")]
FIND = _req(C.FINDING_FIELDS) + [
    _bad("finding_id", f"regexp_matches({_v('finding_id')}, '^NH-(AUDIT|LOG|IOC)-[A-Z]+-\\d{{4,}}$')", "format"),
    _bad("category", _text_ok("category"), "empty"), _bad("severity", O.in_list(_v("severity"), C.SEVERITY_ORDER), "enum"),
    _bad("confidence", f"coalesce(try_cast({_v('confidence')} AS DOUBLE) BETWEEN 0 AND 1, false)", "range"),
    _bad("source_layers", _list("source_layers"), "type"), _bad("scope", O.in_list(_v("scope"), C.SCOPES), "enum"),
    _bad("blast_radius", O.in_list(_v("blast_radius"), C.RADIUS_ORDER), "enum"), _bad("recommended_action", _text_ok("recommended_action"), "empty"),
    _bad("rule_class", O.in_list(_v("rule_class"), ["A", "B", "C", "D"]), "enum"),
    *[_bad(f, f"{_v(f)} {_BOOL}", "type") for f in ("requires_live_test", "exception_eligible")],
    _bad("linked_artifacts", _list("linked_artifacts"), "type")]


def _validator(kind, checks, source):
    sql = f"SELECT ord, errors = '' AS valid, errors FROM (SELECT ord, concat_ws(',', {', '.join(checks)}) AS errors FROM {source}) x"
    add(f"validate_{kind}s", lambda s, d: G.validate(view(s, d, source), kind).select(
        "ord", "valid", F.array_join("errors", ",").alias("errors")), with_views(sql, source))
    return sql


EXC_SQL = _validator("exception", EXC, "exception_records")
_validator("learning", LEARN, "learning_records")
_validator("recipe", RECIPE, "recipe_records")
_validator("finding", FIND, "finding_records")


def cross_rules(spark, d):
    out = None
    for kind, source in (("exception", "exception_records"), ("finding", "finding_records"), ("recipe", "recipe_records"), ("recipe", "step_recipes")):
        one = (G.validate(view(spark, d, source), kind, strict=True)
               .select(F.explode(F.filter("errors", lambda e: e.startswith("cross:"))).alias("rule"))
               .groupBy("rule").agg(F.count(F.lit(1)).alias("records")).withColumn("source", F.lit(source)))
        out = one if out is None else out.unionByName(one)
    return out


# Nested recipes have two steps; of a step's equal keys the last counts.
STEPS = (
    ("st_read", r"""SELECT *, regexp_extract_all(text, '(?m)^  (?:- |  )action: "?([a-z-]+)', 1) AS acts,
        regexp_matches(text, '(?m)^      reload_nginx: true') AS reloads, regexp_matches(text, '(?m)^      rule_class: A$') AS class_a FROM step_recipes"""),
    ("st_two", "SELECT *, acts[1] AS first_act, acts[len(acts)] AS act FROM st_read"),
    ("st_need", """SELECT *, CASE WHEN act = 'deploy' AND reloads THEN 5 WHEN act = 'deploy' THEN 4 WHEN act = 'sync-repos' THEN 3
        WHEN act IN ('check-ioc-feeds', 'compact-learnings') THEN 2 ELSE 1 END AS need,
        list_position(['R0', 'R1', 'W1', 'W2', 'X1'], regexp_extract(text, 'max_privilege_level: (..)', 1)) AS allowed FROM st_two"""),
)
add("cross_rules", cross_rules, with_views(f"""
SELECT rule, source, count(*) AS records FROM (
  SELECT 'cross:reviewed_before_created' AS rule, 'exception_records' AS source FROM exception_records WHERE {_d('last_reviewed_at')} < {_d('created_at')}
  UNION ALL SELECT 'cross:global_needs_critical', 'exception_records' FROM exception_records WHERE {_v('scope')} = 'global' AND {_v('severity_tier')} <> 'critical'
  UNION ALL SELECT 'cross:needs_live_test', 'finding_records' FROM finding_records WHERE {_v('blast_radius')} = 'unknown-shared' AND {_v('requires_live_test')} <> 'true'
  UNION ALL SELECT 'cross:needs_checkpoints', 'recipe_records' FROM recipe_records WHERE regexp_matches({_v('execution_class')}, '[WX]')
    AND {_v('confirmation_checkpoints')} = '[]' AND {_v('schedule_mode')} = 'manual'
  UNION ALL SELECT unnest(['cross:step_action', 'cross:emergency_class']), 'recipe_records' FROM recipe_records WHERE contains(text, 'steps:' || chr(10))
  UNION ALL SELECT 'cross:step_privilege', 'step_recipes' FROM st_need WHERE need > allowed
  UNION ALL SELECT 'cross:step_action', 'step_recipes' FROM st_need WHERE act = 'dance'
  UNION ALL SELECT 'cross:env_values', 'step_recipes' FROM st_need WHERE contains(text, 'TOKEN=')
  UNION ALL SELECT 'cross:no_outputs', 'step_recipes' FROM st_need WHERE contains(text, 'outputs: []')
  UNION ALL SELECT 'cross:emergency_class', 'step_recipes' FROM st_need WHERE contains(text, 'emergency_mode: true')
    AND (act IN ('sync-repos', 'dance') OR (act = 'deploy' AND NOT class_a))) x GROUP BY 1, 2""",
    "exception_records", "finding_records", "recipe_records", "step_recipes", ctes=STEPS))


def recipe_steps(spark, d):
    steps = R.record_fields(view(spark, d, "step_recipes"), ["steps"], nested=True).select(
        "ord", "parse_errors", F.posexplode(R.item_maps("f_steps.items")).alias("at", "m"))
    of = lambda k: F.array_join(F.try_element_at("m", F.lit(k)), ",").alias(k.removeprefix("params."))
    return steps.select("ord", (F.col("at") + 1).cast("bigint").alias("step"), F.size("parse_errors").cast("bigint").alias("strays"), of("action"), *[
        of(f"params.{k}") for k in ("log_dir", "lookback_hours", "feed_urls", "match_fields", "reload_nginx", "rule_class")])


def _step_param(k):
    return f"nullif(trim(regexp_extract(piece, '(?m)^      {k}: *(.*)$', 1), '\"'), '') AS {k}"


add("recipe_steps", recipe_steps, with_views(rf"""
SELECT ord, CAST(step AS BIGINT) AS step, CAST(0 AS BIGINT) AS strays,
  CASE WHEN contains(piece, chr(10) || '    action: ') THEN regexp_extract(piece, '(?m)^    action: (.*)$', 1) ELSE trim(regexp_extract(piece, '^action: (\S+)', 1), '"') END AS action,
  {_step_param('log_dir')}, {_step_param('lookback_hours')}, {_step_param('reload_nginx')}, {_step_param('rule_class')},
  nullif(array_to_string(list_transform(regexp_extract_all(piece, '(?m)^        - (.*)$', 1), lambda x: trim(x, '"')), ','), '') AS feed_urls,
  replace(nullif(regexp_extract(piece, 'match_fields: \[(.*)\]', 1), ''), ', ', ',') AS match_fields
FROM (SELECT ord, unnest(pieces[2:]) AS piece, unnest(range(1, len(pieces))) AS step FROM (
  SELECT ord, string_split(split_part(split_part(text, 'steps:' || chr(10), 2), chr(10) || 'outputs', 1), '  - ') AS pieces_raw,
    string_split(regexp_replace(chr(10) || split_part(split_part(text, 'steps:' || chr(10), 2), chr(10) || 'outputs', 1), '(?m)^  - ', '@@', 'g'), '@@') AS pieces
  FROM step_recipes) a) b""", "step_recipes"))
add("read_records", lambda s, d: R.key_values(R.parse_frontmatter(view(s, d, "recipe_records")), "ord"), with_views(rf"""
SELECT ord, key, CASE WHEN list THEN 'list' WHEN raw {_BOOL} THEN 'bool' ELSE 'string' END AS kind,
  CASE WHEN list AND raw LIKE '[%' AND raw <> '[]' THEN replace(trim(raw, '[]'), ', ', ',') WHEN raw = '[]' THEN ''
       WHEN list THEN array_to_string(regexp_extract_all(regexp_extract(text, concat('(?m)^', key, ':[ ]*((\n  - .*)+)'), 1), '  - (.*)', 1), ',') ELSE raw END AS value
FROM (SELECT ord, text, key, trim(regexp_extract(text, concat('(?m)^', key, ':[ ]*(.*)$'), 1)) AS raw,
        regexp_matches(text, concat('(?m)^', key, ':[ ]*(\[.*\]|\n  - )')) AS list
      FROM (SELECT ord, text, unnest(regexp_extract_all(text, '(?m)^([a-z_]+):', 1)) AS key FROM recipe_records) a) b""", "recipe_records"))

# --- exceptions --------------------------------------------------------------------------------

STATES = (
    ("x_new", "SELECT * FROM exceptions QUALIFY row_number() OVER (PARTITION BY exception_id ORDER BY last_reviewed_at DESC, ord DESC) = 1"),
    ("x_days", f"SELECT *, CAST(date_diff('day', DATE '{AS_OF}', try_cast(review_by AS DATE)) AS BIGINT) AS days_left FROM x_new"),
    ("x_state", """SELECT *, CASE WHEN days_left IS NULL THEN 'invalid' WHEN days_left < 0 THEN 'expired' WHEN days_left <= CASE severity_tier WHEN 'critical' THEN 90 WHEN 'high' THEN 60 ELSE 30 END THEN 'expiring'
        ELSE 'active' END AS state FROM x_days"""),
)
add("exception_state", lambda s, d: G.exception_state(view(s, d, "exceptions"), AS_OF),
    with_views("SELECT *, state = 'expired' AND severity_tier = 'critical' AS blocks FROM x_state", "exceptions", ctes=STATES))
add("exception_suppress", lambda s, d: G.exception_suppress(view(s, d, "findings"), view(s, d, "exceptions"), "2000-06-01").select("ord", "finding_id"),
    with_views("""SELECT ord, finding_id FROM findings f WHERE NOT EXISTS (SELECT 1 FROM (
        SELECT *, row_number() OVER (PARTITION BY exception_id ORDER BY last_reviewed_at DESC, ord DESC) AS version FROM exceptions) e
      WHERE e.version = 1 AND e.finding_id = f.finding_id AND try_cast(e.review_by AS DATE) >= DATE '2000-06-01' AND e.target_kind = 'finding')""",
      "findings", "exceptions"))
add("validation_rollup", lambda s, d: G.validation_rollup(
        G.validate(view(s, d, "exception_records"), "exception"), G.exception_state(view(s, d, "exceptions"), AS_OF)),
    with_views(f"""SELECT count(*) AS total, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE NOT valid) AS invalid,
      (SELECT count(*) FROM x_state WHERE state = 'expired') AS expired, (SELECT count(*) FROM x_state WHERE state = 'expiring') AS expiring
      FROM ({EXC_SQL}) v""", "exception_records", ctes=STATES))

# --- findings ----------------------------------------------------------------------------------


def _candidates(spark, d):
    return view(spark, d, "findings").select("ord", F.split("finding_id", "-")[1].alias("source"),
                                             F.split("finding_id", "-")[2].alias("category"))


add("finding_id_assign", lambda s, d: G.finding_id_assign(_candidates(s, d), view(s, d, "exceptions").select("finding_id")),
    with_views("""SELECT ord, source, category, concat('NH-', source, '-', category, '-', CASE WHEN k < 10000 THEN lpad(CAST(k AS VARCHAR), 4, '0') ELSE CAST(k AS VARCHAR) END) AS finding_id
      FROM (SELECT c.*, row_number() OVER (PARTITION BY c.source, c.category ORDER BY ord) + coalesce(top, 0) AS k
        FROM (SELECT ord, split_part(finding_id, '-', 2) AS source, split_part(finding_id, '-', 3) AS category FROM findings) c
        LEFT JOIN (SELECT split_part(finding_id, '-', 2) AS source, split_part(finding_id, '-', 3) AS category, max(CAST(split_part(finding_id, '-', 4) AS BIGINT)) AS top
          FROM exceptions WHERE length(split_part(finding_id, '-', 4)) >= 4 GROUP BY 1, 2) t ON t.source = c.source AND t.category = c.category) x""", "findings", "exceptions"))

TRACE = (
    ("t_lines", """SELECT file, text, unnest(string_split(text, chr(10))) AS line_text, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS line FROM notes"""),
    ("t_refs", r"""SELECT DISTINCT unnest(regexp_extract_all(line_text, 'NH-[A-Z]+-[A-Z_]+-[0-9][0-9][0-9][0-9][0-9]*')) AS finding_id, file, text, CAST(line AS BIGINT) AS line,
        substr(trim(line_text), 1, 200) AS context FROM t_lines"""),
)
add("finding_trace", lambda s, d: G.finding_trace(view(s, d, "notes")),
    with_views("SELECT finding_id, file, line, context FROM t_refs", "notes", ctes=TRACE))


def _words(stage):
    return "bool_or(" + " OR ".join(f"contains(lower(text), '{w}')" for w in C.STAGE_KEYWORDS[stage]) + ")"


add("lifecycle_status", lambda s, d: G.lifecycle_status(view(s, d, "notes")), with_views(f"""
SELECT finding_id, CASE WHEN {_words('promoted')} THEN 'promoted' WHEN {_words('deployed')} THEN 'deployed' WHEN {_words('staged')} THEN 'staged' ELSE 'discovered' END AS lifecycle,
  substr(min(file), 9, 10) AS day, count(*) AS references FROM t_refs GROUP BY 1""".replace("AS references", 'AS "references"'), "notes", ctes=TRACE))
add("finding_rollup", lambda s, d: G.finding_rollup(view(s, d, "findings")), with_views("""
SELECT coalesce(severity, '(all)') AS severity, coalesce(blast_radius, '(all)') AS blast_radius, count(*) AS findings FROM findings GROUP BY ROLLUP (severity, blast_radius)""", "findings"))
add("auto_accept", lambda s, d: G.auto_accept(view(s, d, "findings"), "low").select("ord", "severity"),
    with_views("SELECT ord, severity FROM findings WHERE severity IN ('low', 'info')", "findings"))
_ALLOWED = " OR ".join(f"(profile = '{p}' AND {O.in_list('rule_class', cs)})" for p, cs in C.PROFILE_RULE_CLASSES.items())
add("profile_allowed", lambda s, d: G.profile_allowed(view(s, d, "findings")).groupBy("profile", "rule_class").agg(F.count(F.lit(1)).alias("findings")),
    with_views(f"""SELECT profile, rule_class, count(*) AS findings FROM findings, (VALUES {', '.join(f"('{p}')" for p in C.PROFILES)}) v(profile)
      WHERE {_ALLOWED} GROUP BY 1, 2""", "findings"))
add("change_order", lambda s, d: G.change_order(view(s, d, "findings").groupBy("target_file", "blast_radius").agg(F.count(F.lit(1)).alias("changes"))),
    with_views(f"""SELECT target_file, blast_radius, count(*) AS changes, dense_rank() OVER (PARTITION BY target_file
      ORDER BY {O.ordinal('blast_radius', C.RADIUS_ORDER)}) AS step FROM findings GROUP BY 1, 2""", "findings"))
add("new_since_last_run", lambda s, d: G.new_since_last_run(view(s, d, "findings").withColumn("k", F.col("ord") % 997), ["category", "k"], "run-2001"),
    with_views("""SELECT category, k, CASE WHEN EXISTS (SELECT 1 FROM findings h WHERE h.run_id < 'run-2001' AND h.category = c.category AND h.ord % 997 = c.k)
      THEN 'resurfaced' ELSE 'new' END AS status FROM (SELECT DISTINCT category, ord % 997 AS k FROM findings WHERE run_id = 'run-2001') c""", "findings"))
add("rule_class", lambda s, d: view(s, d, "actions").select("ord", S.rule_class(F.col("action")).alias("value")), with_views("""
SELECT ord, CASE WHEN action LIKE '%deny%' OR action LIKE 'Rate limit%' THEN 'A' WHEN action LIKE '%method%' OR action LIKE '%body_size%' THEN 'B'
  WHEN action LIKE '%header%' OR action LIKE '%ssl_%' THEN 'C' ELSE 'D' END AS value FROM actions""", "actions"))
add("finding_family", lambda s, d: view(s, d, "findings").groupBy(S.finding_family(F.col("category")).alias("family")).agg(F.count(F.lit(1)).alias("findings")),
    with_views(f"SELECT {O.lookup('category', C.FINDING_FAMILIES, O.q(C.DEFAULT_FAMILY))} AS family, count(*) AS findings FROM findings GROUP BY 1", "findings"))

# --- learnings ---------------------------------------------------------------------------------

COMPACT = (
    ("l_rest", f"SELECT * FROM learnings WHERE status <> 'promoted' AND NOT (status = 'draft' AND coalesce(try_cast(discovered AS DATE) < DATE '{LEARN_AS_OF}' - 30, false))"),
    ("compacted", """SELECT concat('merged-', path_class) AS learning_id, path_class, CAST(sum(hit_count) AS BIGINT) AS hit_count, min(discovered) AS discovered,
          max(last_seen) AS last_seen, count(*) AS merged, array_to_string(list_slice(list_sort(list_distinct(list(source_ip))), 1, 50), ',') AS source_ips, 'merged' AS action
        FROM l_rest GROUP BY path_class
        UNION ALL SELECT learning_id, path_class, hit_count, discovered, last_seen, 1, source_ip,
          CASE status WHEN 'promoted' THEN 'kept' ELSE 'archived' END FROM learnings WHERE learning_id NOT IN (SELECT learning_id FROM l_rest)"""),
)


def compacted(s, d):
    return G.learning_compact(view(s, d, "learnings"), LEARN_AS_OF)


add("learning_compact", compacted, with_views("SELECT * FROM compacted", "learnings", ctes=COMPACT))
add("learning_addresses", lambda s, d: G.learning_addresses(view(s, d, "learnings"), LEARN_AS_OF), with_views("""
SELECT path_class, source_ip, row_number() OVER (PARTITION BY path_class ORDER BY source_ip) <= 50 AS shown
FROM (SELECT DISTINCT path_class, source_ip FROM l_rest) x""", "learnings", ctes=COMPACT))
add("compaction_record", lambda s, d: G.compaction_record(view(s, d, "learnings"), compacted(s, d)), with_views("""
SELECT (SELECT count(*) FROM learnings) AS rows_before, count(*) FILTER (WHERE action <> 'archived') AS rows_after,
  CAST(coalesce(sum(merged) FILTER (WHERE action = 'merged'), 0) AS BIGINT) AS merged, count(*) FILTER (WHERE action = 'kept') AS kept,
  count(*) FILTER (WHERE action = 'archived') AS archived FROM compacted""", "learnings", ctes=COMPACT))
add("compaction_check", lambda s, d: G.compaction_check(view(s, d, "learnings"), compacted(s, d), LEARN_AS_OF), with_views(f"""
SELECT b.path_class, hits_before, first_before, hits_after, first_after, hits_before = hits_after AND first_before = first_after AS ok FROM
  (SELECT path_class, CAST(sum(hit_count) AS BIGINT) AS hits_before, min(discovered) AS first_before FROM learnings
   WHERE NOT (status = 'draft' AND coalesce(try_cast(discovered AS DATE) < DATE '{LEARN_AS_OF}' - 30, false)) GROUP BY 1) b
  JOIN (SELECT path_class, CAST(sum(hit_count) AS BIGINT) AS hits_after, min(discovered) AS first_after FROM compacted WHERE action <> 'archived' GROUP BY 1) a USING (path_class)""",
    "learnings", ctes=COMPACT))
add("learning_rollup", lambda s, d: G.learning_rollup(view(s, d, "learnings")), with_views("""
SELECT type, status, count(*) AS learnings, CAST(sum(hit_count) AS BIGINT) AS hits, max(last_seen) AS last_seen FROM learnings GROUP BY 1, 2""", "learnings"))


def promote_learnings(s, d):
    rows = view(s, d, "learnings")
    return G.promote_learnings(rows, rows.where("rule_tag IS NOT NULL").select("learning_id"),
                               rows.where("hit_count > 25").select("learning_id")).select("learning_id", "status", "next_status", "refused")


add("promote_learnings", promote_learnings, with_views("""
SELECT learning_id, status, CASE WHEN status = 'active' AND hit_count > 25 THEN 'promoted' WHEN status = 'draft' AND rule_tag IS NOT NULL THEN 'active'
  ELSE status END AS next_status, status = 'draft' AND hit_count > 25 AS refused FROM learnings""", "learnings"))


def changelog(s, d):
    rows = view(s, d, "changelog")
    return G.changelog_append_only(rows.where("version = 'old'"), rows.where("version = 'new'"))


add("changelog_append_only", changelog, with_views("""
SELECT line, count(*) AS missing FROM (SELECT line FROM changelog WHERE version = 'old' EXCEPT ALL SELECT line FROM changelog WHERE version = 'new') x GROUP BY 1""", "changelog"))


def append_changelog(s, d):
    """Two runs append to one log; the log read back has the lines of both."""
    folder, rows = new_folder(s, "changelog"), view(s, d, "changelog")
    for version in ("old", "new"):
        K.append_changelog(rows.where(F.col("version") == version).select("entry_no", "line"), folder)
    return s.read.parquet(folder).groupBy("line").agg(F.count(F.lit(1)).alias("entries"))


add("append_changelog", append_changelog, with_views("SELECT line, count(*) AS entries FROM changelog GROUP BY 1", "changelog"))

# --- rollouts ----------------------------------------------------------------------------------

add("rollout_outcome", lambda s, d: G.rollout_outcome(view(s, d, "host_checks")), with_views("""
SELECT deployment, host, CASE WHEN host_order = first THEN 'canary' ELSE 'follower' END AS role, status,
  CASE WHEN status = 'fail' THEN bad END AS phase, status = 'fail' AS rollback_needed FROM (
  SELECT *, CASE WHEN stop IS NULL OR host_order < stop THEN 'pass' WHEN host_order = stop THEN 'fail' ELSE 'skipped' END AS status FROM (
    SELECT *, min(host_order) OVER (PARTITION BY deployment) AS first, min(CASE WHEN bad IS NOT NULL THEN host_order END) OVER (PARTITION BY deployment) AS stop FROM (
      SELECT deployment, host, host_order, arg_min(check_name, check_order) FILTER (WHERE code <> CASE check_name WHEN 'deny_check' THEN 404 ELSE 200 END) AS bad
      FROM host_checks GROUP BY 1, 2, 3) h) w) x""", "host_checks"))
