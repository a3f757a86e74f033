"""Registered queries over the config fleet."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import catalog as C
from palisade.operators import config as K
from palisade.operators import governance as G
from palisade.operators import ioc as I
from palisade.plans import oracle as O
from palisade.plans.fixtures import AS_OF, BACKUP, PROPOSED, view, with_views
from palisade.plans.governance_queries import EXC_SQL, STATES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name, run, oracle=None):
    QUERIES[name] = run
    if oracle is not None:
        ORACLES[name] = oracle


def files(s, d):
    return view(s, d, "config_files")


def parsed(s, d):
    return K.parse_files(files(s, d))


def pairs(s, d):
    return K.snapshot_pairs(parsed(s, d), BACKUP, PROPOSED)


# Brace positions character by character, depth by running sum, partner = first close at that depth.
def _braces(p: str, column: str):
    return (
        (f"{p}_chars", f"SELECT file_id, pos, substr({column}, pos, 1) AS ch FROM (SELECT file_id, {column}, unnest(range(1, length({column}) + 1)) AS pos FROM c_text) x"),
        (f"{p}_depth", f"SELECT *, sum(CASE ch WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY file_id ORDER BY pos) AS depth FROM {p}_chars WHERE ch IN ('{{', '}}')"),
        (f"{p}_open", f"SELECT file_id, pos AS open, depth, coalesce(lag(pos) OVER (PARTITION BY file_id ORDER BY pos), 0) AS head_from FROM {p}_depth WHERE ch = '{{'"),
        (f"{p}_pair", f"SELECT o.*, c.close FROM {p}_open o JOIN (SELECT o2.file_id, o2.open, min(c2.pos) AS close FROM {p}_open o2 JOIN {p}_depth c2 "
                      f"ON c2.file_id = o2.file_id AND c2.ch = '}}' AND c2.pos > o2.open AND c2.depth = o2.depth - 1 GROUP BY 1, 2) c ON c.file_id = o.file_id AND c.open = o.open"),
        (f"{p}_head", f"SELECT b.*, t.host, t.path, t.snapshot_id, t.{column} AS src, substr(t.{column}, head_from + 1, open - head_from - 1) AS head FROM {p}_pair b JOIN c_text t ON t.file_id = b.file_id"),
        (f"{p}_locs0", rf"""SELECT *, trim(regexp_extract(head, '(?s)location\s+(.*)$', 1), ' ' || chr(10) || chr(9)) AS expr,
            substr(src, 1, head_from + length(regexp_extract(head, '(?s)^(.*?)location\s', 1))) AS upto,
            trim(substr(src, open + 1, close - open - 1), ' ' || chr(10) || chr(9)) AS body FROM {p}_head WHERE regexp_matches(head, 'location\s')"""),
        (f"{p}_locs", rf"""SELECT *, CAST(1 + length(upto) - length(replace(upto, chr(10), '')) AS BIGINT) AS line,
            CASE WHEN regexp_matches(expr, '(?s)^(=|~|~\*|\^~)\s+\S') THEN regexp_extract(expr, '^(\S+)', 1) ELSE '' END AS modifier,
            CASE WHEN regexp_matches(expr, '(?s)^(=|~|~\*|\^~)\s+\S') THEN regexp_extract(expr, '(?s)^\S+\s+(.*)$', 1) ELSE expr END AS location FROM {p}_locs0"""),
        (f"{p}_servers", rf"""SELECT *, substr(src, open + 1, close - open - 1) AS body FROM {p}_head WHERE regexp_matches(head, '\bserver\s*$')"""),
    )


TEXT = (("c_text", r"""SELECT *, regexp_replace(regexp_replace(text, '(?m)^[ \t]*#.*\n?', '', 'g'), '(?m)[ \t]+#.*$', '', 'g') AS clean FROM config_files"""),)
CLEAN = TEXT + _braces("b", "clean")
RAW = TEXT + _braces("r", "text")


def over(body, *ctes):
    return with_views(body, "config_files", ctes=tuple(ctes))


ID = "f.file_id, f.host, f.path, f.snapshot_id"


def _check(name, issues, status="CASE WHEN i.n > 0 THEN 'fail' ELSE 'pass' END"):
    """All files against their issues: (file_id, issue) rows."""
    return f"""SELECT {ID}, '{name}' AS check_name, {status} AS status, coalesce(i.detail, '') AS detail FROM c_text f
      LEFT JOIN (SELECT file_id, count(*) AS n, string_agg(issue, '; ' ORDER BY issue) AS detail FROM ({issues}) q GROUP BY 1) i ON i.file_id = f.file_id"""


WARN = "CASE WHEN i.n > 0 THEN 'warn' ELSE 'pass' END"
DENY = O.q(K.DENY)
BLOCKING = O.q(K.BLOCKING)

add("extract_blocks", lambda s, d: K.extract_blocks(parsed(s, d)),
    over("SELECT file_id, host, path, snapshot_id, line, expr, modifier, location, body FROM b_locs", *CLEAN))

# --- invariants --------------------------------------------------------------------------------

_BLOCKED = f"SELECT DISTINCT host, path, snapshot_id, expr AS pattern FROM r_locs WHERE regexp_matches(body, {BLOCKING})"
_REMOVED = f"""SELECT host, path, pattern FROM ({_BLOCKED}) o WHERE snapshot_id = '{BACKUP}' AND NOT EXISTS
  (SELECT 1 FROM ({_BLOCKED}) n WHERE n.snapshot_id = '{PROPOSED}' AND n.host = o.host AND n.path = o.path AND n.pattern = o.pattern)"""
add("rules_removed", lambda s, d: K.rules_removed(parsed(s, d), BACKUP, PROPOSED), over(_REMOVED, *RAW))
_ADDITIVE = f"""SELECT p.host, p.path, 'additive_only' AS check_name, CASE WHEN r.detail IS NOT NULL OR w.detail IS NOT NULL THEN 'fail' ELSE 'pass' END AS status,
    coalesce(r.detail, w.detail, '') AS detail FROM (SELECT DISTINCT host, path FROM c_text) p
  LEFT JOIN (SELECT host, path, string_agg(concat('removed: ', pattern), '; ' ORDER BY pattern) AS detail FROM ({_REMOVED}) x GROUP BY 1, 2) r ON r.host = p.host AND r.path = p.path
  LEFT JOIN (SELECT o.host, o.path, string_agg(concat('weakened: ', o.pattern), '; ' ORDER BY o.pattern) AS detail FROM ({_BLOCKED}) o
    JOIN (SELECT host, path, expr, arg_max(body, open) AS body FROM r_locs WHERE snapshot_id = '{PROPOSED}' GROUP BY 1, 2, 3) n
      ON n.host = o.host AND n.path = o.path AND n.expr = o.pattern WHERE o.snapshot_id = '{BACKUP}' AND NOT regexp_matches(n.body, {BLOCKING}) GROUP BY 1, 2) w
    ON w.host = p.host AND w.path = p.path"""
add("inv_additive", lambda s, d: K.inv_additive(pairs(s, d)), over(_ADDITIVE, *RAW))
_NEGATION = _check("no_regex_negation", rf"""
  SELECT file_id, concat('negated: ', expr) AS issue FROM r_locs WHERE contains(expr, '!~')
  UNION ALL SELECT file_id, concat('lookahead: ', expr) FROM r_locs WHERE contains(expr, '(?!')
  UNION ALL SELECT file_id, concat('proxy_pass: ', expr) FROM r_locs WHERE regexp_matches(body, {BLOCKING}) AND regexp_matches(body, '\bproxy_pass\b')
  UNION ALL SELECT file_id, concat('return 200: ', expr) FROM r_locs WHERE regexp_matches(body, {BLOCKING}) AND regexp_matches(body, '\breturn\s+200\b')
  UNION ALL SELECT file_id, concat('rewrite: ', expr) FROM r_locs WHERE regexp_matches(body, {BLOCKING}) AND regexp_matches(body, '\brewrite\b')""")
add("inv_no_negation", lambda s, d: K.inv_no_negation(parsed(s, d)), over(_NEGATION, *RAW))


def _header(text, h):
    return f"list_last(regexp_extract_all({text}, 'add_header\\s+{h}\\s+\"([^\"]*)\"', 1))"


_PAIR = (("pair", f"""SELECT host, path, coalesce(max(text) FILTER (snapshot_id = '{BACKUP}'), '') AS old_text,
    coalesce(max(text) FILTER (snapshot_id = '{PROPOSED}'), '') AS new_text FROM config_files GROUP BY 1, 2"""),
  ("headers", " UNION ALL ".join(f"""SELECT host, path, '{h}' AS header, {_header('old_text', h)} AS old_value, {_header('new_text', h)} AS new_value FROM pair"""
                                 for h in C.REQUIRED_HEADERS)),
  ("header_state", "SELECT *, CASE WHEN new_value IS NULL THEN 'missing' WHEN old_value <> new_value THEN 'changed' ELSE 'kept' END AS state FROM headers"))
add("headers_changed", lambda s, d: K.headers_changed(pairs(s, d)), over("SELECT * FROM header_state", *_PAIR))
_INV_HEADERS = """SELECT host, path, 'headers_immutable' AS check_name, CASE WHEN bool_or(state <> 'kept') THEN 'fail' ELSE 'pass' END AS status,
  coalesce(string_agg(concat('missing: ', header), '; ' ORDER BY header) FILTER (WHERE state = 'missing'),
           string_agg(concat('changed: ', header), '; ' ORDER BY header) FILTER (WHERE state = 'changed'), '') AS detail FROM header_state GROUP BY 1, 2"""
add("inv_headers", lambda s, d: K.inv_headers(pairs(s, d)), over(_INV_HEADERS, *_PAIR))
_TLS = _check("tls_floor", r"""
  SELECT file_id, p AS issue FROM (SELECT file_id, unnest(string_split(trim(regexp_extract(text, '(?m)^[ \t]*ssl_protocols[ \t]+([^;\n]+);', 1)), ' ')) AS p FROM c_text) x
  WHERE p IN ('TLSv1', 'TLSv1.1')""")
add("inv_tls_floor", lambda s, d: K.inv_tls_floor(files(s, d)), over(_TLS, *TEXT))
add("inv_destructive_git", lambda s, d: K.inv_destructive_git(view(s, d, "commands")).select("ord", "command", "status"), with_views(f"""
SELECT ord, command, CASE WHEN {' OR '.join(O.hit('command', p) for p in C.DESTRUCTIVE_GIT)} THEN 'fail' ELSE 'pass' END AS status FROM commands""", "commands"))

_DIFF = (("d_lines", "SELECT DISTINCT host, path, snapshot_id, unnest(string_split(text, chr(10))) AS line FROM config_files"),
         ("d_diff", f"""SELECT host, path, line, 'removed' AS side FROM (SELECT host, path, line FROM d_lines WHERE snapshot_id = '{BACKUP}'
             EXCEPT SELECT host, path, line FROM d_lines WHERE snapshot_id = '{PROPOSED}') a
           UNION ALL SELECT host, path, line, 'added' FROM (SELECT host, path, line FROM d_lines WHERE snapshot_id = '{PROPOSED}'
             EXCEPT SELECT host, path, line FROM d_lines WHERE snapshot_id = '{BACKUP}') b"""))
add("line_diff", lambda s, d: K.line_diff(files(s, d), BACKUP, PROPOSED), over("SELECT * FROM d_diff", *_DIFF))
_SCOPE = r"""SELECT p.host, p.path, 'scope_check' AS check_name, CASE WHEN scope IN ('exact-location', 'server-block') THEN 'pass' ELSE 'warn' END AS status, scope AS detail FROM (
  SELECT f.host, f.path, CASE WHEN count(line) = 0 THEN 'exact-location' WHEN bool_or(regexp_matches(line, '\bssl_')) THEN 'server-block'
    WHEN bool_or(regexp_matches(line, '\blocation\b')) AND NOT bool_or(regexp_matches(line, '\badd_header\b')) THEN 'exact-location' ELSE 'include-file' END AS scope
  FROM (SELECT DISTINCT host, path FROM config_files) f LEFT JOIN d_diff d ON d.host = f.host AND d.path = f.path GROUP BY 1, 2) p"""
add("inv_scope", lambda s, d: K.inv_scope(pairs(s, d)), over(_SCOPE, *_DIFF))
add("file_scope", lambda s, d: files(s, d).select("file_id", K.file_scope(F.col("text")).alias("scope")), over(r"""
SELECT file_id, CASE WHEN regexp_matches(text, '\bhttp\s*\{') THEN 'global-http' WHEN regexp_matches(text, '\bserver\s*\{') THEN 'server-block' ELSE 'include-file' END AS scope FROM config_files"""))
add("snapshot_churn", lambda s, d: K.snapshot_churn(files(s, d)), over(f"""
SELECT host, path, '{PROPOSED}' AS snapshot_id, CAST(sum(CASE WHEN n > 0 THEN n ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN n < 0 THEN -n ELSE 0 END) AS BIGINT) AS removed
FROM (SELECT host, path, line, sum(CASE snapshot_id WHEN '{PROPOSED}' THEN 1 ELSE -1 END) AS n
  FROM (SELECT host, path, snapshot_id, unnest(string_split(text, chr(10))) AS line FROM config_files c
        WHERE (SELECT count(*) FROM config_files o WHERE o.host = c.host AND o.path = c.path) = 2) l GROUP BY 1, 2, 3) x GROUP BY 1, 2"""))
add("latest_snapshot", lambda s, d: K.latest_snapshot(files(s, d)), over(
    "SELECT host, path, max(snapshot_id) AS snapshot_id, count(DISTINCT snapshot_id) AS snapshots FROM config_files GROUP BY 1, 2"))
add("blocking_rule", lambda s, d: K.extract_blocks(parsed(s, d)).select("file_id", "line", "expr",
        F.col("body").rlike(K.BLOCKING).alias("blocks"), F.col("body").rlike(K.DENY).alias("denies")),
    over(f"SELECT file_id, line, expr, regexp_matches(body, {BLOCKING}) AS blocks, regexp_matches(body, {DENY}) AS denies FROM b_locs", *CLEAN))

# --- compatibility -----------------------------------------------------------------------------

_TESTS = ", ".join(f"('{p}')" for p in [C.ACME_PATH, *C.HEALTH_PATHS])
HITS = CLEAN + (("h_hits", f"""SELECT b.*, t.test_path FROM b_locs b, (VALUES {_TESTS}) t(test_path) WHERE CASE b.modifier WHEN '=' THEN b.location = t.test_path
  WHEN '~' THEN regexp_matches(t.test_path, b.location) WHEN '~*' THEN regexp_matches(t.test_path, concat('(?i)', b.location)) ELSE starts_with(t.test_path, b.location) END"""),)
add("location_match", lambda s, d: K.location_match(parsed(s, d)), over("SELECT file_id, host, path, snapshot_id, line, expr, test_path FROM h_hits", *HITS))
_NO_SERVER = "NOT EXISTS (SELECT 1 FROM b_servers s WHERE s.file_id = f.file_id)"
_ACME = _check("acme_paths", f"""SELECT file_id, expr AS issue FROM h_hits h WHERE test_path = '{C.ACME_PATH}' AND regexp_matches(body, {DENY})
    AND EXISTS (SELECT 1 FROM b_servers s WHERE s.file_id = h.file_id)
    AND NOT EXISTS (SELECT 1 FROM h_hits o WHERE o.file_id = h.file_id AND o.test_path = '{C.ACME_PATH}' AND o.modifier IN ('=', '^~') AND NOT regexp_matches(o.body, {DENY}))""",
    f"CASE WHEN {_NO_SERVER} THEN 'skip' WHEN i.n > 0 THEN 'fail' ELSE 'pass' END")
add("compat_acme", lambda s, d: K.compat_check(parsed(s, d), "acme_paths"), over(_ACME, *HITS))
_HEALTH = _check("health_endpoints", f"""SELECT file_id, concat(test_path, ' blocked by ', expr) AS issue FROM h_hits
    WHERE test_path <> '{C.ACME_PATH}' AND regexp_matches(body, {DENY})""")
add("compat_health", lambda s, d: K.compat_check(parsed(s, d), "health_endpoints"), over(_HEALTH, *HITS))
_PROXY = _check("proxy_headers", rf"""SELECT file_id, concat(expr, ' missing ', h) AS issue FROM b_locs, (VALUES {', '.join(f"('{h}')" for h in C.REQUIRED_PROXY_HEADERS)}) v(h)
    WHERE regexp_matches(body, '\bproxy_pass\b') AND NOT regexp_matches(body, concat('proxy_set_header\s+', h, '\b'))""",
    r"CASE WHEN i.n > 0 THEN 'fail' WHEN NOT EXISTS (SELECT 1 FROM b_locs b WHERE b.file_id = f.file_id AND regexp_matches(b.body, '\bproxy_pass\b')) THEN 'skip' ELSE 'pass' END")
add("compat_proxy_headers", lambda s, d: K.compat_check(parsed(s, d), "proxy_headers"), over(_PROXY, *CLEAN))
_UP, _CO = r"regexp_matches(body, 'proxy_set_header\s+Upgrade\b')", r"regexp_matches(body, 'proxy_set_header\s+Connection\b')"
_WS = _check("websocket_upgrade", rf"""SELECT file_id, expr AS issue FROM b_locs WHERE regexp_matches(body, '\bproxy_pass\b') AND (({_UP} AND NOT {_CO})
    OR (NOT {_UP} AND regexp_matches(body, 'proxy_set_header\s+Connection\s+"[Uu]pgrade"')))""",
    rf"CASE WHEN NOT EXISTS (SELECT 1 FROM b_locs b WHERE b.file_id = f.file_id AND regexp_matches(body, '\bproxy_pass\b') AND ({_UP} OR {_CO})) THEN 'skip' WHEN i.n > 0 THEN 'fail' ELSE 'pass' END")
add("compat_websocket", lambda s, d: K.compat_check(parsed(s, d), "websocket_upgrade"), over(_WS, *CLEAN))

# Lines at depth 0 of each context: the running brace count before a line is zero and it opens none.
_LISTED = ", ".join(f"'{d}'" for d in C.REPEATABLE_DIRECTIVES)
CONTEXTS = CLEAN + (
    ("x_ctx", """SELECT file_id, concat('s', open) AS ctx, body, 'server' AS label FROM b_servers
        UNION ALL SELECT file_id, 't', clean, 'top level' FROM c_text f WHERE NOT EXISTS (SELECT 1 FROM b_servers s WHERE s.file_id = f.file_id)
        UNION ALL SELECT file_id, concat('l', open), body, expr FROM b_locs"""),
    ("x_lines", """SELECT file_id, ctx, label, unnest(string_split(body, chr(10))) AS line, unnest(range(1, 1 + len(string_split(body, chr(10))))) AS n FROM x_ctx"""),
    ("x_depth", """SELECT *, coalesce(sum(length(line) - length(replace(line, '{', '')) - length(line) + length(replace(line, '}', '')))
        OVER (PARTITION BY file_id, ctx ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x_lines"""),
    ("x_dirs", r"""SELECT *, regexp_extract(trim(line, ' ' || chr(9)), '^(\w[\w-]*)', 1) AS dir FROM x_depth WHERE before = 0 AND NOT contains(line, '{')"""),
    ("x_dupes", f"""SELECT file_id, ctx, concat(dir, ' x', count(*), CASE label WHEN 'top level' THEN ' at ' ELSE ' in ' END, label) AS issue
        FROM x_dirs WHERE dir <> '' AND dir NOT IN ({_LISTED}) GROUP BY file_id, ctx, label, dir HAVING count(*) > 1"""),
)
_DUPES = _check("duplicate_directives", "SELECT file_id, issue FROM x_dupes", WARN)
add("compat_duplicates", lambda s, d: K.compat_check(parsed(s, d), "duplicate_directives"), over(_DUPES, *CONTEXTS))
_INHERIT = _check("header_inheritance", r"""
  SELECT b.file_id, b.expr AS issue FROM b_locs b JOIN b_servers s ON s.file_id = b.file_id AND b.open > s.open AND b.close < s.close
   WHERE regexp_matches(s.body, '\badd_header\b') AND regexp_matches(b.body, '\badd_header\b')
  UNION ALL SELECT b.file_id, b.expr FROM b_locs b JOIN c_text t ON t.file_id = b.file_id WHERE NOT EXISTS (SELECT 1 FROM b_servers s WHERE s.file_id = b.file_id)
   AND regexp_matches(t.clean, '(?m)^[ \t]*add_header\b') AND regexp_matches(b.body, '\badd_header\b')""", WARN)
add("compat_header_inheritance", lambda s, d: K.compat_check(parsed(s, d), "header_inheritance"), over(_INHERIT, *CLEAN))
SHADOW = CLEAN + (
    ("w_shadow", """SELECT r.file_id, r.host, r.path, r.snapshot_id, r.expr AS regex_location, p.expr AS prefix_location FROM b_locs r JOIN b_locs p ON p.file_id = r.file_id
        WHERE p.modifier = '' AND ((r.modifier = '~' AND regexp_matches(p.location, r.location)) OR (r.modifier = '~*' AND regexp_matches(p.location, concat('(?i)', r.location))))"""),
    ("w_dup", """SELECT file_id, host, path, snapshot_id, expr, first_line, line FROM (SELECT *, row_number() OVER w AS n, first_value(line) OVER w AS first_line FROM b_locs
        WINDOW w AS (PARTITION BY file_id, modifier, location ORDER BY open)) x WHERE n > 1"""),
)
add("location_shadow", lambda s, d: K.location_shadow(parsed(s, d)), over("SELECT * FROM w_shadow", *SHADOW))
add("duplicate_location", lambda s, d: K.duplicate_location(parsed(s, d)), over("SELECT * FROM w_dup", *SHADOW))
_PREC = _check("location_precedence", """SELECT file_id, concat(regex_location, ' shadows ', prefix_location) AS issue FROM w_shadow
    UNION ALL SELECT file_id, concat('duplicate ', expr) FROM w_dup""", WARN)
add("compat_precedence", lambda s, d: K.compat_check(parsed(s, d), "location_precedence"), over(_PREC, *SHADOW))
_ORDER = _check("deny_allow_conflicts", r"""
  SELECT file_id, concat('deny before allow in ', expr) AS issue FROM (SELECT file_id, open, expr,
     max(CASE WHEN regexp_matches(l, '^[ \t]*deny\b') THEN n END) AS d, max(CASE WHEN regexp_matches(l, '^[ \t]*allow\b') THEN n END) AS a
     FROM (SELECT file_id, open, expr, unnest(string_split(body, chr(10))) AS l, unnest(range(len(string_split(body, chr(10))))) AS n FROM b_locs) x GROUP BY 1, 2, 3) y WHERE d < a
  UNION ALL SELECT b.file_id, concat('top-level deny against ', b.expr) FROM b_locs b JOIN c_text t ON t.file_id = b.file_id
     WHERE regexp_matches(t.clean, '(?m)^\s*deny\s+all\s*;') AND regexp_matches(b.body, '\ballow\b')""", WARN)
add("compat_deny_allow", lambda s, d: K.compat_check(parsed(s, d), "deny_allow_conflicts"), over(_ORDER, *CLEAN))

# --- includes and blast radius -----------------------------------------------------------------

EDGES = TEXT + (
    ("e_edges", r"""SELECT host, snapshot_id, path AS includer, CASE WHEN t LIKE '/%' THEN t ELSE concat('/etc/nginx/', t) END AS target FROM (
        SELECT host, snapshot_id, path, trim(unnest(regexp_extract_all(text, '(?m)^\s*include\s+([^;]+);', 1))) AS t FROM c_text) x"""),
    ("e_found", r"""SELECT DISTINCT e.host, e.snapshot_id, e.includer, e.target, f.path AS included FROM e_edges e JOIN c_text f ON f.host = e.host AND f.snapshot_id = e.snapshot_id
        AND (f.path = e.target OR (contains(e.target, '*') AND regexp_matches(f.path, concat('^', replace(replace(e.target, '.', '\.'), '*', '[^/]*'), '$'))))"""),
)
WALK = ("walk", """WITH RECURSIVE w AS (SELECT DISTINCT host, snapshot_id, includer AS root, included AS file FROM e_found
      UNION SELECT w.host, w.snapshot_id, w.root, e.included FROM w JOIN e_found e ON e.host = w.host AND e.snapshot_id = w.snapshot_id
      AND e.includer = w.file) SELECT * FROM w""")
EDGES = EDGES + (WALK, ("e_issues", """
   SELECT host, snapshot_id, includer, NOT contains(target, '*') AS bad, target AS issue FROM e_edges a WHERE NOT EXISTS
     (SELECT 1 FROM e_found x WHERE x.host = a.host AND x.snapshot_id = a.snapshot_id AND x.includer = a.includer AND x.target = a.target)
   UNION ALL SELECT host, snapshot_id, includer, false, concat('outside: ', target) FROM e_edges WHERE target NOT LIKE '/etc/nginx/%'
   UNION ALL SELECT host, snapshot_id, root, true, 'circular' FROM walk WHERE root = file"""))
_INCLUDES = """SELECT f.file_id, f.host, f.path, f.snapshot_id, 'include_integrity' AS check_name,
   CASE WHEN bool_or(e.bad) THEN 'fail' WHEN count(e.issue) > 0 THEN 'warn' ELSE 'pass' END AS status,
   coalesce(string_agg(DISTINCT e.issue, '; ' ORDER BY e.issue), '') AS detail FROM c_text f LEFT JOIN e_issues e
   ON e.host = f.host AND e.snapshot_id = f.snapshot_id AND e.includer = f.path GROUP BY 1, 2, 3, 4"""
add("compat_includes", lambda s, d: K.compat_includes(files(s, d)), over(_INCLUDES, *EDGES))
add("include_expand", lambda s, d: K.include_expand(files(s, d)), with_views(
    "SELECT host, snapshot_id, root, file, CAST(min(depth) AS BIGINT) AS depth, root = file AS cycle FROM steps GROUP BY 1, 2, 3, 4",
    "config_files", ctes=EDGES + (("steps", """WITH RECURSIVE w AS (SELECT DISTINCT host, snapshot_id, includer AS root, included AS file, 1 AS depth, [includer] AS seen FROM e_found
      UNION ALL SELECT w.host, w.snapshot_id, w.root, e.included, w.depth + 1, list_append(w.seen, w.file) FROM w JOIN e_found e ON e.host = w.host AND e.snapshot_id = w.snapshot_id
      AND e.includer = w.file WHERE NOT list_contains(w.seen, w.file)) SELECT * FROM w"""),)))

_BARE = "regexp_replace(text, '#[^\\n]*', '', 'g')"
_WORD = r"regexp_replace(regexp_extract(l, '^\s*(\S+)', 1), ';+$', '')"
RADIUS = EDGES + (
    ("z_words", f"SELECT file_id, n, {_WORD} AS w FROM (SELECT file_id, unnest(string_split({_BARE}, chr(10))) AS l, unnest(range(len(string_split({_BARE}, chr(10))))) AS n FROM c_text) x"),
    ("z_first", f"SELECT file_id, arg_min(w, n) AS w FROM z_words WHERE {O.in_list('w', C.HTTP_DIRECTIVES + C.SERVER_DIRECTIVES)} GROUP BY 1"),
    ("z_own", rf"""SELECT t.*, CASE WHEN regexp_matches({_BARE}, '(?m)^\s*location\s+[^{{]*\{{') THEN 'add_location_block' WHEN regexp_matches({_BARE}, '(?m)^\s*server\s*\{{') THEN 'add_server_block'
        WHEN regexp_matches({_BARE}, '(?m)^\s*http\s*\{{') THEN 'modify_http_block' WHEN regexp_matches({_BARE}, '(?m)^\s*upstream\s+\S+\s*\{{') THEN 'add_upstream_block'
        WHEN {O.in_list('z.w', C.HTTP_DIRECTIVES)} THEN 'modify_http_directive' WHEN z.w IS NOT NULL THEN 'modify_server_directive'
        WHEN regexp_matches({_BARE}, '\S') THEN 'add_location_block' ELSE 'unknown' END AS change_type,
        CAST(len(regexp_extract_all({_BARE}, '(^|[^\w-])server\s*\{{')) AS BIGINT) AS own,
        t.path LIKE '%/nginx.conf' OR regexp_matches({_BARE}, '(?m)^\s*http\s*\{{') OR EXISTS (SELECT 1 FROM z_words q WHERE q.file_id = t.file_id
          AND {O.in_list('q.w', [x for x in C.HTTP_DIRECTIVES if x != 'include'])}) AS top
        FROM c_text t LEFT JOIN z_first z ON z.file_id = t.file_id"""),
    ("z_use", """SELECT e.host, e.snapshot_id, e.included AS path, CAST(sum(o.own) AS BIGINT) AS using_blocks, count(*) AS n
        FROM (SELECT DISTINCT host, snapshot_id, includer, included FROM e_found WHERE includer NOT LIKE '%/nginx.conf') e
        JOIN z_own o ON o.host = e.host AND o.snapshot_id = e.snapshot_id AND o.path = e.includer GROUP BY 1, 2, 3"""),
    ("z_radius", rf"""SELECT o.file_id, o.host, o.path, o.snapshot_id, change_type, CASE WHEN top THEN 'global-http' WHEN change_type = 'add_upstream_block' AND u.n > 1 THEN 'vhost-group'
        WHEN change_type = 'add_upstream_block' AND u.n = 1 THEN 'server-block' WHEN u.n > 0 THEN 'include-file'
        WHEN regexp_matches({_BARE}, '(?m)^\s*location\s+[^{{]*\{{') THEN 'exact-location' ELSE 'server-block' END AS blast_radius,
        CASE WHEN top THEN 0 WHEN u.n > 0 THEN using_blocks ELSE greatest(own, 1) END AS affected_server_blocks, coalesce(u.n, 0) AS including_files
        FROM z_own o LEFT JOIN z_use u ON u.host = o.host AND u.snapshot_id = o.snapshot_id AND u.path = o.path"""),
)
add("change_type", lambda s, d: files(s, d).select("file_id", K.change_type(F.col("text")).alias("change_type")),
    over("SELECT file_id, change_type FROM z_own", *RADIUS[:-2]))
add("server_block_count", lambda s, d: files(s, d).select("file_id", K.server_block_count(F.col("text")).alias("server_blocks")),
    over("SELECT file_id, own AS server_blocks FROM z_own", *RADIUS[:-2]))
add("blast_radius", lambda s, d: K.blast_radius(files(s, d)), over("SELECT * FROM z_radius", *RADIUS))
add("max_blast_radius", lambda s, d: K.max_blast_radius(K.blast_radius(files(s, d))), over(f"""
SELECT host, snapshot_id, max_blast_radius, max_server_blocks, max_blast_radius NOT IN ('exact-location', 'server-block') AS elevated FROM (
  SELECT host, snapshot_id, {O.label_of(f"max({O.ordinal('blast_radius', C.RADIUS_ORDER)})", C.RADIUS_ORDER)} AS max_blast_radius,
    max(affected_server_blocks) AS max_server_blocks FROM z_radius GROUP BY 1, 2) x""", *RADIUS))

# --- audit and gate ----------------------------------------------------------------------------

_AUDIT = ([f"SELECT file_id, host, path, snapshot_id, '{n}' AS check_name, CAST({w} AS BIGINT) AS weight, {O.hit('clean', rx)} AS passed FROM c_text" for n, w, rx in K.AUDIT]
          + [f"SELECT file_id, host, path, snapshot_id, '{n}', CAST({w} AS BIGINT), NOT {O.hit('clean', rx)} FROM c_text" for n, w, rx in K.AUDIT_ABSENT]
          + [f"SELECT file_id, host, path, snapshot_id, 'header:{h}', CAST({K.HEADER_WEIGHT} AS BIGINT), contains(clean, {O.q(f'add_header {h} ' + chr(34) + v + chr(34))}) FROM c_text"
             for h, v in C.EXPECTED_HEADER_VALUES.items()])
AUDIT = TEXT + (("audit", " UNION ALL ".join(_AUDIT)),)
add("static_audit", lambda s, d: K.static_audit(parsed(s, d)), over("SELECT * FROM audit", *AUDIT))
add("audit_score", lambda s, d: K.audit_score(K.static_audit(parsed(s, d))), over(f"""
SELECT *, score >= {C.DEFAULT_PASS_SCORE} AS passes FROM (SELECT file_id, host, path, snapshot_id,
  round(CAST(100 * sum(CASE WHEN passed THEN weight ELSE 0 END) AS DOUBLE) / CAST(sum(weight) AS DOUBLE), 2) AS score FROM audit GROUP BY 1, 2, 3, 4) x""", *AUDIT))
add("profile_detect", lambda s, d: K.profile_detect(files(s, d)), over(r"""
SELECT host, snapshot_id, CASE WHEN bool_or(contains(text, 'proxy_pass')) THEN 'reverse-proxy-app' WHEN bool_or(contains(text, 'limit_req_zone')) THEN 'edge-public'
  WHEN bool_or(regexp_matches(text, '\b(root|try_files)\b')) THEN 'static-site' WHEN bool_or(regexp_matches(text, 'listen\s+(10\.|192\.168\.)')) THEN 'internal-only' ELSE 'edge-public' END AS profile
FROM config_files GROUP BY 1, 2"""))

_FULL = EDGES + CLEAN[1:] + HITS[len(CLEAN):] + CONTEXTS[len(CLEAN):] + SHADOW[len(CLEAN):] + (
    ("checks", " UNION ALL ".join(f"SELECT * FROM ({q}) u" for q in (_INCLUDES, _ACME, _HEALTH, _PROXY, _WS, _DUPES, _INHERIT, _PREC, _ORDER))),
    ("graded", "SELECT *, CASE WHEN status = 'fail' AND (" + " OR ".join(
        f"(profile = '{p}' AND {O.in_list('check_name', cs)})" for p, cs in C.PROFILE_CRITICAL_CHECKS.items())
     + f") THEN 3 WHEN status IN ('fail', 'warn') THEN 2 ELSE 1 END AS r FROM checks, (VALUES {', '.join(f'({O.q(p)})' for p in C.PROFILES)}) v(profile)"),
    ("overall", "SELECT file_id, host, path, snapshot_id, profile, CASE max(r) WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'pass' END AS overall FROM graded GROUP BY 1, 2, 3, 4, 5"),
)
add("compat_checks", lambda s, d: K.compat_checks(parsed(s, d)).groupBy("check_name", "status").agg(F.count(F.lit(1)).alias("files")),
    over("SELECT check_name, status, count(*) AS files FROM checks GROUP BY 1, 2", *_FULL))
add("check_overall", lambda s, d: K.check_overall(K.compat_checks(parsed(s, d))), over("SELECT * FROM overall", *_FULL))


def deploy_gate(s, d):
    both, proposed = pairs(s, d), parsed(s, d).where(F.col("snapshot_id") == PROPOSED)
    checks = K.inv_additive(both).unionByName(K.inv_headers(both)).unionByName(K.inv_scope(both))
    for single in (K.inv_no_negation(proposed), K.inv_tls_floor(proposed)):
        checks = checks.unionByName(single.select(*checks.columns))
    expired = G.exception_state(view(s, d, "exceptions"), AS_OF).where("blocks")
    invalid = (G.validate(view(s, d, "exception_records"), "exception").where("NOT valid")
               .select(F.col("f_linked_config_path")["value"].alias("path")))
    git = K.inv_destructive_git(view(s, d, "commands")).where("status = 'fail'").select("host")
    return K.deploy_gate(checks, K.check_overall(K.compat_checks(proposed)), "edge-public",
                         {"exception:expired": expired.select(F.col("linked_config_path").alias("path")), "record:invalid": invalid},
                         {"invariant:destructive_git": git})


add("deploy_gate", deploy_gate, with_views(f"""
SELECT t.host, t.path, r.reasons IS NOT NULL AS blocked, coalesce(r.reasons, '') AS reasons FROM (SELECT DISTINCT host, path FROM config_files) t LEFT JOIN (
  SELECT host, path, string_agg(reason, ',' ORDER BY reason) AS reasons FROM (
    SELECT host, path, concat('invariant:', check_name) AS reason FROM (SELECT * FROM ({_ADDITIVE}) a UNION ALL SELECT * FROM ({_INV_HEADERS}) b UNION ALL SELECT * FROM ({_SCOPE}) c
      UNION ALL SELECT host, path, check_name, status, detail FROM ({_NEGATION}) e WHERE snapshot_id = '{PROPOSED}'
      UNION ALL SELECT host, path, check_name, status, detail FROM ({_TLS}) g WHERE snapshot_id = '{PROPOSED}') i WHERE status = 'fail'
    UNION SELECT host, path, 'compat:critical' FROM overall WHERE profile = 'edge-public' AND overall = 'fail' AND snapshot_id = '{PROPOSED}'
    UNION SELECT f.host, f.path, 'exception:expired' FROM config_files f JOIN x_state x ON f.path = x.linked_config_path WHERE x.state = 'expired' AND x.severity_tier = 'critical'
    UNION SELECT f.host, f.path, 'record:invalid' FROM config_files f JOIN ({EXC_SQL}) v ON NOT v.valid JOIN exceptions x ON x.ord = v.ord AND x.linked_config_path = f.path
    UNION SELECT f.host, f.path, 'invariant:destructive_git' FROM config_files f JOIN commands c ON f.host = c.host
      WHERE ({' OR '.join(O.hit('command', p) for p in C.DESTRUCTIVE_GIT)})) q
  GROUP BY 1, 2) r ON r.host = t.host AND r.path = t.path""", "config_files", "exceptions", "exception_records", "commands", ctes=_FULL + RAW[1:] + _PAIR + _DIFF + STATES))


def emergency_eligible(s, d):
    """Whether a proposal passes is asked of its host's files; a host without files is not known."""
    proposed = parsed(s, d).where(F.col("snapshot_id") == PROPOSED)
    checks = K.inv_no_negation(proposed).unionByName(K.inv_tls_floor(proposed))
    passes = checks.groupBy("host").agg(F.bool_and(F.col("status") != "fail").alias("invariants_pass"))
    findings = view(s, d, "findings").withColumn("host", F.concat(F.lit("host-"), (F.col("ord") % 150).cast("string")))
    return I.emergency_eligible(findings.join(passes, "host", "left")).select("ord", "eligible", F.array_join("refusals", ",").alias("refusals"))


add("emergency_eligible", emergency_eligible, with_views(f"""
SELECT ord, refusals = '' AS eligible, refusals FROM (SELECT f.ord, concat_ws(',', CASE WHEN rule_class <> 'A' THEN 'class' END,
  CASE WHEN blast_radius NOT IN ('exact-location', 'server-block') THEN 'scope' END, CASE WHEN confidence < 0.8 THEN 'confidence' END,
  CASE WHEN ttl IS NULL THEN 'ttl' END, CASE WHEN provenance IS NULL THEN 'provenance' END,
  CASE WHEN NOT coalesce(p.ok, false) THEN 'invariants' END) AS refusals
  FROM findings f LEFT JOIN (SELECT host, bool_and(status <> 'fail') AS ok FROM (
    SELECT host, status FROM ({_NEGATION}) e WHERE snapshot_id = '{PROPOSED}' UNION ALL SELECT host, status FROM ({_TLS}) g WHERE snapshot_id = '{PROPOSED}') c
    GROUP BY host) p ON p.host = concat('host-', CAST(f.ord % 150 AS VARCHAR))) x""", "findings", "config_files", ctes=RAW))
