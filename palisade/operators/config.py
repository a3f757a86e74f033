"""Config files of a fleet: blocks, invariants, compatibility, blast radius.

A config file is one row and its blocks are arrays in that row, so nearly every check is a narrow
projection; only what compares files (snapshots, includes) shuffles, keyed by host and path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import catalog as C
from palisade.functions import sanitize as S
from palisade.operators.blocks import file_blocks
from palisade.operators.matching import location_regexes, location_takes, shadowing
from palisade.session import materialize

ID = ["file_id", "host", "path", "snapshot_id"]
ROOT = "/etc/nginx/"
DENY = r"\breturn\s+(403|404|444)\b|\bdeny\s+all\b"
BLOCKING = r"\breturn\s+404\b|\bdeny\s+all\b"


def sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the files: both sides are shuffled and merged, neither goes to the driver.

    Paths and names repeat, so a table whose files look small enough to be broadcast is many times as large in memory.
    """
    return df.hint("merge")


def without_comments(text: Column) -> Column:
    """Comment lines go, and comments that follow white space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^[ \t]*#.*\n?", ""), r"(?m)[ \t]+#.*$", "")


def without_hash(text: Column) -> Column:
    return F.regexp_replace(text, "#[^\n]*", "")


def parse_files(files: DataFrame) -> DataFrame:
    """Adds ``clean``, ``locs``, ``servers`` (comments stripped) and ``raw_locs`` (comments kept)."""
    cut = files.withColumn("clean", without_comments(F.col("text"))).withColumns(
        {"_b": file_blocks("clean"), "_rb": file_blocks("text")})
    return cut.select(*files.columns, "clean", F.col("_b.locs").alias("locs"), F.col("_b.servers").alias("servers"),
                      F.col("_rb.locs").alias("raw_locs"), F.col("_b.unbalanced").alias("unbalanced"))


def extract_blocks(parsed: DataFrame) -> DataFrame:
    return parsed.select(*ID, F.explode("locs").alias("b")).select(
        *ID, "b.line", "b.expr", "b.modifier", F.col("b.path").alias("location"), "b.body")


# --- comparing two snapshots -------------------------------------------------------------------

def snapshot_pairs(parsed: DataFrame, backup: str, proposed: str) -> DataFrame:
    """One row per (host, path) of either snapshot; a side without the file is an empty text."""
    side = lambda sid, p: parsed.where(F.col("snapshot_id") == sid).select(
        "host", "path", F.col("text").alias(f"{p}_text"), F.col("raw_locs").alias(f"{p}_locs"))
    both = side(backup, "old").join(side(proposed, "new"), ["host", "path"], "full")
    none = F.array().cast(both.schema["old_locs"].dataType)
    return both.withColumns({f"{p}_text": F.coalesce(f"{p}_text", F.lit("")) for p in ("old", "new")} |
                            {f"{p}_locs": F.coalesce(f"{p}_locs", none) for p in ("old", "new")})


def _blocking_keys(locs: str) -> Column:
    return F.expr(f"array_distinct(transform(filter({locs}, b -> b.body RLIKE r'{BLOCKING}'), b -> b.expr))")


def _row(name: str, status: Column, issues: Column) -> list[Column]:
    return [F.lit(name).alias("check_name"), status.alias("status"),
            F.array_join(F.array_sort(issues), "; ").alias("detail")]


def _fail_if_any(issues: Column, bad: str = "fail") -> Column:
    return F.when(F.size(issues) > 0, F.lit(bad)).otherwise(F.lit("pass"))


def rules_removed(parsed: DataFrame, backup: str, proposed: str) -> DataFrame:
    """Blocking patterns of the backup that the proposal no longer blocks."""
    keys = parsed.select("host", "path", "snapshot_id", F.explode(_blocking_keys("raw_locs")).alias("pattern"))
    old = keys.where(F.col("snapshot_id") == backup).drop("snapshot_id")
    new = keys.where(F.col("snapshot_id") == proposed).drop("snapshot_id")
    return old.join(sorted_side(new), ["host", "path", "pattern"], "left_anti")


def inv_additive(pairs: DataFrame) -> DataFrame:
    """No blocking rule removed; none weakened by a later location of the same name."""
    removed = F.array_except(_blocking_keys("old_locs"), _blocking_keys("new_locs"))
    weakened = F.expr(f"""filter(_old, k -> coalesce(NOT element_at(filter(new_locs, b -> b.expr = k), -1).body
                          RLIKE r'{BLOCKING}', false))""")
    marked = pairs.withColumns({"_old": _blocking_keys("old_locs"), "_gone": removed})
    issues = F.when(F.size("_gone") > 0, F.transform("_gone", lambda x: F.concat(F.lit("removed: "), x))).otherwise(
        F.transform(weakened, lambda x: F.concat(F.lit("weakened: "), x)))
    return marked.withColumn("_i", issues).select(
        "host", "path", *_row("additive_only", _fail_if_any(F.col("_i")), F.col("_i")))


def header_map(text: str) -> Column:
    """array<struct<name, value>> of the quoted add_header directives."""
    rx = r"""add_header\s+(\S+)\s+"([^"]*)\""""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(rx), F.lit(1)).alias("name"),
                        F.regexp_extract_all(text, F.lit(rx), F.lit(2)).alias("value"))


def headers_changed(pairs: DataFrame) -> DataFrame:
    """Required headers per pair: missing, changed or kept.  The last directive of a name counts."""
    marked = pairs.withColumns({"_old": header_map("old_text"), "_new": header_map("new_text")})
    rows = marked.withColumn("header", F.explode(F.array(*[F.lit(h) for h in C.REQUIRED_HEADERS])))
    last = lambda a: F.expr(f"try_element_at(filter({a}, h -> h.name = header), -1).value")
    both = rows.withColumns({"old_value": last("_old"), "new_value": last("_new")})
    state = (F.when(F.col("new_value").isNull(), F.lit("missing"))
             .when(F.col("old_value") != F.col("new_value"), F.lit("changed")).otherwise(F.lit("kept")))
    return both.select("host", "path", "header", "old_value", "new_value", state.alias("state"))


def inv_headers(pairs: DataFrame) -> DataFrame:
    """Missing headers decide first; changes are only looked at when none is missing."""
    last = "try_element_at(filter({0}, x -> x.name = h), -1).value"
    names = "array(" + ", ".join(f"'{h}'" for h in C.REQUIRED_HEADERS) + ")"
    marked = pairs.withColumns({"_old": header_map("old_text"), "_new": header_map("new_text")}).withColumns({
        "_missing": F.expr(f"filter({names}, h -> {last.format('_new')} IS NULL)"),
        "_changed": F.expr(f"filter({names}, h -> {last.format('_old')} <> {last.format('_new')})")})
    issues = F.when(F.size("_missing") > 0, F.transform("_missing", lambda h: F.concat(F.lit("missing: "), h))).otherwise(
        F.transform("_changed", lambda h: F.concat(F.lit("changed: "), h)))
    return marked.withColumn("_i", issues).select(
        "host", "path", *_row("headers_immutable", _fail_if_any(F.col("_i")), F.col("_i")))


def change_scope(old: Column, new: Column) -> Column:
    """Scope of a change from the set of lines that differ."""
    lines = lambda t: F.split(F.regexp_replace(t, r"\A\s+|\s+\z", ""), "\n")
    diff = F.concat(F.array_except(lines(new), lines(old)), F.array_except(lines(old), lines(new)))
    text = F.array_join(diff, "\n")
    return (F.when(F.size(diff) == 0, F.lit("exact-location"))
            .when(text.rlike(r"\bssl_"), F.lit("server-block"))
            .when(text.rlike(r"\blocation\b") & ~text.rlike(r"\badd_header\b"), F.lit("exact-location"))
            .otherwise(F.lit("include-file")))


def file_scope(text: Column) -> Column:
    return (F.when(text.rlike(r"\bhttp\s*\{"), F.lit("global-http"))
            .when(text.rlike(r"\bserver\s*\{"), F.lit("server-block")).otherwise(F.lit("include-file")))


def inv_scope(pairs: DataFrame) -> DataFrame:
    marked = pairs.withColumn("scope", change_scope(F.col("old_text"), F.col("new_text")))
    wide = S.ordinal(F.col("scope"), C.RADIUS_ORDER) > 2
    return marked.select("host", "path", F.lit("scope_check").alias("check_name"),
                         F.when(wide, F.lit("warn")).otherwise(F.lit("pass")).alias("status"),
                         F.col("scope").alias("detail"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("host", "path", "snapshot_id", F.explode(F.split("text", "\n")).alias("line"))


def line_diff(files: DataFrame, backup: str, proposed: str) -> DataFrame:
    """Lines only one of two snapshots has, from one aggregation over both."""
    flags = _lines(files.where(F.col("snapshot_id").isin(backup, proposed))).groupBy("host", "path", "line").agg(
        F.bool_or(F.col("snapshot_id") == backup).alias("_old"),
        F.bool_or(F.col("snapshot_id") == proposed).alias("_new"))
    return flags.where("_old <> _new").select(
        "host", "path", "line", F.when(F.col("_new"), F.lit("added")).otherwise(F.lit("removed")).alias("side"))


def snapshot_churn(files: DataFrame) -> DataFrame:
    """Lines added and removed between consecutive snapshots, counted as multisets.

    Each text meets its place among the snapshots before it is cut into lines.
    """
    from pyspark.sql import Window
    order = Window.partitionBy("host", "path").orderBy("snapshot_id")
    key = ["host", "path", "snapshot_id"]
    steps = files.select(*key).dropna().distinct().withColumns(
        {"_first": F.lag("snapshot_id").over(order).isNull(), "_next": F.lead("snapshot_id").over(order)})
    signed = (files.select(*key, "text").join(sorted_side(steps), key)
              .select("host", "path", F.split("text", "\n").alias("_lines"), F.inline(F.array(
                  F.struct(F.when(~F.col("_first"), F.col("snapshot_id")).alias("to"), F.lit(1).alias("n")),
                  F.struct(F.col("_next").alias("to"), F.lit(-1).alias("n")))))
              .where("to IS NOT NULL"))
    moved = (signed.select("host", "path", "to", F.explode("_lines").alias("line"), "n")
             .groupBy("host", "path", "to", "line").agg(F.sum("n").alias("n")))
    return moved.groupBy("host", "path", F.col("to").alias("snapshot_id")).agg(
        F.sum(F.when(F.col("n") > 0, F.col("n")).otherwise(0)).alias("added"),
        F.sum(F.when(F.col("n") < 0, -F.col("n")).otherwise(0)).alias("removed"))


def latest_snapshot(files: DataFrame) -> DataFrame:
    return files.groupBy("host", "path").agg(
        F.max("snapshot_id").alias("snapshot_id"), F.count_distinct("snapshot_id").alias("snapshots"))


# --- single-file invariants --------------------------------------------------------------------

def inv_no_negation(parsed: DataFrame) -> DataFrame:
    issues = F.expr(rf"""flatten(transform(raw_locs, b -> array_compact(array(
        CASE WHEN contains(b.expr, '!~') THEN concat('negated: ', b.expr) END,
        CASE WHEN contains(b.expr, '(?!') THEN concat('lookahead: ', b.expr) END,
        CASE WHEN b.body RLIKE r'{BLOCKING}' AND b.body RLIKE r'\bproxy_pass\b' THEN concat('proxy_pass: ', b.expr) END,
        CASE WHEN b.body RLIKE r'{BLOCKING}' AND b.body RLIKE r'\breturn\s+200\b' THEN concat('return 200: ', b.expr) END,
        CASE WHEN b.body RLIKE r'{BLOCKING}' AND b.body RLIKE r'\brewrite\b' THEN concat('rewrite: ', b.expr) END))))""")
    return parsed.withColumn("_i", issues).select(
        *ID, *_row("no_regex_negation", _fail_if_any(F.col("_i")), F.col("_i")))


def inv_tls_floor(files: DataFrame) -> DataFrame:
    """The first ssl_protocols line decides; no line at all passes."""
    listed = F.split(F.trim(F.regexp_extract("text", r"(?m)^[ \t]*ssl_protocols[ \t]+([^;\n]+);", 1)), r"\s+")
    bad = F.array_intersect(listed, F.array(F.lit("TLSv1"), F.lit("TLSv1.1")))
    return files.select(*ID, *_row("tls_floor", _fail_if_any(bad), bad))


def inv_destructive_git(commands: DataFrame) -> DataFrame:
    found = F.col("command").rlike("|".join(f"(?:{p})" for p in C.DESTRUCTIVE_GIT))
    return commands.withColumn("status", F.when(found, F.lit("fail")).otherwise(F.lit("pass")))


# --- compatibility -----------------------------------------------------------------------------

def with_hits(parsed: DataFrame) -> DataFrame:
    """Adds ``hits``: per location, the test paths it takes."""
    if "hits" in parsed.columns:
        return parsed
    return with_regexes(parsed).withColumn("hits", location_takes("locs", "regexes", [C.ACME_PATH, *C.HEALTH_PATHS]))


def with_regexes(parsed: DataFrame) -> DataFrame:
    """Adds ``regexes``: per location, its regex as read, or NULL."""
    return parsed if "regexes" in parsed.columns else parsed.withColumn("regexes", location_regexes("locs"))


def location_match(parsed: DataFrame) -> DataFrame:
    pairs = F.arrays_zip(F.col("locs").alias("b"), F.col("hits").alias("h"))
    return with_hits(parsed).select(*ID, F.explode(pairs).alias("x")).select(
        *ID, F.col("x.b.line").alias("line"), F.col("x.b.expr").alias("expr"), F.explode("x.h").alias("test_path"))


def _mark_acme(parsed: DataFrame) -> DataFrame:
    zipped = "arrays_zip(locs, hits)"
    takes = f"array_contains(z.hits, '{C.ACME_PATH}')"
    marked = with_hits(parsed).withColumns({
        "_block": F.expr(f"transform(filter({zipped}, z -> {takes} AND z.locs.body RLIKE r'{DENY}'), z -> z.locs.expr)"),
        "_over": F.expr(f"exists({zipped}, z -> {takes} AND z.locs.modifier IN ('=', '^~') AND NOT z.locs.body RLIKE r'{DENY}')")})
    status = (F.when(F.size("servers") == 0, F.lit("skip"))
              .when((F.size("_block") > 0) & ~F.col("_over"), F.lit("fail")).otherwise(F.lit("pass")))
    return marked.withColumn(
        "c_acme_paths", F.struct(*_row("acme_paths", status, F.when(status == "fail", F.col("_block")).otherwise(F.array()))))


def _mark_health(parsed: DataFrame) -> DataFrame:
    issues = F.expr(f"""flatten(transform(filter(arrays_zip(locs, hits), z -> z.locs.body RLIKE r'{DENY}'),
        z -> transform(filter(z.hits, h -> h <> '{C.ACME_PATH}'), h -> concat(h, ' blocked by ', z.locs.expr))))""")
    return with_hits(parsed).withColumn("_i", issues).withColumn(
        "c_health_endpoints", F.struct(*_row("health_endpoints", _fail_if_any(F.col("_i")), F.col("_i"))))


def _proxied(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("_p", F.expr(r"filter(locs, b -> b.body RLIKE r'\bproxy_pass\b')"))


def _mark_proxy_headers(parsed: DataFrame) -> DataFrame:
    names = "array(" + ", ".join(f"'{h}'" for h in C.REQUIRED_PROXY_HEADERS) + ")"
    issues = F.expr(rf"""flatten(transform(_p, b -> transform(filter({names},
        h -> NOT b.body RLIKE concat(r'proxy_set_header\s+', h, r'\b')), h -> concat(b.expr, ' missing ', h))))""")
    status = (F.when(F.size("_i") > 0, F.lit("fail")).when(F.size("_p") == 0, F.lit("skip")).otherwise(F.lit("pass")))
    return _proxied(parsed).withColumn("_i", issues).withColumn(
        "c_proxy_headers", F.struct(*_row("proxy_headers", status, F.col("_i"))))


def _mark_websocket(parsed: DataFrame) -> DataFrame:
    up, conn = r"proxy_set_header\s+Upgrade\b", r"proxy_set_header\s+Connection\b"
    marked = _proxied(parsed).withColumns({
        "_ws": F.expr(f"exists(_p, b -> b.body RLIKE r'{up}' OR b.body RLIKE r'{conn}')"),
        "_i": F.expr(rf"""transform(filter(_p, b -> (b.body RLIKE r'{up}' AND NOT b.body RLIKE r'{conn}')
            OR (NOT b.body RLIKE r'{up}' AND b.body RLIKE r'proxy_set_header\s+Connection\s+"[Uu]pgrade"')), b -> b.expr)""")})
    status = (F.when(~F.col("_ws"), F.lit("skip")).when(F.size("_i") > 0, F.lit("fail")).otherwise(F.lit("pass")))
    return marked.withColumn(
        "c_websocket_upgrade", F.struct(*_row("websocket_upgrade", status, F.col("_i"))))


def _repeats(body: str) -> str:
    """SQL: directives that occur more than once at the top level of a body, as ``name xN``."""
    listed = ", ".join(f"'{d}'" for d in C.REPEATABLE_DIRECTIVES)
    names = rf"""filter(transform(aggregate(split({body}, r'\n'), named_struct('d', 0, 'out', cast(array() AS array<string>)),
        (s, l) -> CASE WHEN s.d = 0 AND NOT contains(l, '{{') THEN named_struct('d', 0, 'out', concat(s.out, array(trim(l))))
          WHEN s.d = 0 THEN named_struct('d', regexp_count(l, r'\{{') - regexp_count(l, r'\}}'), 'out', s.out)
          ELSE named_struct('d', greatest(0, s.d + regexp_count(l, r'\{{') - regexp_count(l, r'\}}')), 'out', s.out) END,
        s -> s.out), l -> CASE WHEN l = '' OR startswith(l, '#') OR l = '}}' THEN '' ELSE regexp_extract(l, r'^(\w[\w-]*)', 1) END),
        n -> n <> '' AND n NOT IN ({listed}))"""
    return (f"flatten(transform(array({names}), ns -> transform(filter(array_distinct(ns), n -> size(filter(ns, x -> x = n)) > 1), "
            f"n -> concat(n, ' x', cast(size(filter(ns, x -> x = n)) AS string)))))")


def _mark_duplicates(parsed: DataFrame) -> DataFrame:
    issues = F.expr(f"""concat(
        flatten(transform(servers, s -> transform({_repeats('s.body')}, i -> concat(i, ' in server')))),
        CASE WHEN size(servers) = 0 THEN transform({_repeats('clean')}, i -> concat(i, ' at top level')) ELSE cast(array() AS array<string>) END,
        flatten(transform(locs, b -> transform({_repeats('b.body')}, i -> concat(i, ' in ', b.expr)))))""")
    return parsed.withColumn("_i", issues).withColumn(
        "c_duplicate_directives", F.struct(*_row("duplicate_directives", _fail_if_any(F.col("_i"), "warn"), F.col("_i"))))


def _mark_header_inheritance(parsed: DataFrame) -> DataFrame:
    issues = F.expr(r"""CASE WHEN size(servers) > 0 THEN
        flatten(transform(filter(servers, s -> s.body RLIKE r'\badd_header\b'), s -> transform(filter(locs,
          b -> b.open > s.open AND b.close < s.close AND b.body RLIKE r'\badd_header\b'), b -> b.expr)))
      WHEN clean RLIKE r'(?m)^[ \t]*add_header\b' THEN transform(filter(locs, b -> b.body RLIKE r'\badd_header\b'), b -> b.expr)
      ELSE cast(array() AS array<string>) END""")
    return parsed.withColumn("_i", issues).withColumn(
        "c_header_inheritance", F.struct(*_row("header_inheritance", _fail_if_any(F.col("_i"), "warn"), F.col("_i"))))


def location_shadow(parsed: DataFrame) -> DataFrame:
    return with_regexes(parsed).select(*ID, "locs", F.inline(shadowing("locs", "regexes"))).select(
        *ID, F.expr("element_at(locs, regex + 1).expr").alias("regex_location"),
        F.expr("element_at(locs, prefix + 1).expr").alias("prefix_location"))


def duplicate_location(parsed: DataFrame) -> DataFrame:
    """Locations whose (modifier, path) stood earlier in the file, with the line it stood on."""
    seen = F.expr("""transform(locs, (b, i) -> named_struct('b', b, 'first',
        element_at(filter(locs, x -> x.modifier = b.modifier AND x.path = b.path), 1)))""")
    return (parsed.select(*ID, F.explode(seen).alias("x")).where("x.b.open > x.first.open")
            .select(*ID, F.col("x.b.expr").alias("expr"), F.col("x.first.line").alias("first_line"),
                    F.col("x.b.line").alias("line")))


def _mark_precedence(parsed: DataFrame) -> DataFrame:
    pairs = shadowing("locs", "regexes")
    issues = F.expr("""concat(
        transform(_s, p -> concat(element_at(locs, p.regex + 1).expr, ' shadows ', element_at(locs, p.prefix + 1).expr)),
        transform(filter(locs, b -> element_at(filter(locs, x -> x.modifier = b.modifier AND x.path = b.path), 1).open < b.open),
                  b -> concat('duplicate ', b.expr)))""")
    return with_regexes(parsed).withColumn("_s", pairs).withColumn("_i", issues).withColumn(
        "c_location_precedence", F.struct(*_row("location_precedence", _fail_if_any(F.col("_i"), "warn"), F.col("_i"))))


def _mark_deny_allow(parsed: DataFrame) -> DataFrame:
    """Order counts by the last line that starts with each word."""
    last = lambda w: (f"array_max(transform(filter(transform(split(b.body, r'\\n'), (l, i) -> named_struct('l', l, 'i', i)), "  # noqa: E731
                      f"z -> z.l RLIKE r'^[ \\t]*{w}\\b'), z -> z.i))")
    issues = F.expr(rf"""concat(
        transform(filter(locs, b -> {last('deny')} < {last('allow')}), b -> concat('deny before allow in ', b.expr)),
        CASE WHEN clean RLIKE r'(?m)^\s*deny\s+all\s*;' THEN transform(filter(locs, b -> b.body RLIKE r'\ballow\b'),
             b -> concat('top-level deny against ', b.expr)) ELSE cast(array() AS array<string>) END)""")
    return parsed.withColumn("_i", issues).withColumn(
        "c_deny_allow_conflicts", F.struct(*_row("deny_allow_conflicts", _fail_if_any(F.col("_i"), "warn"), F.col("_i"))))


# --- includes ----------------------------------------------------------------------------------

def include_edges(files: DataFrame) -> DataFrame:
    """(host, snapshot, includer, target, is_glob); relative targets are under the config root."""
    raw = F.regexp_extract_all("text", F.lit(r"(?m)^\s*include\s+([^;]+);"), F.lit(1))
    target = F.regexp_replace(F.trim(F.col("_t")), "^['\"]+|['\"]+$", "")
    full = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit(ROOT), target))
    return (files.select("host", "snapshot_id", F.col("path").alias("includer"), F.explode(raw).alias("_t"))
            .select("host", "snapshot_id", "includer", full.alias("target"))
            .withColumn("is_glob", F.col("target").rlike(r"[*?\[]")))


def _dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def resolve_includes(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges to files that exist.  Globs meet the files of their own folder by equality."""
    corpus = files.select("host", "snapshot_id", F.col("path").alias("included"))
    plain = edges.where("NOT is_glob").join(
        sorted_side(corpus), (corpus.host == edges.host) & (corpus.snapshot_id == edges.snapshot_id)
        & (corpus.included == edges.target), "left_semi").withColumn("included", F.col("target"))
    rx = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(
        "target", r"([.+^$(){}|\\])", r"\\$1"), r"\*", "[^/]*"), r"\?", "[^/]"), F.lit("$"))
    globs = (edges.where("is_glob").withColumns({"_dir": _dir(F.col("target")), "_rx": rx})
             .join(sorted_side(corpus.withColumn("_dir", _dir(F.col("included")))), ["host", "snapshot_id", "_dir"])
             .where(F.regexp_like("included", F.col("_rx"))))
    cols = ["host", "snapshot_id", "includer", "target", "included"]
    return plain.select(*cols).unionByName(globs.select(*cols)).distinct()


def compat_includes(files: DataFrame) -> DataFrame:
    """Missing includes and includes that lead back to their file fail; a glob without any file, and an
    include from outside the config folders, warn."""
    edges = include_edges(files)
    key = ["host", "snapshot_id", "includer", "target"]
    resolved = materialize(resolve_includes(edges, files))
    lost = edges.join(sorted_side(resolved.select(*key).distinct()), key, "left_anti").select(
        *key[:3], (~F.col("is_glob")).alias("_bad"), F.col("target").alias("_issue"))
    outside = edges.where(~F.col("target").startswith(ROOT)).select(
        *key[:3], F.lit(False).alias("_bad"), F.concat(F.lit("outside: "), "target").alias("_issue"))
    loops = cycle_files(resolved).select(
        "host", "snapshot_id", F.col("file").alias("includer"), F.lit(True).alias("_bad"), F.lit("circular").alias("_issue"))
    found = lost.unionByName(outside).unionByName(loops).groupBy(*key[:3]).agg(
        F.bool_or("_bad").alias("_bad"), F.array_sort(F.collect_set("_issue")).alias("_issues"))
    status = (F.when(F.col("_bad"), F.lit("fail")).when(F.col("_issues").isNotNull(), F.lit("warn"))
              .otherwise(F.lit("pass")))
    return (files.select(*ID).join(sorted_side(found.withColumnRenamed("includer", "path")), ["host", "snapshot_id", "path"], "left")
            .select(*ID, F.lit("include_integrity").alias("check_name"), status.alias("status"),
                    F.coalesce(F.array_join("_issues", "; "), F.lit("")).alias("detail")))


GRAPH = ["host", "snapshot_id"]


def _ends(single: DataFrame, steps: int) -> DataFrame:
    """(a, t): where 2^steps or more steps lead from files with one include, or the last file before that."""
    ends = single
    for _ in range(steps):
        on = ends.select(*GRAPH, F.col("a").alias("t"), F.col("t").alias("_t"))
        ends = materialize(ends.join(sorted_side(on), [*GRAPH, "t"], "left").select(*GRAPH, "a", F.coalesce("_t", "t").alias("t")))
    return ends


def _peel(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges without those that lead to no cycle, and the files of rings, whose edges go too.

    Chains of files with one include each are followed by doubling: a chain of n files takes log n rounds.
    """
    out = edges.groupBy(*GRAPH, "a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("t"))
    single = materialize(out.where("n = 1").drop("n"))
    longest = single.groupBy(*GRAPH).count().agg(F.max("count")).first()[0]
    if longest is None:
        return edges, None
    ends = _ends(single, longest.bit_length())
    onward = single.select(*GRAPH, F.col("a").alias("t"))
    has_more = out.select(*GRAPH, F.col("a").alias("t"))
    # 2^steps is more than any chain: who still is at a file with one include goes round in a ring.
    ringed = materialize(ends.join(sorted_side(onward), [*GRAPH, "t"], "left_semi"))
    dead = ends.join(sorted_side(has_more), [*GRAPH, "t"], "left_anti")
    gone = dead.select(*GRAPH, "a").unionByName(ringed.select(*GRAPH, "a"))
    left = edges.join(sorted_side(gone), [*GRAPH, "a"], "left_anti")
    heads = left.select(*GRAPH, F.col("a").alias("b")).distinct()
    return materialize(left.join(sorted_side(heads), [*GRAPH, "b"], "left_semi").select(*GRAPH, "a", "b")), ringed.select(*GRAPH, F.col("t").alias("file")).distinct()


def cycle_files(resolved: DataFrame) -> DataFrame:
    """(host, snapshot, file) of the files whose includes lead back to them.

    Files that lead to no cycle, or that none leads to, are peeled off from both ends until none is left; rings come
    off whole.  Only files of cycles that cross each other remain, and only they are followed pair by pair.
    """
    edges = resolved.select(*GRAPH, F.col("includer").alias("a"), F.col("included").alias("b")).distinct()
    found = [edges.where("a = b").select(*GRAPH, F.col("a").alias("file"))]
    edges = edges.where("a <> b")
    turned = lambda e: e.select(*GRAPH, F.col("b").alias("a"), F.col("a").alias("b"))
    size, kept_still = None, 0
    while kept_still < 2 and not edges.isEmpty():
        edges, ring = _peel(edges)
        if ring is not None:
            found.append(ring)
        now = edges.count()
        kept_still = kept_still + 1 if now == size else 0
        size, edges = now, turned(edges)
    if size:
        pairs = _closure(edges)
        found.append(pairs.where("root = file").select(*GRAPH, "file"))
    return reduce(DataFrame.unionByName, found).distinct()


def _closure(edges: DataFrame) -> DataFrame:
    """(root, file, depth): every file reached, with the fewest steps.

    Each round joins only the pairs that the round before reached first, and drops pairs already known, so cycles come
    to an end; the rounds are as many as the longest way.
    """
    pair = [*GRAPH, "root", "file"]
    out = frontier = edges.select(*GRAPH, F.col("a").alias("root"), F.col("b").alias("file"), F.lit(1).cast("bigint").alias("depth"))
    step = edges.select(*GRAPH, F.col("a").alias("file"), F.col("b").alias("_next"))
    level = 1
    while not frontier.isEmpty():
        level += 1
        reached = (frontier.where("root <> file").join(sorted_side(step), [*GRAPH, "file"])
                   .select(*GRAPH, "root", F.col("_next").alias("file"), F.lit(level).cast("bigint").alias("depth")).distinct())
        frontier = materialize(reached.join(sorted_side(out), pair, "left_anti").select(*pair, "depth"))
        out = out.unionByName(frontier)
    return out


def include_expand(files: DataFrame) -> DataFrame:
    """Every file reached from each file, with the fewest includes; ``cycle`` marks a way back."""
    edges = materialize(resolve_includes(include_edges(files), files)
                        .select(*GRAPH, F.col("includer").alias("a"), F.col("included").alias("b")).distinct())
    return _closure(edges).withColumn("cycle", F.col("root") == F.col("file"))


# --- blast radius ------------------------------------------------------------------------------

def _first_words(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(
        F.regexp_extract(x, r"^\s*(\S+)", 1), ";+$", "")), lambda w: w != "")


def _words(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def change_type(text: Column) -> Column:
    """First structure found; for bare directives the first listed one decides."""
    bare = without_hash(text)
    known = F.filter(_first_words(bare), lambda w: F.array_contains(_words(C.HTTP_DIRECTIVES + C.SERVER_DIRECTIVES), w))
    first = F.get(known, F.lit(0))
    return (F.when(bare.rlike(r"(?m)^\s*location\s+[^{]*\{"), F.lit("add_location_block"))
            .when(bare.rlike(r"(?m)^\s*server\s*\{"), F.lit("add_server_block"))
            .when(bare.rlike(r"(?m)^\s*http\s*\{"), F.lit("modify_http_block"))
            .when(bare.rlike(r"(?m)^\s*upstream\s+\S+\s*\{"), F.lit("add_upstream_block"))
            .when(F.array_contains(_words(C.HTTP_DIRECTIVES), first), F.lit("modify_http_directive"))
            .when(first.isNotNull(), F.lit("modify_server_directive"))
            .when(bare.rlike(r"\S"), F.lit("add_location_block")).otherwise(F.lit("unknown")))


def is_http_level(text: Column) -> Column:
    bare = without_hash(text)
    return bare.rlike(r"(?m)^\s*http\s*\{") | F.arrays_overlap(
        _first_words(bare), _words([d for d in C.HTTP_DIRECTIVES if d != "include"]))


def server_block_count(text: Column) -> Column:
    return F.regexp_count(without_hash(text), F.lit(r"(?<![\w-])server\s*\{")).cast("bigint")


def blast_radius(files: DataFrame) -> DataFrame:
    """Label and reach of a change to each file, from its content and who includes it."""
    counts = files.select("host", "snapshot_id", F.col("path").alias("includer"),
                          server_block_count(F.col("text")).alias("_blocks"))
    edges = (resolve_includes(include_edges(files), files)
             .where(~F.col("includer").rlike(r"(^|/)nginx\.conf$"))
             .select("host", "snapshot_id", "includer", F.col("included").alias("path")).distinct())
    users = (edges.join(sorted_side(counts), ["host", "snapshot_id", "includer"]).groupBy("host", "snapshot_id", "path")
             .agg(F.sum("_blocks").alias("_using"), F.count(F.lit(1)).alias("_includers")))
    bare = without_hash(F.col("text"))
    own = files.select(*ID, change_type(F.col("text")).alias("change_type"),
                       is_http_level(F.col("text")).alias("_http"),
                       server_block_count(F.col("text")).alias("_own"),
                       bare.rlike(r"(?m)^\s*location\s+[^{]*\{").alias("_loc"))
    j = own.join(sorted_side(users), ["host", "snapshot_id", "path"], "left")
    top = F.col("path").rlike(r"(^|/)nginx\.conf$") | F.col("_http")
    upstream = F.col("change_type") == "add_upstream_block"
    label = (F.when(top, F.lit("global-http"))
             .when(upstream & (F.col("_includers") > 1), F.lit("vhost-group"))
             .when(upstream & (F.col("_includers") == 1), F.lit("server-block"))
             .when(F.col("_includers") > 0, F.lit("include-file"))
             .when(F.col("_loc"), F.lit("exact-location")).otherwise(F.lit("server-block")))
    blocks = (F.when(top, F.lit(0)).when(F.col("_includers") > 0, F.col("_using"))
              .otherwise(F.greatest("_own", F.lit(1))))
    return j.select(*ID, "change_type", label.alias("blast_radius"), blocks.cast("bigint").alias("affected_server_blocks"),
                    F.coalesce("_includers", F.lit(0)).alias("including_files"))


def max_blast_radius(radii: DataFrame) -> DataFrame:
    """Broadest label per host and snapshot; a label off the list counts as unknown."""
    widest = F.max(S.ordinal(F.col("blast_radius"), C.RADIUS_ORDER, len(C.RADIUS_ORDER)))
    return (radii.groupBy("host", "snapshot_id").agg(
        S.label_of(widest, C.RADIUS_ORDER).alias("max_blast_radius"),
        F.max("affected_server_blocks").alias("max_server_blocks"))
        .withColumn("elevated", ~F.col("max_blast_radius").isin("exact-location", "server-block")))


# --- audit -------------------------------------------------------------------------------------

AUDIT = [
    ("tls_protocols", 5, r"(?m)^\s*ssl_protocols(\s+TLSv1\.[23])+\s*;"),
    ("cipher_list_set", 2, r"(?m)^\s*ssl_ciphers\s+\S"),
    ("server_ciphers_preferred", 1, r"(?m)^\s*ssl_prefer_server_ciphers\s+on\s*;"),
    ("server_tokens_off", 2, r"(?m)^\s*server_tokens\s+off\s*;"),
    ("body_size_set", 1, r"\bclient_max_body_size\b"),
    ("method_limit", 2, r"\$request_method\b"),
    ("rate_limit", 2, r"\blimit_req\b"),
    ("hardening_included", 3, r"include\s+\S*security\S*\.conf"),
    ("access_log_present", 1, r"\baccess_log\b"),
]
AUDIT_ABSENT = [
    ("autoindex_off", 3, r"\bautoindex\s+on\b"),
    ("server_tokens_not_on", 3, r"\bserver_tokens\s+on\b"),
    ("merge_slashes_on", 1, r"\bmerge_slashes\s+off\b"),
    ("no_wildcard_name", 2, r"\bserver_name\s+[^;]*\*"),
]
HEADER_WEIGHT = 4


def static_audit(parsed: DataFrame) -> DataFrame:
    """One row per (file, check) with its weight; the catalogue is a fixed list of literals."""
    text = F.col("clean")
    entry = lambda n, w, ok: F.struct(F.lit(n).alias("check_name"), F.lit(w).cast("bigint").alias("weight"), ok.alias("passed"))
    checks = [entry(n, w, text.rlike(rx)) for n, w, rx in AUDIT]
    checks += [entry(n, w, ~text.rlike(rx)) for n, w, rx in AUDIT_ABSENT]
    checks += [entry("header:" + h, HEADER_WEIGHT, text.contains(f'add_header {h} "{v}"'))
               for h, v in C.EXPECTED_HEADER_VALUES.items()]
    return parsed.select(*ID, F.inline(F.array(*checks)))


def audit_score(audit: DataFrame, profile: str = "edge-public") -> DataFrame:
    """100 x passed weight / total weight per file, against the profile's bar."""
    bar = C.PROFILE_PASS_SCORE.get(profile, C.DEFAULT_PASS_SCORE)
    score = F.round(100 * F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0)) / F.sum("weight"), 2)
    return audit.groupBy(*ID).agg(score.alias("score")).withColumn("passes", F.col("score") >= bar)


def profile_detect(files: DataFrame) -> DataFrame:
    """Environment profile of each host and snapshot; no clear sign gives edge-public."""
    t = F.col("text")
    has = lambda rx: F.bool_or(t.rlike(rx))
    seen = files.groupBy("host", "snapshot_id").agg(
        has(r"\blimit_req\b").alias("req"), has(r"\blimit_conn\b").alias("conn"),
        has(r"\bclient_max_body_size\b").alias("body"),
        has(r"\blisten\s+(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)").alias("private"),
        has(r"\bproxy_pass\b").alias("proxy"), has(r"\blimit_req_zone\b").alias("zone"),
        has(r"\b(root|try_files)\b").alias("static"))
    profile = (F.when(F.col("proxy"), F.lit("reverse-proxy-app")).when(F.col("zone"), F.lit("edge-public"))
               .when(F.col("static"), F.lit("static-site")).when(F.col("private"), F.lit("internal-only"))
               .when(F.expr("req AND conn AND body"), F.lit("api-gateway")).otherwise(F.lit("edge-public")))
    return seen.select("host", "snapshot_id", profile.alias("profile"))


IN_FILE_CHECKS = {
    "acme_paths": _mark_acme, "health_endpoints": _mark_health, "proxy_headers": _mark_proxy_headers,
    "websocket_upgrade": _mark_websocket, "duplicate_directives": _mark_duplicates,
    "header_inheritance": _mark_header_inheritance, "location_precedence": _mark_precedence,
    "deny_allow_conflicts": _mark_deny_allow,
}


def compat_check(parsed: DataFrame, name: str) -> DataFrame:
    return IN_FILE_CHECKS[name](parsed).select(*ID, f"c_{name}.*")


def compat_checks(parsed: DataFrame) -> DataFrame:
    """All nine checks, one row per (file, check).

    The eight that look at one file at a time are columns of a single pass over the corpus.
    """
    marked = parsed
    for mark in IN_FILE_CHECKS.values():
        marked = mark(marked)
    return (marked.select(*ID, F.inline(F.array(*[F.col(f"c_{n}") for n in IN_FILE_CHECKS])))
            .unionByName(compat_includes(parsed)))


def check_overall(checks: DataFrame) -> DataFrame:
    """Worst status per file under every profile: a failure only warns where it is not critical."""
    critical = F.create_map(*[x for p, cs in C.PROFILE_CRITICAL_CHECKS.items()
                              for x in (F.lit(p), F.array(*[F.lit(c) for c in cs]))])
    each = checks.withColumn("profile", F.explode(F.array(*[F.lit(p) for p in C.PROFILES])))
    is_critical = F.array_contains(F.element_at(critical, F.col("profile")), F.col("check_name"))
    rank = F.when((F.col("status") == "fail") & is_critical, 3).when(F.col("status").isin("fail", "warn"), 2).otherwise(1)
    return (each.groupBy(*ID, "profile").agg(F.max(rank).alias("_r"))
            .withColumn("overall", S.label_of(F.col("_r"), ["pass", "warn", "fail"])).drop("_r"))


def deploy_gate(checks: DataFrame, overall: DataFrame, profile: str, by_path: dict[str, DataFrame],
                by_host: dict[str, DataFrame]) -> DataFrame:
    """Per (host, path) of either snapshot: blocked when anything about the change fails.

    ``checks`` holds (host, path, check_name, status) of all invariants, ``overall`` compatibility per
    profile.  ``by_path`` and ``by_host`` name a reason and the paths or hosts it blocks: expired
    exceptions, invalid records, destructive commands.
    """
    bad = checks.where("status = 'fail'").select("host", "path", F.concat(F.lit("invariant:"), "check_name").alias("reason"))
    bad = bad.unionByName(overall.where((F.col("profile") == profile) & (F.col("overall") == "fail"))
                          .select("host", "path", F.lit("compat:critical").alias("reason")))
    targets = checks.select("host", "path").distinct()
    for key, blocks in (("path", by_path), ("host", by_host)):
        for reason, rows in blocks.items():
            bad = bad.unionByName(targets.join(rows.select(key).distinct(), key, "left_semi")
                                  .select("host", "path", F.lit(reason).alias("reason")))
    reasons = bad.distinct().groupBy("host", "path").agg(F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("reasons"))
    return (targets.join(sorted_side(reasons), ["host", "path"], "left")
            .select("host", "path", F.col("reasons").isNotNull().alias("blocked"), F.coalesce("reasons", F.lit("")).alias("reasons")))
