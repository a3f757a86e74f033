"""Findings, exceptions, learnings, recipes: validated, joined, aged, compacted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import catalog as C
from palisade.functions import sanitize as S
from palisade.operators.numbering import number_rows
from palisade.sources.records import item_maps, once, record_fields

# --- record validation -------------------------------------------------------------------------


def iso_date(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def _has(n):
    return F.col(f"f_{n}").isNotNull()


def _val(n):
    return F.col(f"f_{n}")["value"]


def _kind(n):
    return F.col(f"f_{n}")["kind"]


def _require(fields):
    return [F.when(~_has(f), F.lit(f"missing:{f}")) for f in fields]


def _enum(n, allowed):
    return F.when(_has(n) & ~((_kind(n) == "string") & _val(n).isin(*allowed)), F.lit(f"enum:{n}"))


def _pattern(n, regex):
    return F.when(_has(n) & ~((_kind(n) != "list") & _val(n).rlike(regex)), F.lit(f"format:{n}"))


def _filled(n):
    return F.when(_has(n) & ~((_kind(n) == "string") & (F.trim(_val(n)) != "")), F.lit(f"empty:{n}"))


def _typed(n, kind):
    return F.when(_has(n) & (_kind(n) != kind), F.lit(f"type:{n}"))


def _date(n):
    return F.when(_has(n) & iso_date(_val(n)).isNull(), F.lit(f"date:{n}"))


def exception_rules() -> list[Column]:
    late = iso_date(_val("review_by")) > F.date_add(iso_date(_val("created_at")), 365)
    return _require(C.EXCEPTION_FIELDS) + [
        _pattern("exception_id", r"^EXC-\d{4}$"), _pattern("finding_id", r"^NH-"),
        _filled("reason"), _filled("compensating_control"),
        _enum("severity_tier", C.SEVERITY_TIERS), _enum("scope", C.SCOPES),
        _date("created_at"), _date("last_reviewed_at"), _date("review_by"),
        F.when(late, F.lit("too_long:review_by"))]


def learning_rules() -> list[Column]:
    count_ok = (_kind("hit_count") == "int") & (
        F.regexp_replace(_val("hit_count"), "_", "").try_cast("bigint") >= 0)
    # Booleans count as integers, as they do where records are written.
    return _require(C.LEARNING_FIELDS) + [
        _enum("type", C.LEARNING_TYPES), _enum("status", C.LEARNING_STATUSES),
        _enum("source", C.LEARNING_SOURCES), _date("discovered"), _typed("finding_ids", "list"),
        F.when(_has("hit_count") & ~F.coalesce(count_ok, F.lit(False)) & (_kind("hit_count") != "bool"),
               F.lit("range:hit_count"))]


def recipe_rules() -> list[Column]:
    return _require(C.RECIPE_FIELDS) + [
        _pattern("name", r"^[a-z0-9]+(-[a-z0-9]+)*$"), _filled("description"),
        _enum("profile", C.PROFILES), _pattern("execution_class", r"^[RWX]\d(\+[RWX]\d)*$"),
        _typed("requires_network", "bool"), _typed("requires_remote_exec", "bool"),
        _typed("allows_emergency_mode", "bool"), _typed("required_env_vars", "list"),
        _typed("confirmation_checkpoints", "list"), _typed("outputs", "list"), _typed("steps", "list"),
        F.when((_kind("steps") == "list") & (F.size(F.col("f_steps")["items"]) == 0), F.lit("empty:steps")),
        _enum("max_privilege_level", C.PRIVILEGES), _enum("schedule_mode", C.SCHEDULES)]


def finding_rules(underscore_ids: bool = False, four_digits: bool = False) -> list[Column]:
    """Numbers go on past four digits where ids are handed out; ``four_digits`` refuses those."""
    category = "[A-Z_]+" if underscore_ids else "[A-Z]+"
    number_of = r"\d{4}" if four_digits else r"\d{4,}"
    number = F.when(_kind("confidence").isin("int", "float"), _val("confidence").try_cast("double"))
    in_range = F.coalesce(number.between(0.0, 1.0), F.lit(False)) | (_kind("confidence") == "bool")
    return _require(C.FINDING_FIELDS) + [
        _pattern("finding_id", rf"^NH-(AUDIT|LOG|IOC)-{category}-{number_of}$"), _filled("category"),
        _enum("severity", C.SEVERITY_ORDER), F.when(_has("confidence") & ~in_range, F.lit("range:confidence")),
        _typed("source_layers", "list"), _enum("scope", C.SCOPES), _enum("blast_radius", C.RADIUS_ORDER),
        _filled("recommended_action"), _enum("rule_class", ["A", "B", "C", "D"]),
        _typed("requires_live_test", "bool"), _typed("exception_eligible", "bool"),
        _typed("linked_artifacts", "list")]


def cross_rules(kind: str) -> list[Column]:
    """Rules that hold between fields; switched on by ``strict``."""
    if kind == "exception":
        return [F.when(iso_date(_val("last_reviewed_at")) < iso_date(_val("created_at")), F.lit("cross:reviewed_before_created")),
                F.when((_val("scope") == "global") & (_val("severity_tier") != "critical"), F.lit("cross:global_needs_critical"))]
    if kind == "finding":
        return [F.when((_val("blast_radius") == "unknown-shared") & (_val("requires_live_test") != "true"), F.lit("cross:needs_live_test"))]
    if kind == "recipe":
        return [F.when(_val("execution_class").rlike("[WX]") & (F.size(F.col("f_confirmation_checkpoints")["items"]) == 0)
                       & (_val("schedule_mode") == "manual"), F.lit("cross:needs_checkpoints")),
                F.when(_exceeds(), F.lit("cross:step_privilege")),
                F.when((_kind("steps") == "list") & F.exists("_steps", lambda m: ~F.coalesce(_action(m).isin(*C.STEP_PRIVILEGES), F.lit(False))),
                       F.lit("cross:step_action")),
                F.when(F.exists(F.col("f_required_env_vars")["items"], lambda v: ~v.rlike("^[A-Za-z_][A-Za-z0-9_]*$")), F.lit("cross:env_values")),
                F.when((_kind("outputs") == "list") & (F.size(F.col("f_outputs")["items"]) == 0), F.lit("cross:no_outputs")),
                F.when((_val("allows_emergency_mode") == "true") & F.exists("_steps", lambda m: ~_class_a(m)), F.lit("cross:emergency_class"))]
    return []


def _action(step: Column) -> Column:
    return F.get(F.try_element_at(step, F.lit("action")), F.lit(0))


def _param(step: Column, name: str) -> Column:
    return F.get(F.try_element_at(step, F.lit(f"params.{name}")), F.lit(0))


def _exceeds() -> Column:
    """Whether a step needs more than the recipe's highest privilege; reloading needs the highest of all."""
    level = lambda p: S.ordinal(p, C.PRIVILEGES, 0)
    needed = F.create_map(*[F.lit(x) for kv in C.STEP_PRIVILEGES.items() for x in kv])
    of_step = lambda m: F.when((_action(m) == "deploy") & (F.lower(_param(m, "reload_nginx")) == "true"), F.lit("X1")).otherwise(
        F.try_element_at(needed, _action(m)))
    allowed = level(_val("max_privilege_level"))
    return (allowed > 0) & F.exists("_steps", lambda m: F.coalesce(level(of_step(m)) > allowed, F.lit(False)))


def _class_a(step: Column) -> Column:
    """Steps fit for emergencies: those that only read, and rollouts of class A rules."""
    reads = F.array(*[F.lit(a) for a, p in C.STEP_PRIVILEGES.items() if p.startswith("R")])
    return F.coalesce(F.array_contains(reads, _action(step)) | ((_action(step) == "deploy") & (_param(step, "rule_class") == "A")), F.lit(False))


RULES = {"exception": (C.EXCEPTION_FIELDS, exception_rules), "learning": (C.LEARNING_FIELDS, learning_rules),
         "recipe": (C.RECIPE_FIELDS, recipe_rules), "finding": (C.FINDING_FIELDS, finding_rules)}


def validate(records: DataFrame, kind: str, strict: bool = False) -> DataFrame:
    """``errors`` and ``valid`` per record; narrow, one pass over the text."""
    fields, rules = RULES[kind]
    parsed = record_fields(records, fields, nested=strict)
    if strict and kind == "recipe":
        parsed = parsed.withColumn("_steps", item_maps("f_steps.items"))
    checks = rules() + (cross_rules(kind) if strict else [])
    checked = parsed.withColumn("errors", F.concat("parse_errors", F.array_compact(F.array(*checks))))
    return once(checked, parsed.columns).withColumn("valid", F.size("errors") == 0).drop("_steps")


# --- exceptions --------------------------------------------------------------------------------

def exception_state(exceptions: DataFrame, as_of: str) -> DataFrame:
    """Newest version of each exception and where it stands; ``max_by`` combines before the shuffle.

    A review date that is no date makes the state ``invalid`` and ends nothing.
    """
    cols = [c for c in exceptions.columns if c != "exception_id"]
    newest = exceptions.groupBy("exception_id").agg(F.max_by(
        F.struct(*cols), F.struct("last_reviewed_at", "ord")).alias("x")).select("exception_id", "x.*")
    left = F.datediff(iso_date(F.col("review_by")), F.to_date(F.lit(as_of))).cast("bigint")
    notice = (F.when(F.col("severity_tier") == "critical", 90).when(F.col("severity_tier") == "high", 60).otherwise(30))
    state = (F.when(left.isNull(), F.lit("invalid")).when(left < 0, F.lit("expired"))
             .when(left <= notice, F.lit("expiring")).otherwise(F.lit("active")))
    return newest.withColumns({"days_left": left, "state": state}).withColumn(
        "blocks", (F.col("state") == "expired") & (F.col("severity_tier") == "critical"))


def exception_suppress(findings: DataFrame, exceptions: DataFrame, as_of: str) -> DataFrame:
    """Findings no live exception covers; exceptions aimed at invariants never count.

    Only the newest version of an exception counts, and only with a review date that is one.
    """
    live = exception_state(exceptions, as_of).where(F.col("state").isin("active", "expiring") & (F.col("target_kind") == "finding"))
    return findings.join(live.select("finding_id").distinct(), "finding_id", "left_anti")


def validation_rollup(validated: DataFrame, states: DataFrame) -> DataFrame:
    checked = validated.agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid"),
                            F.count_if(~F.col("valid")).alias("invalid"))
    aged = states.agg(F.struct(F.count_if(F.col("state") == "expired").alias("expired"),
                               F.count_if(F.col("state") == "expiring").alias("expiring")).alias("aged"))
    return checked.withColumn("_aged", aged.scalar()).select("total", "valid", "invalid", "_aged.expired", "_aged.expiring")


# --- findings ----------------------------------------------------------------------------------

# Numbers grow past four digits: an id ends where its digits end.
FINDING_ID = r"(NH-[A-Z]+-[A-Z_]+-\d{4,})"


def finding_id_assign(new: DataFrame, existing_ids: DataFrame) -> DataFrame:
    """Next free ``NH-SOURCE-CATEGORY-NNNN`` for every new row, numbered on from the highest taken."""
    parts = r"^NH-([A-Z]+)-([A-Z_]+)-(\d{4,})$"
    taken = (existing_ids.where(F.col("finding_id").rlike(parts))
             .groupBy(F.regexp_extract("finding_id", parts, 1).alias("source"),
                      F.regexp_extract("finding_id", parts, 2).alias("category"))
             .agg(F.max(F.regexp_extract("finding_id", parts, 3).cast("bigint")).alias("_top")))
    numbered = number_rows(new, "ord", ["source", "category"], into="_n")
    n = (F.col("_n") + F.coalesce("_top", F.lit(0))).cast("string")
    padded = F.lpad(n, F.greatest(F.length(n), F.lit(4)), F.lit("0"))
    return (numbered.join(taken, ["source", "category"], "left")
            .withColumn("finding_id", F.concat_ws("-", F.lit("NH"), "source", "category", padded))
            .drop("_n", "_top"))


def finding_trace(notes: DataFrame) -> DataFrame:
    """Every (file, line) that names a finding id, with the line's first 200 characters."""
    lines = notes.select("file", F.posexplode(F.split("text", "\n")).alias("_i", "_line"))
    ids = F.array_distinct(F.regexp_extract_all("_line", F.lit(FINDING_ID), F.lit(1)))
    return lines.where(F.col("_line").contains("NH-")).select(
        F.explode(ids).alias("finding_id"), "file", (F.col("_i") + 1).cast("bigint").alias("line"),
        F.substring(F.trim("_line"), 1, 200).alias("context"))


def lifecycle_status(notes: DataFrame) -> DataFrame:
    """Highest stage any file naming the id gives evidence for; flags are per file, not per line."""
    low = F.lower("text")
    flags = {s: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
             for s, words in C.STAGE_KEYWORDS.items()}
    flagged = notes.withColumns(flags)
    lines = flagged.select("file", *flags, F.posexplode(F.split("text", "\n")).alias("_i", "_line"))
    ids = F.array_distinct(F.regexp_extract_all("_line", F.lit(FINDING_ID), F.lit(1)))
    day = F.coalesce(F.nullif(F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")),
                     F.nullif(F.regexp_extract("_line", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    refs = lines.where(F.col("_line").contains("NH-")).select(
        F.explode(ids).alias("finding_id"), *flags, F.struct("file", "_i", day.alias("d")).alias("ref"))
    found = refs.groupBy("finding_id").agg(
        *[F.bool_or(s).alias(s) for s in flags],
        F.min(F.when(F.col("ref.d").isNotNull(), F.col("ref"))).alias("ref"),
        F.count(F.lit(1)).alias("references"))
    stage = (F.when(F.col("promoted"), F.lit("promoted")).when(F.col("deployed"), F.lit("deployed"))
             .when(F.col("staged"), F.lit("staged")).otherwise(F.lit("discovered")))
    return found.select("finding_id", stage.alias("lifecycle"),
                        F.coalesce("ref.d", F.lit("unknown")).alias("day"), "references")


def finding_rollup(findings: DataFrame) -> DataFrame:
    return (findings.rollup("severity", "blast_radius").agg(F.count(F.lit(1)).alias("findings"))
            .select(F.coalesce("severity", F.lit("(all)")).alias("severity"),
                    F.coalesce("blast_radius", F.lit("(all)")).alias("blast_radius"), "findings"))


def auto_accept(findings: DataFrame, threshold: str) -> DataFrame:
    """Findings at or below a severity, by rank and not by name."""
    rank = S.ordinal(F.col("severity"), C.SEVERITY_ORDER)
    return findings.where(rank >= C.SEVERITY_ORDER.index(threshold) + 1)


def profile_allowed(findings: DataFrame) -> DataFrame:
    """Findings a profile may act on; class D is in no profile's list."""
    allowed = F.create_map(*[x for p, cs in C.PROFILE_RULE_CLASSES.items()
                             for x in (F.lit(p), F.array(*[F.lit(c) for c in cs]))])
    return (findings.withColumn("profile", F.explode(F.array(*[F.lit(p) for p in C.PROFILES])))
            .where(F.array_contains(F.element_at(allowed, F.col("profile")), F.col("rule_class"))))


def change_order(changes: DataFrame) -> DataFrame:
    """Changes per target file, narrowest blast radius first."""
    rank = S.ordinal(F.col("blast_radius"), C.RADIUS_ORDER)
    w = Window.partitionBy("target_file").orderBy(rank)
    return changes.withColumn("step", F.dense_rank().over(w).cast("bigint"))


def new_since_last_run(findings: DataFrame, keys: list[str], run: str) -> DataFrame:
    """Keys of this run: unseen before (new) or seen (resurfaced); one shuffle for both answers."""
    here = F.bool_or(F.col("run_id") == run)
    before = F.bool_or(F.col("run_id") < run)
    return (findings.groupBy(*keys).agg(here.alias("_here"), before.alias("_before")).where("_here")
            .select(*keys, F.when(F.col("_before"), F.lit("resurfaced")).otherwise(F.lit("new")).alias("status")))


# --- learnings ---------------------------------------------------------------------------------

def _stale(as_of: str) -> Column:
    day = iso_date(F.col("discovered"))
    return (F.col("status") == "draft") & F.coalesce(day < F.date_sub(F.to_date(F.lit(as_of)), 30), F.lit(False))


def learning_compact(learnings: DataFrame, as_of: str, shown_ips: int = 50) -> DataFrame:
    """Merge per class, archive stale drafts, keep promoted rows as they are; ``action`` says which.

    ``source_ips`` shows the first addresses by rule; ``learning_addresses`` has all of them.  A draft
    whose date cannot be read is not stale.
    """
    promoted, stale = F.col("status") == "promoted", _stale(as_of)
    rest = learnings.where(~promoted & ~stale)
    ips = (learning_addresses(learnings, as_of, shown_ips).where("shown").groupBy("path_class")
           .agg(F.array_join(F.array_sort(F.collect_list("source_ip")), ",").alias("source_ips")))
    merged = rest.groupBy("path_class").agg(
        F.sum("hit_count").alias("hit_count"), F.min("discovered").alias("discovered"),
        F.max("last_seen").alias("last_seen"), F.count(F.lit(1)).alias("merged"))
    whole = learnings.where(promoted | stale).select(
        "learning_id", "path_class", "hit_count", "discovered", "last_seen",
        F.lit(1).cast("bigint").alias("merged"), F.col("source_ip").alias("source_ips"),
        F.when(promoted, F.lit("kept")).otherwise(F.lit("archived")).alias("action"))
    return (merged.join(ips, "path_class", "left").withColumn("learning_id", F.concat(F.lit("merged-"), "path_class"))
            .withColumn("action", F.lit("merged")).unionByName(whole))


def learning_addresses(learnings: DataFrame, as_of: str, shown_ips: int = 50) -> DataFrame:
    """Every (class, address) of merged rows; ``shown`` marks the first ones of a class.

    The first ones are found by a rank whose limit applies before the shuffle, so a class seen
    everywhere does not gather its rows in one task.
    """
    rest = learnings.where((F.col("status") != "promoted") & ~_stale(as_of))
    every = rest.select("path_class", "source_ip").distinct()
    rank = F.row_number().over(Window.partitionBy("path_class").orderBy("source_ip"))
    first = (every.withColumn("_r", rank).where(F.col("_r") <= shown_ips)
             .groupBy("path_class").agg(F.max("source_ip").alias("_last")))
    return every.join(first, "path_class").select(
        "path_class", "source_ip", F.coalesce(F.col("source_ip") <= F.col("_last"), F.lit(True)).alias("shown"))


def compaction_record(learnings: DataFrame, compacted: DataFrame) -> DataFrame:
    """Rows before and after, and how many were merged, kept and archived."""
    after = compacted.agg(
        F.count_if(F.col("action") != "archived").alias("rows_after"),
        F.coalesce(F.sum(F.when(F.col("action") == "merged", F.col("merged"))), F.lit(0)).alias("merged"),
        F.count_if(F.col("action") == "kept").alias("kept"), F.count_if(F.col("action") == "archived").alias("archived"))
    before = learnings.agg(F.count(F.lit(1)).alias("rows_before"))
    return after.withColumn("rows_before", before.scalar())


def compaction_check(learnings: DataFrame, compacted: DataFrame, as_of: str) -> DataFrame:
    """Totals and first dates per class before and after; ``ok`` must hold everywhere."""
    stale = _stale(as_of)
    compacted = compacted.where("action <> 'archived'")
    sums = lambda df, s: df.groupBy("path_class").agg(
        F.sum("hit_count").alias(f"hits_{s}"), F.min("discovered").alias(f"first_{s}"))
    both = sums(learnings.where(~stale), "before").join(sums(compacted, "after"), "path_class", "full")
    return both.withColumn("ok", F.col("hits_before").eqNullSafe(F.col("hits_after"))
                           & F.col("first_before").eqNullSafe(F.col("first_after")))


def learning_rollup(learnings: DataFrame) -> DataFrame:
    return learnings.groupBy("type", "status").agg(
        F.count(F.lit(1)).alias("learnings"), F.sum("hit_count").alias("hits"), F.max("last_seen").alias("last_seen"))


def promote_learnings(learnings: DataFrame, deployed: DataFrame, requested: DataFrame) -> DataFrame:
    """Next table version: deployed drafts turn active, requested actives promoted, drafts refused."""
    marked = (learnings.join(deployed.withColumn("_live", F.lit(True)), "learning_id", "left")
              .join(requested.withColumn("_ask", F.lit(True)), "learning_id", "left"))
    live, ask = F.col("_live").isNotNull(), F.col("_ask").isNotNull()
    status = F.col("status")
    return (marked.withColumn("next_status",
                              F.when((status == "active") & ask, F.lit("promoted"))
                              .when((status == "draft") & live, F.lit("active")).otherwise(status))
            .withColumn("refused", (status == "draft") & ask).drop("_live", "_ask"))


def changelog_append_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old lines that are gone from the new version, each as often as it is missing.

    Counted as +1 / -1 in one aggregation, so a line repeated a billion times stays one row.
    """
    signed = old.select("line", F.lit(1).alias("_n")).unionByName(new.select("line", F.lit(-1).alias("_n")))
    return signed.groupBy("line").agg(F.sum("_n").alias("missing")).where("missing > 0")


# --- rollouts ----------------------------------------------------------------------------------

def rollout_outcome(checks: DataFrame) -> DataFrame:
    """Hosts up to the first failing one pass, that one fails, later ones are skipped.

    The stopping point is one aggregated row per deployment, joined back; no deployment's rows
    are gathered in a window, so a huge rollout is an ordinary skewed join that AQE splits.
    """
    wanted = F.when(F.col("check_name") == "deny_check", 404).otherwise(200)
    failed = F.col("code") != wanted
    hosts = checks.groupBy("deployment", "host", "host_order").agg(
        F.min(F.when(failed, F.struct("check_order", "check_name"))).alias("_bad"))
    stops = hosts.groupBy("deployment").agg(
        F.min(F.when(F.col("_bad").isNotNull(), F.col("host_order"))).alias("_stop"),
        F.min("host_order").alias("_first"))
    joined = hosts.join(stops, "deployment")
    status = (F.when(F.col("host_order") == F.col("_stop"), F.lit("fail"))
              .when(F.col("host_order") > F.col("_stop"), F.lit("skipped")).otherwise(F.lit("pass")))
    return joined.select(
        "deployment", "host",
        F.when(F.col("host_order") == F.col("_first"), F.lit("canary")).otherwise(F.lit("follower")).alias("role"),
        status.alias("status"), F.when(status == "fail", F.col("_bad.check_name")).alias("phase"),
        (status == "fail").alias("rollback_needed"))
