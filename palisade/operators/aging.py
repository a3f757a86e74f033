"""Blocking rules out of configs, and how much traffic still hits them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import catalog as C
from palisade.operators.detect import rule_classes_of


def lines_of(files: DataFrame) -> DataFrame:
    """(file columns, line_number, line); one file is one row, so a line list is never larger."""
    return (files.select("file_id", "host", "path", "snapshot_id",
                         F.posexplode(F.split("text", "\n")).alias("_i", "raw"))
            .withColumn("line_number", (F.col("_i") + 1).cast("bigint"))
            .withColumn("line", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))).drop("_i"))


def infer_category(comment: Column, pattern: Column) -> Column:
    lowered = F.lower(pattern)
    out = F.when(F.lit(False), F.lit(""))
    for word, category in C.COMMENT_KEYWORDS:
        out = out.when(comment.contains(word), F.lit(category))
    return (
        out.when(pattern.contains("\\.") & lowered.contains("env"), F.lit("env_variants"))
        .when(pattern.contains("/\\."), F.lit("dotfile"))
        .when(pattern.contains(".map$"), F.lit("source_map"))
        .when(lowered.contains(".php"), F.lit("php"))
        .when(lowered.contains("wp-"), F.lit("wordpress"))
        .when(lowered.contains("actuator"), F.lit("actuator"))
        .when(lowered.contains("swagger") | lowered.contains("api-docs"), F.lit("swagger"))
        .when(lowered.contains("debug") | lowered.contains("trace"), F.lit("debug_tools"))
        .when(lowered.contains("admin"), F.lit("admin_panel"))
        .otherwise(F.lit("uncategorized")))


def extract_rules(files: DataFrame) -> DataFrame:
    """Location rules that block, with the category named by the comment right above.

    Windows are per file.  A comment holds until any other non-blank line; the action is the first
    blocking line after the location and before the next line with a closing brace.
    """
    w = Window.partitionBy("file_id").orderBy("line_number")
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    line = F.col("line")
    text = F.lower(F.trim(F.coalesce(
        F.nullif(F.regexp_extract("line", r"^#\s*Block\s+(.+)$", 1), F.lit("")),
        F.regexp_extract("line", r"^#\s*(.+)$", 1))))
    is_comment = line.startswith("#")
    names = is_comment & ~line.rlike(r"^#\s*aging:") & line.rlike(r"^#\s*\S")
    # state after a line: a naming comment sets it, other text clears it, the rest leaves it.
    state = F.when(names, F.struct(text.alias("c"))).when(
        ~is_comment & (line != ""), F.struct(F.lit(None).cast("string").alias("c")))
    action = (F.when(line.contains("return 404") | line.contains("return 403"), F.lit("return_404"))
              .when(line.contains("deny all"), F.lit("deny_all")))
    close = F.when(line.contains("}"), F.col("line_number"))
    act = F.when(action.isNotNull() & ~line.contains("}"), F.struct(
        F.col("line_number").alias("n"), action.alias("a")))
    marked = lines_of(files).withColumns({
        "_before": F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_close": F.first(close, ignorenulls=True).over(ahead),
        "_act": F.first(act, ignorenulls=True).over(ahead)})
    shape = r"^location\s+(~\*?|=|)\s*(.+?)\s*\{"
    return (marked.where(line.rlike(shape) & F.col("_act").isNotNull()
                         & (F.col("_close").isNull() | (F.col("_act.n") < F.col("_close"))))
            .withColumns({"modifier": F.regexp_extract("line", shape, 1),
                          "pattern": F.regexp_extract("line", shape, 2),
                          "action": F.col("_act.a"), "comment": F.col("_before.c")})
            .withColumn("category", infer_category(F.col("comment"), F.col("pattern")))
            .select("file_id", "host", "path", "snapshot_id", "line_number", "category", "pattern",
                    "modifier", "action", "comment"))


def recommendation(hits: Column) -> Column:
    """Never "remove": taking a rule out is a human decision."""
    return F.when(hits > 3, F.lit("keep")).when(hits > 0, F.lit("monitor")).otherwise(F.lit("review"))


def rule_staleness(rules: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits per rule through its category's classes.

    ``hits`` has one row per class (33 at most), so it is broadcast; categories are far fewer than
    rules, so their totals are built once and broadcast too.
    """
    wanted = (rules.select("category").distinct()
              .withColumn("path_class", F.explode(rule_classes_of(F.col("category")))))
    totals = (wanted.join(F.broadcast(hits), "path_class", "left").groupBy("category")
              .agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits_in_period")))
    n = F.col("hits_in_period")
    common = F.col("category").isin(*C.COMMONLY_ATTACKED)
    reason = (F.when(n > 3, F.concat(F.lit("Active: "), n.cast("string"), F.lit(" hits in period")))
              .when(n > 0, F.concat(F.lit("Low activity: "), n.cast("string"),
                                    F.lit(" hits in period — may be declining")))
              .when(common, F.lit("No hits in analysis period (commonly-attacked category)"))
              .otherwise(F.lit("No hits in analysis period")))
    return rules.join(totals, "category").withColumns({
        "recommendation": recommendation(n), "reason": reason})


def staleness_summary(stale: DataFrame) -> DataFrame:
    kind = F.col("recommendation")
    return stale.agg(F.count(F.lit(1)).alias("total_rules"),
                     F.count_if(kind == "keep").alias("active_rules"),
                     F.count_if(kind == "review").alias("stale_rules"),
                     F.count_if(kind == "monitor").alias("monitor_rules"))


def category_coverage(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Share of the attack classes each host has a rule for.  ``categories`` is the closed list."""
    listed = F.broadcast(categories)
    have = (rules.select("host", F.explode(rule_classes_of(F.col("category"))).alias("path_class"))
            .distinct().join(listed, "path_class", "left_semi"))
    total = categories.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = have.groupBy("host").agg(F.count(F.lit(1)).alias("covered"))
    return (rules.select("host").distinct().join(counted, "host", "left")
            .withColumn("covered", F.coalesce("covered", F.lit(0)))
            .withColumn("coverage", F.round(F.col("covered") / total, 6)))
