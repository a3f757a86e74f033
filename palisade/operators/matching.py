"""Theta joins re-expressed as equi-joins, so no pair is built that cannot match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.patterns import FOLD_FROM, FOLD_TO, folded, read_locations, read_patterns
from palisade.session import materialize

GRAM = 3


def prefix_join(texts: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """(text, prefix) where the text starts with the prefix; both inputs hold distinct values.

    Each text is cut once per prefix length in use (values are at most 200 long, so at most 200
    lengths) and joined on the cut itself.
    """
    lengths = prefixes.agg(F.collect_set(F.length(prefix)).alias("l")).scalar()
    cuts = (texts.select(text, F.explode(lengths).alias("_n"))
            .where(F.col("_n") <= F.length(text))
            .withColumn("_cut", F.substring(F.col(text), F.lit(1), F.col("_n"))))
    return cuts.join(prefixes.select(prefix), F.col("_cut") == F.col(prefix)).select(text, prefix)


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str,
                  gram: int = GRAM) -> DataFrame:
    """(text, needle) where the text holds the needle, ignoring case; inputs hold distinct values.

    Texts are indexed by their grams.  Every needle is looked up by its rarest gram, so a needle
    that begins with a common word does not meet every text; ``contains`` then decides.
    """
    def grams(col: str, n):
        return F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(col) - n + 1, F.lit(1))),
            lambda i: F.lower(F.substring(F.col(col), i, n))))

    sized = needles.where(F.length(needle) > 0).withColumn(
        "_size", F.least(F.length(needle), F.lit(gram)))
    sizes = sized.agg(F.collect_set("_size").alias("s")).scalar()
    index = (texts.withColumn("_size", F.explode(sizes)).where(F.length(text) >= F.col("_size"))
             .withColumn("_gram", F.explode(grams(text, F.col("_size")))).select(text, "_gram"))
    frequency = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_freq"))
    rarest = (sized.withColumn("_gram", F.explode(grams(needle, F.col("_size"))))
              .join(frequency, "_gram", "left")
              .groupBy(needle).agg(F.min_by("_gram", F.coalesce("_freq", F.lit(0))).alias("_gram")))
    return (index.join(rarest, "_gram")
            .where(F.contains(F.lower(text), F.lower(needle))).select(text, needle))


#: Parts into which the texts of a common gram are dealt, so that it is no single task's work.
SALTS = 32


def regex_join(texts: DataFrame, text: str, patterns: DataFrame, pattern: str,
               ignore_case: str) -> DataFrame:
    """(text, pattern, ignore_case) where the data-driven regex is found in the text.

    Each distinct regex is read once.  Texts are indexed by their grams and a regex is looked up by the rarest
    gram of each of the literals of which a match holds one, so it meets only texts that hold such a gram;
    the literal and then the regex itself decide, in the JVM.  A regex without any literal has the empty
    gram, which every text has.  A broken regex matches nothing, where the JVM engine would fail the job.
    """
    read = materialize(patterns.select(pattern, ignore_case).distinct().select(
        pattern, ignore_case, read_patterns(pattern, ignore_case).alias("_read")).where("_read IS NOT NULL")
        .select(pattern, ignore_case, "_read.java", F.explode("_read.literals").alias("_literal")))
    grams = lambda col, n: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(col) - n + 1, F.lit(1))), lambda i: F.substring(F.col(col), i, n)))
    sized = read.select("_literal").distinct().withColumn("_size", F.least(F.length("_literal"), F.lit(GRAM)))
    lookups = sized.withColumn("_gram", F.explode(grams("_literal", F.col("_size")))).drop("_size")
    sizes = sized.agg(F.collect_set("_size").alias("s")).scalar()
    index = (texts.select(text, folded(F.col(text)).alias("_folded")).withColumn("_size", F.explode(sizes))
             .where(F.length("_folded") >= F.col("_size"))
             .withColumn("_gram", F.explode(grams("_folded", F.col("_size")))).drop("_size"))
    # Only grams of some literal go on; they are few, and joined by hash where they are not.
    used = lookups.select("_gram").distinct()
    frequency = index.join(used, "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_freq"))
    rarest = lookups.join(frequency, "_gram", "left").groupBy("_literal").agg(
        F.min_by("_gram", F.struct(F.coalesce("_freq", F.lit(0)), "_gram")).alias("_gram"))
    keys = read.join(rarest, "_literal").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = index.withColumn("_salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
    return (dealt.join(keys, ["_gram", "_salt"])
            .where(F.contains("_folded", "_literal")).where(F.rlike(text, F.col("java")))
            .select(text, pattern, ignore_case).distinct())


def location_regexes(locations: str) -> Column:
    """For each location of an array, its regex as read, or NULL."""
    return read_locations(F.transform(locations, lambda b: b["modifier"]), F.transform(locations, lambda b: b["path"]))


def location_takes(locations: str, regexes: str, paths: list[str]) -> Column:
    """For each location: which of a short list of paths it takes."""
    listed = "array(" + ", ".join(f"'{p}'" for p in paths) + ")"
    return F.expr(f"""zip_with({locations}, {regexes}, (b, r) -> filter({listed}, t -> CASE
        WHEN b.modifier = '=' THEN b.path = t
        WHEN b.modifier IN ('~', '~*') THEN r IS NOT NULL AND t RLIKE coalesce(r.java, '')
        ELSE startswith(t, b.path) END))""")


def shadowing(locations: str, regexes: str) -> Column:
    """(regex, plain prefix) location numbers where the regex takes the prefix.

    A regex is tried on the prefixes that hold one of its literals.
    """
    fold = f"lower(translate(b.path, '{FOLD_FROM}', '{FOLD_TO}'))"
    return F.expr(f"""flatten(transform(
        filter(transform({regexes}, (r, i) -> named_struct('r', r, 'i', i)), x -> x.r IS NOT NULL), x -> transform(filter(
            filter(transform({locations}, (b, j) -> named_struct('m', b.modifier, 'p', b.path, 'f', {fold}, 'j', j)), y -> y.m = ''),
            y -> exists(x.r.literals, l -> contains(y.f, l)) AND y.p RLIKE x.r.java),
          y -> named_struct('regex', x.i, 'prefix', y.j))))""")
