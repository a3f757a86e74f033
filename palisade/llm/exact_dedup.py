"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts, each partition is sorted externally, and a row
belongs to its neighbour's group when the full normalised texts are equal.  Splitters are taken over the
leading characters, a 64-bit hash and a salt, so that samples stay small; equality is never decided by them.

Texts that hold more than 1/`hot_share` of all rows are at most `hot_share` many.  Only they get a salt, which
lets a range boundary fall inside their run; what each part kept is compared in full once more.

Defined cases: a null text is empty; a null identifier sorts last; rows that are equal in every respect are
one group of which one row stays; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import WHITE, materialize, whole


def normalised(text: str | Column) -> Column:
    """The text without white space, null as empty."""
    out = whole(text)
    for char in WHITE:
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, carry: bool, hot_share: int) -> DataFrame:
    """Rows in content order with their rank in the run of equal texts and the first row's identifier."""
    spark = docs.sparkSession
    share = max(hot_share, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(
        F.col(id_col).alias("id"),
        normalised(text_col).alias("norm"),
        F.char_length(whole(text_col)).alias("size"),
        *([F.struct("*").alias("row")] if carry else []),
    ).withColumn("h", F.xxhash64("norm"))
    counted = docs.select(F.xxhash64(normalised(text_col)).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    total = docs.count()
    # At most `share` groups can hold total / share rows each, so this side has a proven bound.
    hot = counted.filter((F.col("n") > 1) & (F.col("n") * share >= total)).select(
        "h", F.ceil(F.col("n") * share / F.lit(max(total, 1))).alias("salts")
    )
    # Whole rows carry their text, so the normalised text is left behind and made anew after the exchange.
    salted = rows.join(F.broadcast(hot), "h", "left").select(
        *[c for c in rows.columns if c != "h" and not (carry and c == "norm")],
        "h",
        F.substring("norm", 1, 12).alias("lead"),
        F.coalesce(F.pmod(F.xxhash64("id", "size"), F.col("salts")), F.lit(0)).alias("salt"),
        F.col("salts").isNotNull().alias("hot"),
    )
    ranged = salted.repartitionByRange("lead", "h", "salt")
    if carry:
        ranged = ranged.withColumn("norm", normalised(F.col("row")[text_col]))
    run = Window.partitionBy("lead", "h", "salt", "norm").orderBy(
        F.desc("size"), F.col("id").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.withColumns({
        "first_id": F.first("id").over(run),
        "rank": F.row_number().over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })


def _merged_parts(marked: DataFrame) -> DataFrame:
    """For each part of a split text: the identifier that stays, and whether this part holds it.

    Bounded: a split text has about one part for each 1/share of all rows, so parts are about 2 x share.
    """
    parts = marked.filter(F.col("hot") & (F.col("rank") == 1))
    across = Window.partitionBy("h", "part_text").orderBy(
        F.desc("size"), F.col("id").asc_nulls_last(), "salt"
    )
    return parts.select(
        F.col("h").alias("part_h"), F.col("salt").alias("part_salt"), F.col("text_sha256").alias("part_sha"),
        F.first("id").over(across).alias("merged_id"),
        (F.row_number().over(across) == 1).alias("holds"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: int = 1000) -> DataFrame:
    """One row per input row: its identifier, the one that stays, group size, kept, digest of the text.

    Of equal texts the row with most code points in the original text stays, then the smallest identifier.
    """
    marked = materialize(
        _sorted_runs(docs, id_col, text_col, False, hot_share).select(
            "id", "first_id", "rank", "size", "h", "salt", "hot",
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.when(F.col("hot") & (F.col("rank") == 1), F.col("norm")).alias("part_text"),
        ),
        "exact-runs",
    )
    parts = F.broadcast(_merged_parts(marked))
    resolved = marked.join(
        parts,
        F.col("hot") & (F.col("h") == F.col("part_h")) & (F.col("salt") == F.col("part_salt"))
        & (F.col("text_sha256") == F.col("part_sha")),
        "left",
    ).select(
        F.col("id").alias(id_col),
        F.when(F.col("hot"), F.col("merged_id")).otherwise(F.col("first_id")).alias("keep_id"),
        ((F.col("rank") == 1) & F.coalesce("holds", F.lit(True))).alias("kept"),
        "text_sha256", "hot",
    )
    # Sizes of split texts have the bound of those texts; the rest meet theirs by digest, in groups of 1/share at most.
    sizes = marked.groupBy("hot", "text_sha256").agg(F.count("*").alias("group_size"))
    of_hot = F.broadcast(sizes.filter("hot").drop("hot"))
    of_rest = sizes.filter("not hot").drop("hot")
    return resolved.filter("hot").join(of_hot, "text_sha256").unionByName(
        resolved.filter("not hot").join(of_rest, "text_sha256")
    ).select(id_col, "keep_id", "group_size", "kept", "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: int = 1000) -> DataFrame:
    """The rows that stay, with all their columns."""
    first = materialize(
        _sorted_runs(docs, id_col, text_col, True, hot_share).filter(F.col("rank") == 1).select(
            "row", "id", "rank", "size", "h", "salt", "hot",
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.when(F.col("hot"), F.col("norm")).alias("part_text"),
        ),
        "exact-first",
    )
    losers = F.broadcast(_merged_parts(first).filter(~F.col("holds")))
    return first.join(
        losers,
        (F.col("h") == F.col("part_h")) & (F.col("salt") == F.col("part_salt"))
        & (F.col("text_sha256") == F.col("part_sha")),
        "left_anti",
    ).select("row.*")
