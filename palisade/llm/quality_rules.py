"""Quality rules whose cutoffs carry a guarantee.

A rule rejects a document when a measure of its text lies above a cutoff.  Cutoffs are chosen per stratum
from labelled holdouts: for a true false-rejection rate of `risk`, rejecting k or fewer of n good documents has
the exact binomial probability P(X <= k).  Walking from the loosest cutoff to stricter ones, a cutoff is
certified while this probability stays at or below the level, and the walk stops at the first that fails (fixed
sequence testing, so a rule needs no correction for its number of cutoffs).  The level and the risk of a stratum
are shared out evenly over its rules, and the level over all strata that have labels (Bonferroni): with
confidence 1 - `level`, no stratum loses more than `risk` of its good documents to all rules together.  Of the
certified cutoffs, which all hold at once, the one that rejects most bad less good labelled documents is used,
the loosest of equals.  A rule without a certified cutoff rejects nothing there.

Measures are counted in one pass over whole texts; only numbers meet the labels.

Defined cases: a null text has no words; a null stratum is a stratum of its own; a document with several labels
counts once, as good if any label says so; a label without document counts nothing; without labels no rule is
certified; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import materialize, small_batches

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")

#: Rules: a share of two measures and the cutoffs on trial, loosest first (a rule rejects above its cutoff).
RULES: dict[str, tuple[str, str, list[float]]] = {
    "symbols": ("n_symbols", "word_chars", [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03]),
    "repeats": ("n_repeat_words", "n_words", [0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15]),
    "same_lines": ("n_dup_lines", "n_lines", [0.8, 0.6, 0.5, 0.4, 0.3, 0.25]),
    "capitals": ("n_upper", "word_chars", [0.8, 0.6, 0.5, 0.4, 0.3, 0.2]),
    "exclaims": ("n_marks", "n_words", [2.0, 1.5, 1.0, 0.75, 0.5, 0.3]),
}


def value_of(rule: str) -> Column:
    part, whole_, _ = RULES[rule]
    return F.col(part) / F.greatest(F.col(whole_), F.lit(1))


def measure(text: str) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    octets = text.encode()
    words = octets.split()  # white space of ASCII only
    n = len(words)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen: dict = {}
            for w in windows:
                seen[w] = seen.get(w, 0) + 1
            end = 0
            for at, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += at + 3 - max(at, end)
                    end = at + 3
    lines = [line for line in text.split("\n") if line.encode().split()]
    chars = len(b"".join(words).decode())
    return (
        n, chars, len(octets) - len(octets.translate(None, SYMBOLS.encode())), len(lines) - len(set(lines)), repeated,
        len(lines), len(octets) - len(octets.translate(None, CAPITALS.encode())), text.count("!"),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t or "") for t in batch.column("text").to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(MEASURES)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("stratum"), *columns], names=["id", "stratum", *MEASURES]
        )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum and the measures of each document."""
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(stratum_col).cast("string").alias("stratum"),
                         F.col(text_col).alias("text"))
    return picked.mapInArrow(_measured, "id bigint, stratum string, " + ", ".join(f"{m} bigint" for m in MEASURES))


def binomial_tail(k: int, n: int, rate: float) -> float:
    """P(X <= k) of n trials."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
        + i * math.log(rate) + (n - i) * math.log1p(-rate)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certified(rejected: list[int], good: int, risk: float, level: float) -> int:
    """How many cutoffs are certified, of the numbers of good documents that each rejects, the loosest first."""
    for at, k in enumerate(rejected):
        # Beyond the expected number no level can be met.
        if good == 0 or k > risk * good or binomial_tail(k, good, risk) > level:
            return at
    return len(rejected)


def thresholds(
    measured: DataFrame, labels: DataFrame, risk: float, level: float, id_col: str = "doc_id",
    label_col: str = "quality", max_strata: int = 1000,
) -> dict[tuple[str | None, str], float]:
    """Cutoff of each (stratum, rule) that has one.

    Labels are counted in Spark.  The driver gets one row per stratum with `least` or more good labels, the least
    number that could certify anything; there may be at most `max_strata` of them.
    """
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(
        (F.max(label_col) > 0).alias("good")
    )
    held = measured.join(marks, measured["id"] == marks["label_id"])
    share = risk / len(RULES)
    least = math.ceil(math.log(level) / math.log1p(-share))
    good = F.col("good").cast("bigint")
    counted = held.groupBy("stratum").agg(
        F.sum(good).alias("n"),
        *[
            F.sum((value_of(rule) > cutoff).cast("bigint") * part).alias(f"{rule}_{at}_{name}")
            for rule, (*_, cutoffs) in RULES.items() for at, cutoff in enumerate(cutoffs)
            for name, part in (("good", good), ("bad", 1 - good))
        ],
    ).filter(F.col("n") >= least)
    rows = counted.limit(max_strata + 1).collect()
    if len(rows) > max_strata:
        raise ValueError(f"more than {max_strata} strata have {least} good labels; give a coarser stratum")
    out = {}
    for row in rows:
        for rule, (*_, cutoffs) in RULES.items():
            lost = [row[f"{rule}_{at}_good"] for at in range(len(cutoffs))]
            fit = certified(lost, row["n"], share, level / (len(rows) * len(RULES)))
            gain = [row[f"{rule}_{at}_bad"] - lost[at] for at in range(fit)]
            if gain and max(gain) > 0:
                out[row["stratum"], rule] = cutoffs[gain.index(max(gain))]
    return out


def rejects(cutoffs: dict[tuple[str | None, str], float]) -> Column:
    """Whether any certified rule of the row's stratum rejects it."""
    verdict = F.lit(False)
    for rule in RULES:
        per_stratum = [(stratum, cutoff) for (stratum, name), cutoff in cutoffs.items() if name == rule]
        if per_stratum:
            known = F.create_map(*[F.lit(x) for s, c in per_stratum if s is not None for x in (s, c)]) if any(
                s is not None for s, _ in per_stratum) else None
            limit = F.lit(None).cast("double") if known is None else known[F.col("stratum")]
            for s, c in per_stratum:
                if s is None:
                    limit = F.when(F.col("stratum").isNull(), F.lit(c)).otherwise(limit)
            verdict = verdict | F.coalesce(value_of(rule) > limit, F.lit(False))
    return verdict


def base_failed(min_words: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def assess(
    docs: DataFrame, labels: DataFrame, risk: float = 0.03, level: float = 0.05, id_col: str = "doc_id",
    text_col: str = "text", stratum_col: str = "lang",
) -> DataFrame:
    """One row per document: identifier, stratum, measures, base_failed, kept."""
    measured = materialize(measures(docs, id_col, text_col, stratum_col), "quality")
    cutoffs = thresholds(measured, labels, risk, level, id_col)
    return measured.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & ~rejects(cutoffs)
    ).withColumnRenamed("id", id_col)


def keep_good(
    docs: DataFrame, labels: DataFrame, risk: float = 0.03, level: float = 0.05, id_col: str = "doc_id",
    text_col: str = "text", stratum_col: str = "lang",
) -> DataFrame:
    """The rows that are kept, with all their columns.

    The measures are taken twice: once to write the numbers, which meet the labels and give the cutoffs, and once
    to filter the rows where they lie, so that no text is written, joined or moved at any size.
    """
    small_batches(docs.sparkSession)
    measured_rows = materialize(measures(docs, id_col, text_col, stratum_col), "quality-measures")
    cutoffs = thresholds(measured_rows, labels, risk, level, id_col)
    fields = [(m, pa.int64()) for m in MEASURES]

    @F.arrow_udf("struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">")
    def measured(text: pa.Array) -> pa.Array:
        rows = [measure(t or "") for t in text.to_pylist()]
        columns = zip(*rows, strict=True) if rows else [[] for _ in MEASURES]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(pa.struct(fields)))

    return docs.select(
        F.struct("*").alias("__row"), F.col(stratum_col).cast("string").alias("stratum"), measured(text_col).alias("__m")
    ).select("__row", "stratum", "__m.*").filter(~base_failed() & ~rejects(cutoffs)).select("__row.*")
