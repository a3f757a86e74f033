"""The corpus pipeline: five stages, each over all that the stage before kept.

Every stage but the last returns the columns of `documents` (and any others that came), with the rows that it keeps
unchanged.

Defined cases: a null text is empty, so it has no language and goes in the first stage; a null identifier or language
is a value like any other; of rows that repeat everything one stays after exact dedup; of equal texts the one with
most characters, then the smallest identifier; of near texts the smallest identifier; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import exact_dedup, language_id, quality_rules, simhash
from palisade.llm.common import held_out, materialize, small_batches, table
from palisade.llm.queries import packed_pieces

#: A document whose best language has less than this share of its letters has no language.
LEAST_SHARE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and texts in which no language has a third of the letters."""
    # Numbered names can't clash with the prediction's, and no text is carried twice.
    name = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    labelled, _ = language_id.identify(
        docs.toDF(*name.values()), ~held_out(name["doc_id"], 4, 2), id_col=name["doc_id"], text_col=name["text"],
        label_col=name["lang"],
    )
    kept = (F.col("prediction.lang") != language_id.UNKNOWN) & (F.col("prediction.score") >= LEAST_SHARE)
    return labelled.filter(kept).drop("prediction").toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the base rules or a certified cutoff reject."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints stays, the one with the smallest identifier."""
    return simhash.deduplicate(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packed_pieces(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("quality", quality), ("exact", exact), ("near", near), ("packing", packing),
]

#: Language, quality cutoffs, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(small_batches(spark), docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
