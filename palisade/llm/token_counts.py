"""Token counts through a digest cache.

The cache is a table of (tokenizer digest, content digest, bytes, tokens) in a shared folder.  Contents are
joined to it by digest; of the contents it lacks, one row each is encoded and appended; the counts of all rows
then come from the cache.  The content is the UTF-8 text, a null text the empty one: no other normalisation
keeps the count of a byte-level vocabulary.  A caller whose vocabulary ignores more may pass `normalise`.

Only digests, identifiers and counts are grouped or joined with the cache.  Where few contents are missing, the list
of them goes to the texts; where many are, the texts move once to meet it, by (digest, identifier), so copies of one
text spread over all tasks; where none is, no text is read again.  A digest that more than a thousandth of all rows
have gets its count by broadcast (a thousand digests at most), so no task holds all its rows.

The cache grows by one part per run; rewriting it through `distinct` at any time compacts it.

Defined cases: a null text counts as empty; rows that repeat an identifier and a text are encoded once more and
stored once; an empty table gives an empty result; a null identifier is kept; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import tokens
from palisade.llm.common import blocks, materialize, small_batches, whole

#: Missing contents whose keys are broadcast, about 100 bytes each.
FEW_MISSES = 10_000

CACHE_SCHEMA = "digest binary, n_bytes bigint, n_tokens bigint, tokenizer string"


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The cache; empty where none has been written yet."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(folder) if there else spark.createDataFrame([], CACHE_SCHEMA)


def _counted(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokens.load(path)
        for batch in blocks(batches, "content"):
            counts = [tool.count(text) for text in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["digest", "n_bytes", "n_tokens"],
            )

    return run


def token_counts(
    docs: DataFrame, cache: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text, few_misses: int = FEW_MISSES,
) -> DataFrame:
    """One row per document: identifier, n_bytes (of the content), n_tokens."""
    spark = small_batches(docs.sparkSession)
    version = tokens.version(tokenizer)
    content = normalise(whole(text_col))
    keyed = docs.select(
        F.col(id_col).alias("id"), content.alias("content"),
        F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"),
        F.octet_length(content).cast("bigint").alias("n_bytes"),
    )
    keys = materialize(keyed.select("id", "digest", "n_bytes"), "token-keys")
    known = read_cache(spark, cache).filter(F.col("tokenizer") == version)
    misses = materialize(
        keys.groupBy("digest").agg(F.min("id").alias("id")).join(known, "digest", "left_anti"), "token-misses"
    )
    missing = misses.count()
    if missing:
        chosen = keyed.alias("k").join(
            F.broadcast(misses.alias("m")) if missing <= few_misses else misses.alias("m").hint("shuffle_hash"),
            (F.col("k.digest") == F.col("m.digest")) & F.col("k.id").eqNullSafe(F.col("m.id")),
            "left_semi",
        )
        encoded = chosen.mapInArrow(_counted(tokenizer), "digest binary, n_bytes bigint, n_tokens bigint")
        encoded.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    # A row may be stored twice, by repeated rows or by two jobs at once; both hold the same count.
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == version)
    counts = stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    hot = F.broadcast(materialize(
        keys.groupBy("digest").count().filter(F.col("count") > keys.count() / 1000).select("digest"), "token-hot"
    ))
    common = keys.join(F.broadcast(counts.join(hot, "digest", "left_semi")), "digest")
    rare = keys.join(hot, "digest", "left_anti").join(counts, "digest")
    return common.unionByName(rare).select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
