"""Importance resampling towards a target distribution, with segments deduplicated.

Features are hashed runs of 1 to `order` words.  A line break separates words, so a text is its lines: the
features inside a line depend on the line alone and are counted once per distinct line of a corpus, and
multiplied by the line's occurrences; the runs that go over a line break are counted per document and added.
The log ratio of the smoothed bucket frequencies of target and corpus is a bucket's gain (in thousandths, rounded
down); a distinct line's weight is taken once, and a document's weight is the sum over its lines' occurrences
plus its crossing runs.  Gumbel noise on the weights and the highest scores draw without replacement.

What moves: distinct lines (after counting on the map side), references of 16 bytes from documents to lines, and
numbers.  Lines with 1/HOT_SHARE of all occurrences are at most HOT_SHARE many and are broadcast.  The driver gets
two numbers per bucket, and one per range of the final order.

Words are lower-cased (A-Z only) runs of digits, letters and all characters beyond ASCII.

Defined cases: a null text has no words; a null identifier counts as empty text in the noise and sorts last;
rows that repeat an identifier are drawn on their own, with the same noise; ties go to the smaller identifier, then
to fewer features; an empty corpus gives an empty result; an empty target gives gains from the smoothing alone;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import blocks, materialize, small_batches, whole
from palisade.llm.decontamination import words_of

HOT_SHARE = 1000
#: Features whose bucket a worker remembers.
MEMO = 500_000
REFS = "id {id}, uid bigint, lines array<struct<line:binary,times:bigint>>, crossing binary"


class _Buckets(dict):
    """The bucket of a feature, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        return bucket


def line_key(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def runs(words: list[bytes], order: int) -> Iterator[bytes]:
    """All runs of 1 to `order` consecutive words, joined by a blank."""
    yield from words
    for n in range(2, order + 1):
        for at in range(len(words) - n + 1):
            yield b" ".join(words[at : at + n])


def crossing_runs(lines: list[list[bytes]], order: int) -> Iterator[bytes]:
    """The runs that begin in one line and end in another."""
    words = [w for line in lines for w in line]
    of = [k for k, line in enumerate(lines) for _ in line]
    for n in range(2, order + 1):
        for at in range(len(words) - n + 1):
            if of[at] != of[at + n - 1]:
                yield b" ".join(words[at : at + n])


def _packed(buckets: list[int]) -> bytes:
    return np.array(buckets, "<u4").tobytes()


def _line_features(order: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets(buckets).__getitem__
        for batch in blocks(batches, "line"):
            lines = batch.column("line").cast(pa.binary()).to_pylist()
            words = [words_of(line) for line in lines]
            yield pa.RecordBatch.from_arrays([
                pa.array([line_key(x) for x in lines], pa.binary()), batch.column("times"), pa.array([len(w) for w in words], pa.int64()),
                pa.array([_packed(list(map(bucket, runs(w, order)))) for w in words], pa.binary()),
            ], names=["line", "times", "n_words", "buckets"])

    return run


def _references(order: int, buckets: int) -> Callable:
    kind = pa.list_(pa.struct([("line", pa.binary()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets(buckets).__getitem__
        for batch in blocks(batches, "text"):
            refs, crossing = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                lines = (text or b"").split(b"\n")
                refs.append([{"line": line_key(line), "times": n} for line, n in Counter(lines).items() if line])
                over = crossing_runs([words_of(line) for line in lines], order) if order > 1 else ()
                crossing.append(_packed(list(map(bucket, over))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("uid"), pa.array(refs, kind), pa.array(crossing, pa.binary())],
                names=["id", "uid", "lines", "crossing"],
            )

    return run


def references(docs: DataFrame, order: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: its lines by key with their number, and the buckets of its crossing runs."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).alias("text")
    )
    schema = REFS.format(id=rows.schema["id"].dataType.simpleString())
    return materialize(rows.mapInArrow(_references(order, buckets), schema), "importance-references")


def line_features(docs: DataFrame, order: int, buckets: int, text_col: str) -> DataFrame:
    """One row per distinct line: key, occurrences in the corpus, number of words, the buckets of its features."""
    lines = docs.select(F.explode(F.split(whole(text_col), "\n")).alias("line")).filter("line <> ''")
    counted = lines.groupBy("line").agg(F.count("*").alias("times"))
    return materialize(
        counted.mapInArrow(_line_features(order, buckets), "line binary, times bigint, n_words bigint, buckets binary"),
        "importance-lines",
    )


def bucket_counts(lines: DataFrame, refs: DataFrame, buckets: int) -> np.ndarray:
    """Features of the corpus in each bucket: lines by their occurrences, crossing runs on top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            times = batch.column("times").to_numpy(zero_copy_only=False)
            for n, packed in zip(times.tolist(), batch.column("buckets").to_pylist(), strict=True):
                np.add.at(counts, np.frombuffer(packed, "<u4"), n)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["bucket", "n"])

    parts = lines.select("times", "buckets").unionByName(
        refs.filter(F.octet_length("crossing") > 0).select(F.lit(1).cast("bigint").alias("times"), F.col("crossing").alias("buckets"))
    ).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: 1000 times the log ratio of the smoothed frequencies, rounded down."""
    buckets, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log(float((t + 1) * (all_corpus + buckets)) / float((s + 1) * (all_target + buckets))))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
    ], np.int64)


def _weighed(gain: np.ndarray) -> Callable:
    @F.arrow_udf("bigint")
    def weight(packed: pa.Array) -> pa.Array:
        return pa.array([int(gain[np.frombuffer(x, "<u4")].sum()) for x in packed.to_pylist()], pa.int64())

    return weight


def scores(
    docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id",
    text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """One row per document: id, uid, n_words, n_features, weight, score (weight plus noise)."""
    small_batches(docs.sparkSession)
    refs = references(docs, order, buckets, id_col, text_col)
    lines = line_features(docs, order, buckets, text_col)
    wanted = target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text"))
    there = bucket_counts(
        line_features(wanted, order, buckets, "text"), references(wanted, order, buckets, "id", "text"), buckets
    )
    weight = _weighed(gains(bucket_counts(lines, refs, buckets), there))
    weighed = materialize(lines.select(
        "line", F.col("times").alias("occurrences"), "n_words", (F.octet_length("buckets") / 4).cast("bigint").alias("n_features"),
        weight("buckets").alias("weight"),
    ), "importance-weights")
    total = weighed.agg(F.coalesce(F.sum("occurrences"), F.lit(0))).first()[0]
    is_hot = F.col("occurrences") * HOT_SHARE >= total
    pointers = refs.select("uid", F.explode("lines").alias("ref")).select("uid", "ref.line", "ref.times")
    hot = F.broadcast(weighed.filter(is_hot).drop("occurrences"))
    cold = weighed.filter(~is_hot).drop("occurrences")
    met = pointers.join(hot, "line").unionByName(pointers.join(hot.select("line"), "line", "left_anti").join(cold, "line"))
    numbers = ("n_words", "n_features", "weight")
    summed = met.groupBy(F.col("uid").alias("of")).agg(*[F.sum(F.col(c) * F.col("times")).alias(f"in_{c}") for c in numbers])
    own = {"n_words": F.lit(0), "n_features": (F.octet_length("crossing") / 4).cast("bigint"), "weight": weight("crossing")}
    joined = refs.drop("lines").join(summed, F.col("uid") == F.col("of"), "left").select(
        "id", "uid", *[(F.coalesce(f"in_{c}", F.lit(0)) + own[c]).cast("bigint").alias(c) for c in numbers]
    )
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return joined.withColumn("score", F.col("weight") + noise)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, order: int = 1, buckets: int = 10_000,
    seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """One row per document: identifier, n_words, n_features, weight, score, rank (null if not drawn).

    Of the N documents with `least_words` words, floor(percent * N / 100) are drawn.  All are range-partitioned by the
    final order and numbered per range; the rows before a range are added.
    """
    scored = scores(docs, target, order, buckets, seed, id_col, text_col, target_text_col)
    by = [F.desc("may"), F.desc("score"), F.col("id").asc_nulls_last(), F.asc("n_features"), F.asc("uid")]
    ranged = materialize(
        scored.withColumn("may", F.col("n_words") >= least_words).repartitionByRange(*by).withColumn("part", F.spark_partition_id()),
        "importance-ranges",
    )
    # A row per range: at most as many as shuffle partitions.
    sizes = ranged.groupBy("part").agg(F.count_if("may").alias("n")).orderBy("part").collect()
    drawn = percent * sum(r.n for r in sizes) // 100
    starts = [(r.part, sum(x.n for x in sizes[:k])) for k, r in enumerate(sizes)]
    before = ranged.sparkSession.createDataFrame(starts, "part int, before bigint")
    # Ranges without a drawn row need no numbers.
    number = F.row_number().over(Window.partitionBy("part").orderBy(*by)) + F.col("before")
    return ranged.join(F.broadcast(before), "part").withColumn("number", number).select(
        F.col("id").alias(id_col), "n_words", "n_features", "weight", "score",
        F.when(F.col("may") & (F.col("number") <= drawn), F.col("number")).cast("bigint").alias("rank"),
    )


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns; rows that share an identifier are drawn together."""
    chosen = resample(docs, target, id_col=id_col, **options).filter("rank IS NOT NULL").select(F.col(id_col).alias("__drawn"))
    return docs.join(chosen, docs[id_col].eqNullSafe(F.col("__drawn")), "left_semi")
