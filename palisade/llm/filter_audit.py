"""How filters interact: what each removes first, removes alone or finds already gone, in every order.

Sorted posting lists do the counting.  Documents are range-partitioned by part and identifier and cut into
ranges of at most RANGE_ROWS rows; a range of a part keeps, for each filter, the sorted list of the rows
that fail it (a posting is the row's number in its range, so repeated identifiers stay apart), and likewise the
good and the toxic rows.  The union of any set of filters is a k-way merge of its lists: all others gallop
through the longest, what they do not meet there is merged in the same way, and the sizes are added up over the
ranges.  What a filter removes after others is the difference of two unions, so 2^k unions per range give
every order.

A filter is a test of one text, or COPIES: the text is identical to one with a smaller identifier, anywhere in
the table.  Contents are compared by SHA-256.

Defined cases: a null text is empty; a null part is the empty string; a null identifier is neither smaller nor
greater than another and has no label; rows that repeat identifier and text are rows of their own and no copies of each other; a
document with several labels is good (toxic) if any of them says so; a label without document counts nothing; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import materialize, small_batches, whole

RANGE_ROWS = 65_536
HOT_SHARE = 1000
COPIES = "copies"
CAPITALS = bytes(range(65, 91))
LISTS = "part string, first_id {id}, last_id {id}, n_rows bigint, lists array<struct<name:string,rows:array<int>>>"

#: The tests of the five filters: words, and the text as UTF-8.
Test = Callable[[list[bytes], bytes], bool]
FILTERS: dict[str, Test | str] = {
    "A": lambda words, text: len(words) < 100,
    "B": lambda words, text: 100 * len(set(words)) < 80 * len(words),
    "C": lambda words, text: 100 * (len(text) - len(text.translate(None, CAPITALS))) > 10 * len(text.decode()),
    "D": lambda words, text: len(text.translate(None, b"#$%&*|")) < len(text),
    "E": COPIES,
}


# ---- merges ------------------------------------------------------------------------------------------------


def gallop(values: np.ndarray, wanted: np.ndarray, stride: int = 64) -> np.ndarray:
    """Whether each of the sorted `wanted` is among the sorted `values`.

    Wanted rows go in strides: from where the last one ended, steps double until they pass the stride's greatest
    value, and only the values in between are searched.
    """
    found = np.zeros(len(wanted), bool)
    place, n = 0, len(values)
    for at in range(0, len(wanted), stride):
        part = wanted[at : at + stride]
        step, end = 1, place
        while end < n and values[end] <= part[-1]:
            end, step = end + step, 2 * step
        near = values[place : min(end, n)]
        where = np.searchsorted(near, part)
        inside = where < len(near)
        found[at : at + stride][inside] = near[where[inside]] == part[inside]
        place += int(where[-1])
        if place >= n:
            break
    return found


def difference(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The sorted values that are not among the others."""
    return values[~gallop(others, values)]


def union_size(lists: list[np.ndarray]) -> int:
    """How many different values the sorted lists hold."""
    lists = sorted((x for x in lists if len(x)), key=len)
    if not lists:
        return 0
    *rest, longest = lists
    return len(longest) + union_size([difference(x, longest) for x in rest])


# ---- postings ----------------------------------------------------------------------------------------------


def _tested(filters: dict[str, Test | str]) -> Callable:
    tests = [(1 << k, test) for k, test in enumerate(filters.values()) if test != COPIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            digests = [hashlib.sha256(t).digest() for t in texts]
            masks = []
            for text in texts:
                words = text.split()  # white space of ASCII only
                masks.append(sum(bit for bit, test in tests if test(words, text)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), batch.column("row"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())],
                names=["id", "part", "row", "digest", "mask"],
            )

    return run


def failures(
    docs: DataFrame, filters: dict[str, Test | str] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """id, part, row (a number of its own) and mask: the bit of each filter that the document fails."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"),
    )
    schema = f"id {rows.schema['id'].dataType.simpleString()}, part string, row bigint, digest binary, mask int"
    tested = materialize(rows.mapInArrow(_tested(filters), schema), "audit-tests")
    copies = sum(1 << k for k, test in enumerate(filters.values()) if test == COPIES)
    if not copies:
        return tested.drop("digest")
    total = tested.count()
    several = tested.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    # At most HOT_SHARE contents can hold 1/HOT_SHARE of all rows each: they have a proven bound, the rest small groups.
    hot = F.broadcast(several.filter(F.col("n") * HOT_SHARE >= total).select("digest", "first_id"))
    cold = several.filter(F.col("n") * HOT_SHARE < total).select("digest", "first_id")
    met = tested.join(hot, "digest").unionByName(tested.join(hot, "digest", "left_anti").join(cold, "digest", "left"))
    fails = F.coalesce(F.col("id") > F.col("first_id"), F.lit(False))
    return met.select("id", "part", "row", F.when(fails, F.col("mask").bitwiseOR(copies)).otherwise(F.col("mask")).alias("mask"))


def _listed(names: list[str], id_type: pa.DataType, range_rows: int) -> Callable:
    kind = pa.list_(pa.struct([("name", pa.string()), ("rows", pa.list_(pa.int32()))]))
    out = pa.schema([("part", pa.string()), ("first_id", id_type), ("last_id", id_type), ("n_rows", pa.int64()), ("lists", kind)])

    def row_of(part: str, ids: list, masks: np.ndarray) -> pa.RecordBatch:
        lists = [{"name": name, "rows": np.flatnonzero(masks >> k & 1).astype(np.int32)} for k, name in enumerate(names)]
        known = [x for x in ids if x is not None]
        row = [[part], known[:1] or [None], known[-1:] or [None], [len(ids)], [lists]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, masks = None, [], []
        for batch in batches:
            parts = batch.column("part").to_pylist()
            keys, bits = batch.column("id").to_pylist(), batch.column("mask").to_pylist()
            for p, key, mask in zip(parts, keys, bits, strict=True):
                if ids and (p != part or len(ids) >= range_rows):
                    yield row_of(part, ids, np.array(masks, np.int64))
                    ids, masks = [], []
                part = p
                ids.append(key)
                masks.append(mask)
        if ids:
            yield row_of(part, ids, np.array(masks, np.int64))

    return run


def postings(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Test | str] = FILTERS, id_col: str = "doc_id", text_col: str = "text",
    part_col: str = "lang", label_id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per part and range of identifiers: the sorted lists of rows that fail each filter, are good, are toxic."""
    failed = failures(docs, filters, id_col, text_col, part_col)
    marks = labels.groupBy(F.col(label_id_col).alias("label_id")).agg(
        F.coalesce(F.max((F.col(quality_col) == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col(toxic_col) == 1).cast("int")), F.lit(0)).alias("toxic"),
    ).filter("label_id IS NOT NULL AND good + toxic > 0")
    k = len(filters)
    mask = F.col("mask") + F.coalesce(F.col("good") * (1 << k), F.lit(0)) + F.coalesce(F.col("toxic") * (2 << k), F.lit(0))
    marked = failed.join(marks, failed["id"] == marks["label_id"], "left").select("id", "part", "row", mask.cast("bigint").alias("mask"))
    ranged = marked.repartitionByRange("part", "id", "row").sortWithinPartitions("part", "id", "row")
    id_kind = failed.schema["id"].dataType
    make = _listed([*filters, "good", "toxic"], pa.string() if id_kind.typeName() == "string" else pa.int64(), range_rows)
    return ranged.mapInArrow(make, LISTS.format(id="string" if id_kind.typeName() == "string" else "bigint"))


# ---- audit -------------------------------------------------------------------------------------------------


def _unions(names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                entries = row.column("lists").flatten()
                lists = {n: v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.empty(0, np.int32)
                         for n, v in zip(entries.field("name").to_pylist(), entries.field("rows"), strict=True)}
                marked = [
                    {n: lists[n][gallop(lists[mark], lists[n])] if mark else lists[n] for n in names}
                    for mark in (None, "good", "toxic")
                ]
                sizes = [
                    [union_size([kind[n] for k, n in enumerate(names) if subset >> k & 1]) for subset in range(1 << len(names))]
                    for kind in marked
                ]
                count = 1 << len(names)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row.column("part").to_pylist() * count, pa.string()), pa.array(range(count), pa.int32()),
                    pa.array(row.column("n_rows").to_pylist() * count, pa.int64()), *(pa.array(s, pa.int64()) for s in sizes),
                ], names=["part", "subset", "n_rows", "failing", "good", "toxic"])

    return run


def unions(lists: DataFrame, names: list[str]) -> DataFrame:
    """For each part and set of filters (a bit each): rows of the part, and rows, good rows, toxic rows that fail any."""
    merged = lists.mapInArrow(_unions(names), "part string, subset int, n_rows bigint, failing bigint, good bigint, toxic bigint")
    return merged.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n_rows", "failing", "good", "toxic")])


def audit(lists: DataFrame, names: list[str]) -> DataFrame:
    """One row per part, order of the filters and step; all filters are applied in the order, one a step.

    The sums are a row per part and set of filters.  Orders are k! x k rows, bounded by the number of filters, and
    meet the sums by the sets before and after the step.
    """
    spark = lists.sparkSession
    sums = materialize(unions(lists, names), "audit-unions")
    every = (1 << len(names)) - 1
    steps = []
    for order in itertools.permutations(range(len(names))):
        before = 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            steps.append(("".join(names[i] for i in order), step, names[k], before, after, 1 << k, every ^ 1 << k, every))
            before = after
    orders = spark.createDataFrame(
        steps, "filter_order string, step int, name string, before int, after int, own int, others int, every int"
    )

    def of(key: str) -> DataFrame:
        kept = ["failing", "good", "toxic"] if key in ("before", "after") else ["failing"]
        extra = [F.col("n_rows")] if key == "after" else []
        return sums.select("part", F.col("subset").alias(key), *extra, *[F.col(c).alias(f"{c}_{key}") for c in kept])

    met = of("after").join(F.broadcast(orders), "after")
    for key in ("before", "own", "others", "every"):
        met = met.join(of(key), ["part", key])
    removed = met.withColumn("removed", F.col("failing_after") - F.col("failing_before"))
    shares = removed.groupBy("part", "name").agg(F.sum("removed").alias("shapley"))
    return removed.join(shares, ["part", "name"]).select(
        "part", "filter_order", "step", (F.col("n_rows") - F.col("failing_after")).alias("kept"), "removed",
        (F.col("failing_own") - F.col("removed")).alias("redundant"),
        (F.col("failing_every") - F.col("failing_others")).alias("unique_fails"),
        (F.col("good_after") - F.col("good_before")).alias("good_lost"),
        (F.col("toxic_after") - F.col("toxic_before")).alias("toxic_lost"), "shapley",
    )


def audit_documents(docs: DataFrame, labels: DataFrame, filters: dict[str, Test | str] = FILTERS, **columns: str) -> DataFrame:
    """The audit of the filters over all documents; the posting lists are written to the shared folder once."""
    return audit(materialize(postings(docs, labels, filters, **columns), "audit-postings"), list(filters))
