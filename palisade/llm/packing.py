"""Best-fit packing of token sequences after a Martello-Toth reduction.

Items of one length are alike, so the whole instance is a count per length: never more numbers than a sequence
has places, whatever the number of documents.  Spark counts the lengths; the plan is made from these counts;
Spark numbers the items of each length and looks up where the plan puts each number.  No item passes through
the driver, and no task holds a length's items together.

The reduction takes the longest remaining length and, where one small set of items (alone, with one or with two
others) dominates every other set that could share its sequence, fixes that set, as often as the counts allow.
What no rule fixes is packed by best fit, longest first.

Defined cases: lengths must lie between 1 and the capacity; items that are equal in every respect are
interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm import tokens
from palisade.llm.common import blocks, small_batches, whole


@dataclass
class Group:
    """`bins` sequences filled alike: (length, copies) in order."""

    bins: int
    room: int
    slots: list[tuple[int, int]] = field(default_factory=list)

    def put(self, length: int, copies: int) -> None:
        self.slots.append((length, copies))
        self.room -= length * copies


class _Lengths:
    """Counts per length with the questions that the reduction asks."""

    def __init__(self, counts: dict[int, int]):
        self.left = {length: n for length, n in counts.items() if n > 0}

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def largest(self, most: int, without: dict[int, int]) -> int | None:
        """Largest length of at most `most` of which items are left beside those in `without`."""
        return max((w for w, n in self.left.items() if w <= most and n > without.get(w, 0)), default=None)

    def fits(self, room: int, first: int, stop: int = 3) -> int:
        """How many further items fit beside `first`, smallest first, counted up to `stop`."""
        n = 0
        for w in sorted(self.left):
            free = self.left[w] - (w == first)
            take = min(free, room // w, stop - n)
            n, room = n + take, room - take * w
            if n == stop or take < free:
                break
        return n

    def best_pair(self, room: int, first: int) -> tuple[int, int] | None:
        """Two further items with the largest sum that fits, the larger one first."""
        best, pair = 0, None
        for a in self.left:
            if a < room and self.left[a] > (a == first):
                used = {first: 1}
                used[a] = used.get(a, 0) + 1
                b = self.largest(min(a, room - a), used)
                if b is not None and a + b > best:
                    best, pair = a + b, (a, b)
        return pair

    def two_longer(self, than: int, without: dict[int, int]) -> float:
        """Sum of the two shortest items that are longer than `than`; infinite if there are no two."""
        found: list[int] = []
        for w in sorted(w for w in self.left if w > than):
            found += [w] * min(2 - len(found), max(0, self.left[w] - without.get(w, 0)))
            if len(found) == 2:
                return sum(found)
        return float("inf")


def _dominating(left: _Lengths, first: int, capacity: int) -> tuple[int, ...] | None:
    """Items that dominate every other set around `first`, or None."""
    room = capacity - first
    k = left.fits(room, first)
    if k == 0:
        return ()
    one = left.largest(room, {first: 1})
    if k == 1 or one == room:
        return (one,)
    if k == 2:
        a, b = left.best_pair(room, first)
        if one >= a + b:
            return (one,)
        # Then only two items that are both longer than b could not be exchanged for a and b.
        if one == a and left.two_longer(b, {first: 1, a: 1 + (a == first)}) > room:
            return (a, b)
    return None


def reduce_counts(counts: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """Groups that are fixed for good, and the counts that remain."""
    left, fixed = _Lengths(counts), []
    for first in sorted(left.left, reverse=True):
        while first in left.left and (others := _dominating(left, first, capacity)) is not None:
            need: dict[int, int] = defaultdict(int)
            for w in (first, *others):
                need[w] += 1
            times = min(left.left[w] // n for w, n in need.items())
            group = Group(times, capacity)
            for w, n in sorted(need.items(), reverse=True):
                group.put(w, n)
                left.take(w, n * times)
            fixed.append(group)
    return fixed, left.left


def best_fit(counts: dict[int, int], capacity: int, longest_first: bool = True) -> list[Group]:
    """Best fit over counts: each item goes where it leaves the least room, as item by item."""
    by_room: dict[int, list[Group]] = defaultdict(list)
    done: list[Group] = []
    shortest = min(counts, default=0)

    def keep(group: Group) -> None:
        (by_room[group.room] if group.room >= shortest else done).append(group)

    for length in sorted(counts, reverse=longest_first):
        n = counts[length]
        for room in sorted(r for r in by_room if r >= length):
            while n and by_room[room]:
                group, copies = by_room[room].pop(), room // length
                full, rest = divmod(n, copies)
                if full < group.bins:
                    parts = [(full, copies), (1, rest)] if rest else [(full, copies)]
                    n = 0
                else:
                    parts = [(group.bins, copies)]
                    n -= group.bins * copies
                used = 0
                for bins, put in parts:
                    if bins:
                        part = Group(bins, group.room, list(group.slots))
                        part.put(length, put)
                        keep(part)
                        used += bins
                if used < group.bins:
                    by_room[room].append(Group(group.bins - used, group.room, group.slots))
            if not n:
                break
        copies = capacity // length
        for bins, put in ((n // copies, copies), (1, n % copies)):
            if bins and put:
                group = Group(bins, capacity)
                group.put(length, put)
                keep(group)
    return done + [group for groups in by_room.values() for group in groups]


def plan(counts: dict[int, int], capacity: int) -> list[Group]:
    fixed, rest = reduce_counts(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _placements(groups: list[Group]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, past last number, copies, first sequence, offset in the sequence)."""
    given: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for group in groups:
        offset = 0
        for length, copies in group.slots:
            n = group.bins * copies
            rows.append((length, given[length], given[length] + n, copies, sequence, offset))
            given[length] += n
            offset += length * copies
        sequence += group.bins
    return rows


def pack(items: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """The items with `sequence_id` and `offset`.  `order` names columns that tell items apart; equal ones are alike.

    `items` is read twice and should be a written table.
    """
    spark = items.sparkSession
    # At most `capacity` rows, by the range of lengths.
    counts = {r[0]: r[1] for r in items.groupBy(length).agg(F.count("*")).collect()}
    if any(w is None or not 1 <= w <= capacity for w in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    placements = spark.createDataFrame(
        _placements(plan(counts, capacity)),
        "at_length bigint, first bigint, past bigint, copies bigint, sequence bigint, at bigint",
    )
    # Number the items of a length: rank within one of its slices, plus the slices before.  Slices and their
    # number both grow with the root of all items, so neither becomes large; the table has one row per length.
    most = max(1000, math.isqrt(sum(counts.values())))
    parts = spark.createDataFrame([(w, -(-n // most)) for w, n in counts.items()], "__w bigint, __parts bigint")
    sliced = items.join(F.broadcast(parts), F.col(length) == F.col("__w")).withColumn(
        "__slice", F.pmod(F.xxhash64(*order), F.col("__parts"))
    ).drop("__w", "__parts")
    within = Window.partitionBy(length, "__slice").orderBy(*order)
    ranked = sliced.withColumn("__rank", F.row_number().over(within) - 1)
    before = sliced.groupBy(F.col(length).alias("__l"), F.col("__slice").alias("__s")).agg(
        F.count("*").alias("__n")
    ).withColumn(
        "__base",
        F.sum("__n").over(Window.partitionBy("__l").orderBy("__s")) - F.col("__n"),
    )
    numbered = ranked.join(
        before, (F.col(length) == F.col("__l")) & (F.col("__slice") == F.col("__s"))
    ).withColumn("__number", F.col("__rank") + F.col("__base"))
    # The plan has a few rows per length (bounded by the capacity), so every task may hold it.
    within_bin = F.col("__number") - F.col("first")
    return numbered.join(
        F.broadcast(placements),
        (F.col(length) == F.col("at_length")) & (F.col("__number") >= F.col("first"))
        & (F.col("__number") < F.col("past")),
    ).select(
        *items.columns,
        (F.col("sequence") + F.floor(within_bin / F.col("copies"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + F.pmod(within_bin, F.col("copies")) * F.col(length)).cast("bigint").alias("offset"),
    )


PIECES = "id bigint, piece int, start bigint, length bigint, ids binary"


def _pieces(path: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokens.load(path)
        for batch in blocks(batches, "content", 4_000_000):
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                ids = tool.packed(text) + end
                n = len(ids) // 4
                past = n % capacity or capacity
                start = 0
                for piece in range(-(-n // capacity)):
                    for column, value in zip(out, (key, piece, start, past - start, ids[4 * start:4 * past]), strict=True):
                        column.append(value)
                    start, past = past, past + capacity
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["id", "piece", "start", "length", "ids"],
            )

    return run


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Token ids of whole texts and the end id, cut only where longer than the capacity, the short piece first.

    `ids` holds little-endian unsigned 32-bit numbers.  A null text is empty, so it gives the end id alone.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("id"), whole(text_col).alias("content")).mapInArrow(
        _pieces(tokenizer, capacity, end_id), PIECES
    ).withColumnRenamed("id", id_col)


def sequences(placed: DataFrame) -> DataFrame:
    """Training sequences: the ids of each sequence's pieces, joined in place order.  Needs `ids` in `placed`."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(
        F.concat_ws("", F.transform(ordered, lambda p: F.hex(p["ids"]))).alias("hex")
    ).select("sequence_id", F.unhex("hex").alias("ids"))
