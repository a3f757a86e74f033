"""Benchmark decontamination with suffix arrays over the training texts.

Each task deals its documents into shards of whole texts, numbers their words and sorts all suffixes of the
shard by words (prefix doubling in which only suffixes that are still tied are sorted again).  Every suffix of
every benchmark item is then looked up by binary search, word by word, so its range in the suffix array shrinks
until no document goes on like it: the depth is the longest verbatim match, the range its places.  The range
at the depth of a window (`window` words, or the whole item if it has fewer) is every occurrence of that window;
the document words inside are hit.

The benchmark goes out in blocks of at most `block_bytes` of text, one pass over the documents per block, so
neither driver nor task holds more than a block of it.  A shard lives in one task; memory is about 60 bytes a
word of a shard, and a text longer than a shard is a shard of its own.

Words are lower-cased (A-Z only) runs of digits, letters and all characters beyond ASCII.

Defined cases: a null text has no words, as document and as item; an item without words has no window; a null
item identifier counts as empty text; rows that repeat an identifier are rows of their own; items that share an
identifier are one item; copies of an item count once; an empty table on either side gives documents without hits;
other columns are not looked at, and `decontaminate` returns them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import blocks, small_batches, whole

#: Bytes to bytes: capitals to small letters, all that is not part of a word to a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
SHARD_BYTES = 8_000_000
BLOCK_BYTES = 16_000_000
FOUND = "id {id}, digest string, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>"
LONGEST = "item string, start bigint, length bigint, places bigint, id {id}, at bigint"


def words_of(octets: bytes) -> list[bytes]:
    return octets.translate(WORD_BYTES).split()


class _Numbers(dict):
    """Numbers words in the order in which they are first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def suffix_array(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, each of which stops where its document ends."""
    n = len(ids)
    if not n:
        return np.empty(0, np.int64)
    at = np.arange(n)
    bits = int(ids.max() + 1).bit_length()
    span = 62 // bits
    key = np.zeros(n, np.int64)
    for k in range(span):
        inside = at + k < ends
        key <<= bits
        key[inside] |= ids[at[inside] + k] + 1
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    head = np.maximum.accumulate(np.where(new, at, 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    group = np.cumsum(new) - 1
    tied = np.flatnonzero(np.bincount(group)[group] > 1)
    # A suffix that ends here sorts before those that go on and is settled, so what is tied stays in one piece.
    while len(tied):
        rows = order[tied]
        later = rows + span
        second = np.where(later < ends[rows], rank[np.minimum(later, n - 1)] + 1, 0)
        key = rank[rows] * (n + 1) + second
        by = np.argsort(key)
        rows, key, second = rows[by], key[by], second[by]
        order[tied] = rows
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[rows] = np.maximum.accumulate(np.where(new, tied, 0))
        group = np.cumsum(new) - 1
        tied = tied[(np.bincount(group)[group] > 1) & (second > 0)]
        span *= 2
    return order


class Shard:
    """The suffix array of some documents."""

    def __init__(self, texts: list[bytes | None]):
        self.words = _Numbers()
        number = self.words.__getitem__
        parts = [np.fromiter(map(number, words_of(t or b"")), np.int64) for t in texts]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.ends = np.repeat(self.bounds[1:], self.sizes)
        self.order = suffix_array(self.ids, self.ends)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.ids, minlength=len(self.words)))])

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray, after: bool) -> np.ndarray:
        """For each range of suffixes equal so far, the first whose next word is not below (above) `word`."""
        low, high = low.copy(), high.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) // 2
            at = self.order[middle] + depth
            inside = at < self.ends[self.order[middle]]
            there = np.where(inside, self.ids[np.minimum(at, len(self.ids) - 1)], -1)
            below = there <= word[todo] if after else there < word[todo]
            low[todo[below]] = middle[below] + 1
            high[todo[~below]] = middle[~below]
            todo = todo[low[todo] < high[todo]]
        return low

    def search(self, block: Block) -> tuple[np.ndarray, ...]:
        """For each suffix of the block: the window's range (low, high) and the longest match (length, low, high)."""
        local = np.array([self.words.get(w, -1) for w in block.words], np.int64)
        ids = local[block.ids] if len(block.ids) else block.ids
        n = len(ids)
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        longest, at_low, at_high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(ids >= 0)
        left, right = self.first[ids[live]], self.first[ids[live] + 1]
        depth = 1
        while len(live):
            longest[live], at_low[live], at_high[live] = depth, left, right
            whole_window = block.windows[live] == depth
            low[live[whole_window]], high[live[whole_window]] = left[whole_window], right[whole_window]
            more = live + depth < block.ends[live]
            live, left, right = live[more], left[more], right[more]
            word = ids[live + depth]
            left, right = self._bound(left, right, depth, word, False), self._bound(left, right, depth, word, True)
            found = (left < right) & (word >= 0)
            live, left, right = live[found], left[found], right[found]
            depth += 1
        return low, high, longest, at_low, at_high

    def places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the range and the position, for all suffixes in the ranges."""
        sizes = high - low
        of = np.repeat(np.arange(len(low)), sizes)
        slots = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[of]
        return of, self.order[slots]


class Block:
    """Some benchmark items: words, suffixes and the windows that start at them."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        numbers = _Numbers()
        parts = [np.fromiter(map(numbers.__getitem__, words_of(t or b"")), np.int64) for _, t in items]
        sizes = np.array([len(p) for p in parts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.words = list(numbers)
        self.ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.ends = np.repeat(bounds[1:], sizes)
        self.starts = np.arange(len(self.ids)) - np.repeat(bounds[:-1], sizes)
        self.item = np.repeat(np.arange(len(items)), sizes)
        self.names = [name for name, _ in items]
        # The length of the window that starts here; 0 where the item is too short to start one.
        least = np.minimum(np.repeat(sizes, sizes), window)
        self.windows = np.where(np.arange(len(self.ids)) + least <= self.ends, least, 0)


def _merged(starts: np.ndarray, stops: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The spans' union."""
    depth = np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(stops, minlength=n + 1))
    inside = np.concatenate([[False], depth[:n] > 0, [False]])
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


def _found(block: Block, shard_bytes: int, types: list[pa.DataType]) -> Callable:
    """Rows of FOUND, one per document."""

    def of_shard(shard: Shard) -> tuple[list, list]:
        spans: list[list] = [[] for _ in shard.sizes]
        names: list[set] = [set() for _ in shard.sizes]
        low, high, *_ = shard.search(block)
        hits = np.flatnonzero(low < high)
        if len(hits):
            # Equal windows of several items have one range.
            ranges, which = np.unique(np.stack([low[hits], high[hits], block.windows[hits]]), axis=1, return_inverse=True)
            which = which.ravel()
            of, at = shard.places(ranges[0], ranges[1])
            doc = np.searchsorted(shard.bounds, at, side="right") - 1
            items: list[set] = [set() for _ in range(ranges.shape[1])]
            for k, item in zip(which.tolist(), block.item[hits].tolist(), strict=True):
                items[k].add(block.names[item])
            pairs = np.unique(doc * len(items) + of)
            for pair in pairs.tolist():
                names[pair // len(items)] |= items[pair % len(items)]
            # A span lies in one document, but the spans of two documents may touch.
            for d, begins, ends in _by_document(shard, doc, at, at + ranges[2][of]):
                spans[d] = [{"start": s, "stop": e} for s, e in zip(begins, ends, strict=True)]
        return spans, [sorted(x) for x in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", shard_bytes):
            shard = Shard(batch.column("text").cast(pa.binary()).to_pylist())
            spans, names = of_shard(shard)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("digest"), pa.array(shard.sizes, pa.int64()),
                pa.array(spans, types[0]), pa.array(names, pa.list_(pa.string())),
            ], names=["id", "digest", "n_words", "spans", "items"])

    return run


def _by_document(shard: Shard, doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, list, list]]:
    """(document, span starts, span stops) in words of the document, overlaps merged."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    for rows in np.split(np.arange(len(doc)), cuts):
        d = int(doc[rows[0]])
        base = shard.bounds[d]
        begins, ends = _merged(start[rows] - base, stop[rows] - base, int(shard.sizes[d]))
        yield d, begins.tolist(), ends.tolist()


def _longest(block: Block, least: int, shard_bytes: int) -> Callable:
    """Rows of LONGEST, one per suffix of an item that has a match of `least` words in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", shard_bytes):
            shard = Shard(batch.column("text").cast(pa.binary()).to_pylist())
            _, _, length, low, high = shard.search(block)
            hits = np.flatnonzero(length >= least)
            of, at = shard.places(low[hits], high[hits])
            doc = np.searchsorted(shard.bounds, at, side="right") - 1
            # The place with the smallest identifier, nulls last, then the first in that text.
            ids = batch.column("id").to_pylist()
            by_id = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
            level, last = np.empty(len(ids), np.int64), 0
            for k, i in enumerate(by_id):
                last = last if k and ids[i] == ids[by_id[k - 1]] else k
                level[i] = last
            offset = at - shard.bounds[doc]
            order = np.lexsort((offset, level[doc], of))
            lead = order[np.unique(of[order], return_index=True)[1]] if len(of) else order
            yield pa.RecordBatch.from_arrays([
                pa.array([block.names[i] for i in block.item[hits]], pa.string()), pa.array(block.starts[hits], pa.int64()),
                pa.array(length[hits], pa.int64()), pa.array(high[hits] - low[hits], pa.int64()),
                batch.column("id").take(pa.array(doc[lead], pa.int64())), pa.array(offset[lead], pa.int64()),
            ], names=["item", "start", "length", "places", "id", "at"])

    return run


def benchmark_blocks(
    benchmark: DataFrame, window: int, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> Iterator[Block]:
    """The items in blocks of at most `block_bytes` of text, or a single longer item; one block at least."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), whole(text_col).alias("text")
    ).filter("text <> ''").distinct()
    parts = 1
    while True:
        numbered = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
        sizes = numbered.groupBy("block").agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("rows"))
        if not sizes.filter((F.col("size") > block_bytes) & (F.col("rows") > 1)).limit(1).count():
            break
        parts *= 2
    for at in range(parts):
        rows = numbered.filter(F.col("block") == at).orderBy("item", "text").collect()
        if rows or parts == 1:
            yield Block([(r.item, r.text.encode()) for r in rows], window)


def find(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per document: identifier, n_words, n_hit, spans of hit words (sorted), items that occur (sorted)."""
    small_batches(docs.sparkSession)
    packs = list(benchmark_blocks(benchmark, window, item_col, item_text_col, block_bytes))
    # Rows meet their hits of other blocks by identifier and content; rows that are equal in both have equal hits.
    digest = F.sha2(whole(text_col).cast("binary"), 256) if len(packs) > 1 else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), digest.alias("digest"))
    schema = FOUND.format(id=rows.schema["id"].dataType.simpleString())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    passes = [rows.mapInArrow(_found(pack, shard_bytes, [kind]), schema) for pack in packs]
    found = passes[0]
    if len(passes) > 1:
        others = reduce(DataFrame.unionByName, passes[1:]).filter(F.size("items") > 0)
        more = others.groupBy(F.col("id").alias("other"), F.col("digest").alias("content")).agg(
            F.collect_set(F.struct("spans", "items")).alias("more")
        )
        gathered = lambda f: F.concat(f, F.coalesce(F.flatten(F.col("more")[f]), F.array()))
        found = found.join(more, F.col("id").eqNullSafe(F.col("other")) & (F.col("digest") == F.col("content")), "left").select(
            "id", "n_words", F.array_sort(gathered("spans")).alias("spans"),
            F.array_sort(F.array_distinct(gathered("items"))).alias("items"),
        )
    hit = F.expr("""aggregate(spans, named_struct('till', 0L, 'n', 0L), (a, x) -> named_struct(
        'till', greatest(a.till, x.stop), 'n', a.n + greatest(0L, x.stop - greatest(a.till, x.start))), a -> a.n)""")
    return found.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), "spans", "items")


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The longest verbatim match of every suffix of an item that has one of `least` words.

    item, start (word in the item), length, places (how often that match occurs), and the first place: the
    document's identifier and the word at which it starts.  Items that share an identifier share their rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = LONGEST.format(id=rows.schema["id"].dataType.simpleString())
    passes = [
        rows.mapInArrow(_longest(pack, least, shard_bytes), schema)
        for pack in benchmark_blocks(benchmark, least, item_col, item_text_col, block_bytes)
    ]
    place = F.struct(F.col("id").isNull().alias("none"), "id", "at")
    return reduce(DataFrame.unionByName, passes).groupBy("item", "start", "length").agg(
        F.sum("places").alias("places"), F.min(place).alias("first")
    ).groupBy("item", "start").agg(F.max(F.struct("length", "places", "first")).alias("best")).select(
        "item", "start", "best.length", "best.places", F.col("best.first.id").alias(id_col), F.col("best.first.at").alias("at")
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The documents without any hit word, with all their columns; rows go through one narrow pass per block."""
    small_batches(docs.sparkSession)
    kept = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))

    def clean(pack: Block) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches, "text", shard_bytes):
                shard = Shard(batch.column("text").cast(pa.binary()).to_pylist())
                low, high, *_ = shard.search(pack)
                hits = np.flatnonzero(low < high)
                _, at = shard.places(low[hits], high[hits])
                good = np.ones(batch.num_rows, bool)
                good[np.searchsorted(shard.bounds, at, side="right") - 1] = False
                yield batch.filter(pa.array(good))

        return run

    for pack in benchmark_blocks(benchmark, window, item_col, item_text_col, block_bytes):
        kept = kept.mapInArrow(clean(pack), kept.schema)
    return kept.select("row.*")
