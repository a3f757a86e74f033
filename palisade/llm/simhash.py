"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into three segments of at most 23 bits.  Two fingerprints with at most two
differing bits agree fully in one segment, and every other segment differs in at most two bits.  Two 23-bit
words that differ in at most two bits share a codeword of the (23,12) Golay code within distance four: the
code is perfect with radius three, and the word half way between them is within three bits of a codeword.
So each segment in turn gives keys made of its own bits and of the index of each codeword (one, or six) near
the next segment, and every pair shares a key.  Rows with a key are compared in sorted runs: fingerprints
link when they share a point at most one bit away from both, which is the same as a distance of two or less.
A run returns links to one member of each cluster, never pairs; a run of more than `run_limit` different
fingerprints is not held by one task but goes on as points, of which 65 fingerprints at most share one.

Fingerprints are made distinct before any key is made, so copies cost one row.  Components come from
alternating large and small stars, each round written to the shared folder.

Defined cases: a null or empty text, or one of white space alone, has fingerprint zero and links like any
other; a null identifier is larger than any other, and a component of null identifiers alone has a null
component; rows with equal identifiers each get their row; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import materialize, small_batches, whole

SEED = 42
#: Generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
RUN_LIMIT = 20_000


# ---- fingerprints -------------------------------------------------------------------------------------------


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of a text in UTF-8; A-Z count as lower case, repeated shingles count each time."""
    words = text.lower().split()
    if not words:
        return 0
    runs = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[w] for w in words]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*runs, strict=False))], np.uint64)
    bits = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 65_536):
        octets = hashes[part:part + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * bits > len(hashes)).tolist()))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(docs: DataFrame, shingle: int = 3, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns and the fingerprint as a signed 64-bit number."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("bigint")
    def hashed(text: pa.Array) -> pa.Array:
        return pa.array([_signed(fingerprint(t.encode(), shingle)) for t in text.to_pylist()], pa.int64())

    return docs.withColumn(out, hashed(whole(text_col)))


def as_hex(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- Golay keys ---------------------------------------------------------------------------------------------


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def _near_patterns() -> np.ndarray:
    """For each syndrome, the error patterns of weight four or less that have it, padded by repeating the first."""
    patterns = np.array(
        [sum(1 << i for i in bits) for n in range(5) for bits in itertools.combinations(range(23), n)], np.int64
    )
    syndromes = _syndrome(patterns)
    out = np.zeros((2048, 6), np.int64)
    for s in range(2048):
        found = patterns[syndromes == s]
        out[s] = np.resize(found, 6) if len(found) == 6 else np.full(6, found[0])
    return out


_tables: list[np.ndarray] = []


def near_codewords(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within distance four of each word: six columns, or one repeated."""
    if not _tables:
        _tables.append(_near_patterns())
    return (words[:, None] ^ _tables[0][_syndrome(words)]) >> 11


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys; a key holds the segment's number, its bits and a codeword index of the next one."""
    rows, keys = [], []
    words = fps.view(np.uint64)
    parts = [((words >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    for i, own in enumerate(parts):
        near = near_codewords(parts[(i + 1) % len(parts)])
        keep = np.ones(near.shape, bool)
        keep[:, 1:] = near[:, 1:] != near[:, :1]
        at, column = np.nonzero(keep)
        rows.append(at)
        keys.append((i << 34) | (own[at] << 12) | near[at, column])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        at, keys = keys_of(fps)
        for part in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[part:part + 100_000]), pa.array(fps[at[part:part + 100_000]])], names=["key", "fp"]
            )


# ---- links --------------------------------------------------------------------------------------------------

_FLIPS = np.concatenate([[0], np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))]).astype(np.uint64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of n items' cluster, by the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (a, b):
            np.minimum.at(root, before[side], low)
        root = root[root]
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return root


def linked(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct fingerprints: pairs of a member and the first member of its cluster, by distance two or less."""
    n, words = len(fps), fps.view(np.uint64)
    if n <= 64:
        a, b = np.nonzero(np.triu(np.bitwise_count(words[:, None] ^ words[None, :]) <= 2, 1))
    else:
        points = (words[:, None] ^ _FLIPS[None, :]).ravel()
        order = np.argsort(points)
        same = points[order][1:] == points[order][:-1]
        owner = order // len(_FLIPS)
        a, b = owner[:-1][same], owner[1:][same]
    if not len(a):
        return fps[:0], fps[:0]
    root = _roots(n, a, b)
    child = np.flatnonzero(root != np.arange(n))
    return fps[root[child]], fps[child]


def _runs(limit: int):
    """Sorted (key, fp) rows to links (a, b); members of a run beyond the limit come out as (fp, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, over = None, np.zeros(0, np.int64), False

        def rows(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
            return pa.RecordBatch.from_arrays([pa.array(a), other], names=["a", "b"])

        for batch in batches:
            keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(keys):
                continue
            bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            sizes = np.diff(bounds)
            out_a, out_b = [], []
            # A run that no batch border cuts and that has one member has no links.
            for at in sorted({0, len(sizes) - 1, *np.flatnonzero(sizes > 1).tolist()}):
                own, part = keys[bounds[at]], fps[bounds[at]:bounds[at + 1]]
                if key is None or own != key:
                    if len(held) > 1:
                        a, b = linked(held)
                        out_a.append(a)
                        out_b.append(b)
                    key, held, over = own, part, False
                elif over:
                    yield rows(part, None)
                else:
                    held = np.concatenate([held, part])
                if len(held) > limit:
                    yield rows(held, None)
                    held, over = held[:0], True
            if out_a and sum(map(len, out_a)):
                yield rows(np.concatenate(out_a), np.concatenate(out_b))
        if len(held) > 1:
            yield rows(*linked(held))

    return run


def links(fps: DataFrame, run_limit: int = RUN_LIMIT) -> DataFrame:
    """Links (a, b), a < b in no particular order, that connect what a distance of at most two connects.

    `fps` has one column fp of distinct fingerprints.
    """
    keyed = fps.mapInArrow(_keyed, "key bigint, fp bigint")
    found = materialize(
        keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_runs(run_limit), "a bigint, b bigint"),
        "simhash-links",
    )
    direct = found.filter(F.col("b").isNotNull())
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)).cast("bigint") for i in range(64)])
    points = found.filter(F.col("b").isNull()).select("a").distinct().select(
        "a", F.explode(F.transform(flips, lambda m: F.col("a").bitwiseXOR(m))).alias("point")
    )
    # At most 65 fingerprints lie within one bit of a point.
    shared = points.groupBy("point").agg(F.array_sort(F.collect_set("a")).alias("near")).filter(F.size("near") > 1)
    far = shared.select(
        F.element_at("near", 1).alias("a"), F.explode(F.slice(F.col("near"), 2, 64)).alias("b")
    )
    return direct.unionByName(far).distinct()


# ---- components ---------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of an edge with the smallest node reachable.  Large and small stars in turn."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(low, "u")
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                low.select("u", F.col("m").alias("v"))
            )
        return out.filter(F.col("u") != F.col("v")).distinct()

    mark = None
    while True:
        edges = materialize(star(star(edges, True), False), "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(now)


def near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text",
    run_limit: int = RUN_LIMIT,
) -> DataFrame:
    """One row per document: identifier, fingerprint (signed number), component_id."""
    hashed = materialize(
        with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle, out="fp")
        .select("id", "fp"),
        "simhash",
    )
    roots = component_of_fingerprints(hashed, max_bits, run_limit)
    return hashed.join(roots, "fp").select(
        F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id"
    )


def component_of_fingerprints(hashed: DataFrame, max_bits: int = 2, run_limit: int = RUN_LIMIT) -> DataFrame:
    """(fp, root, component_id) for a written table of (id, fp); root is the component's smallest fingerprint."""
    if max_bits != 2:
        raise ValueError("the keys hold for two differing bits")
    distinct = materialize(hashed.groupBy("fp").agg(F.min("id").alias("least")), "simhash-fps")
    roots = components(links(distinct.select("fp"), run_limit))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def deduplicate(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row of each component, with all its columns: the smallest identifier, then the smallest fingerprint."""
    small_batches(docs.sparkSession)
    rows = materialize(
        with_fingerprint(docs.select(F.struct("*").alias("row")), shingle, f"row.{text_col}", "fp").select(
            "row", F.col(f"row.{id_col}").alias("id"), "fp", F.monotonically_increasing_id().alias("at")
        ),
        "simhash-rows",
    )
    # The number of a row in the written table tells equal rows apart.
    first = F.struct(F.col("id").isNull().alias("last"), "id", "fp", "at")
    per_print = rows.groupBy("fp").agg(F.min(first).alias("first"))
    chosen = per_print.join(component_of_fingerprints(rows.select("id", "fp"), max_bits), "fp").groupBy("root").agg(
        F.min("first").alias("first")
    ).select(F.col("first.at").alias("at"))
    return rows.join(chosen, "at", "left_semi").select("row.*")
