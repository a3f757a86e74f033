"""Exact dedup and SimHash components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from palisade.llm import exact_dedup, simhash

SCHEMA = "doc_id bigint, text string, id string, row string, h string, fp bigint, text_sha256 string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", 7, "s", "c") for i, t in rows], SCHEMA)


def squeezed(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


ROWS = [
    (5, "a b"), (3, "ab"), (4, "a  b"), (9, None), (8, ""), (7, " \n"), (1, "a b"), (2, "ab"), (2, "ab"), (None, "q"),
    (6, "q"), (11, "q "), (12, "x" * 50_000), (13, "x" * 50_000 + " "),
] + [(100 + i, "hot text") for i in range(60)]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(squeezed(t), []).append((-len(t or ""), i is None, i or 0))
    return {key: (min(members), len(members)) for key, members in groups.items()}


@pytest.mark.parametrize("share", [4, 1000])
def test_exact_groups(spark, share):
    found = exact_dedup.exact_groups(frame(spark, ROWS), hot_share=share).collect()
    groups = brute(ROWS)
    assert len(found) == len(ROWS)
    expected = sorted(
        (str(i), str(None if groups[squeezed(t)][0][1] else groups[squeezed(t)][0][2]), groups[squeezed(t)][1])
        for i, t in ROWS
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in found) == expected
    assert sum(r.kept for r in found) == len(groups)


def test_hot_texts_are_split_and_merged(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        rows = [(i, "same " * 3) for i in range(300)] + [(1000 + i, f"own {i}") for i in range(100)]
        runs = exact_dedup._sorted_runs(frame(spark, rows), "doc_id", "text", False, 8)
        assert runs.filter("hot").select("salt").distinct().count() > 3
        found = exact_dedup.exact_groups(frame(spark, rows), hot_share=8).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {r.keep_id for r in found if r.doc_id < 300} == {0}
    assert [r.doc_id for r in found if r.kept and r.doc_id < 300] == [0]


def test_exact_rows_that_stay(spark):
    kept = exact_dedup.deduplicate(frame(spark, ROWS), hot_share=4)
    assert kept.columns == frame(spark, []).columns
    groups = brute(ROWS)
    assert sorted(squeezed(r.text) for r in kept.collect()) == sorted(groups)


def test_empty_tables(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).collect() == []
    assert exact_dedup.deduplicate(frame(spark, [])).collect() == []
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert simhash.deduplicate(frame(spark, [])).collect() == []


# ---- SimHash ------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "É a b c É a b", "a b c d e f g " * 40, "x y z\x0bq ß"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_words_within_two_bits_share_a_codeword():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    near = simhash.near_codewords(words)
    for word, own in zip(words.tolist(), near.tolist(), strict=True):
        assert len(set(own)) in (1, 6)
        a, b = rng.integers(0, 23, 2).tolist()
        other = simhash.near_codewords(np.array([word ^ (1 << a) ^ (1 << b) if a != b else word ^ (1 << a)]))[0]
        assert set(own) & set(other.tolist())


def components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def clustered(n, seed):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n // 10)]
    while len(fps) < n:
        base = rng.choice(fps[-8:] + fps[:8])
        for _ in range(rng.choice([0, 1, 2, 2, 3])):
            base ^= 1 << rng.randrange(64)
        fps.append(base)
    return fps


@pytest.mark.parametrize("limit", [20_000, 5])
def test_components_against_all_pairs(spark, limit):
    fps = clustered(400, 3)
    rows = [(i, simhash._signed(f)) for i, f in enumerate(fps)]
    table = spark.createDataFrame(rows, "id bigint, fp bigint")
    found = {r.fp: r.component_id for r in simhash.component_of_fingerprints(table, 2, limit).collect()}
    roots = components(fps)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, i), i)
    assert [found[fp] for _, fp in rows] == [least[r] for r in roots]


def test_links_within_large_runs():
    fps = np.array(sorted({simhash._signed(f) for f in clustered(300, 5)}), np.int64)
    a, b = simhash.linked(fps)
    joined = {int(f): {int(f)} for f in fps}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        whole = joined[x] | joined[y]
        for f in whole:
            joined[f] = whole
    roots = components([int(f) & ((1 << 64) - 1) for f in fps])
    assert len({frozenset(s) for s in joined.values()}) == len(set(roots))


def test_near_duplicates_of_texts(spark):
    words = [f"w{i}" for i in range(300)]
    other = [*words[:299], "changed"]
    rows = [(4, " ".join(words)), (2, " ".join(other)), (9, "something else entirely here"), (8, None), (7, ""), (7, ""),
            (None, " ".join(words).upper())]
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    prints = [slow_fingerprint(t) for _, t in rows]
    roots = components(prints)
    least = {r: min((i for (i, _), q in zip(rows, roots, strict=True) if q == r and i is not None), default=None) for r in roots}
    assert sorted(map(str, (r.component_id for r in found))) == sorted(str(least[r]) for r in roots)
    kept = simhash.deduplicate(frame(spark, rows)).collect()
    assert len(kept) == len(set(roots))
    assert {r.doc_id for r in kept} == set(least.values())
