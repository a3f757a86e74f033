"""Decontamination, filter audit and importance resampling against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from palisade.llm import decontamination, filter_audit, importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, row string, id string, part string, line string, spans string"


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "r", "i", "p", "l", "s") for i, t, lang in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def prose(rng, n, alphabet="a b c d É 7 Zz"):
    return "".join(rng.choice(alphabet.split()) + rng.choice([" ", " ", " ", "\n", ", ", "--"]) for _ in range(n))


# ---- suffix arrays -----------------------------------------------------------------------------------------


def test_suffixes_are_sorted():
    rng = random.Random(1)
    for _ in range(60):
        docs = [[rng.randrange(3) for _ in range(rng.randrange(40))] for _ in range(rng.randrange(1, 6))]
        docs += [docs[0]] * rng.randrange(3)
        ids = np.array([w for d in docs for w in d], np.int64)
        ends = np.repeat(np.cumsum([len(d) for d in docs]), [len(d) for d in docs])
        order = decontamination.suffix_array(ids, ends).tolist()
        assert sorted(order) == list(range(len(ids)))
        suffixes = [ids[p : ends[p]].tolist() for p in order]
        assert suffixes == sorted(suffixes)


def brute_hits(text, benchmark, window):
    ws, hit, found = words(text), set(), set()
    for item, t in benchmark:
        iw = words(t)
        n = min(window, len(iw))
        for at in range(len(iw) - n + 1 if n else 0):
            for p in range(len(ws) - n + 1):
                if ws[p : p + n] == iw[at : at + n]:
                    hit |= set(range(p, p + n))
                    found.add("" if item is None else str(item))
    return len(ws), hit, sorted(found)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randrange(60)), "en") for k in range(40)]
    rows += [(40, None, None), (41, "", "en"), (None, rows[3][1], "en"), (3, rows[3][1], "en"), (3, rows[3][1], "en"), (42, "solo", "de")]
    benchmark = [(k, prose(rng, rng.randrange(12))) for k in range(15)]
    benchmark += [(15, rows[7][1]), (16, rows[7][1]), (16, rows[8][1]), (17, None), (18, ""), (19, "Solo"), (None, rows[9][1]), (15, rows[7][1])]
    return rows, benchmark


@pytest.mark.parametrize(("shard", "block"), [(300, 16_000_000), (8_000_000, 400)])
def test_hits_equal_brute_force(spark, mixed, shard, block):
    rows, benchmark = mixed
    got = decontamination.find(frame(spark, rows), items(spark, benchmark), window=5, shard_bytes=shard, block_bytes=block).collect()
    covered = [sorted({w for s in r.spans for w in range(s.start, s.stop)}) for r in got]
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, str(c), str(r["items"])) for r, c in zip(got, covered, strict=True)) == sorted(
        (str(i), n, len(hit), str(sorted(hit)), str(found)) for i, t, _ in rows for n, hit, found in [brute_hits(t, benchmark, 5)]
    )
    left = decontamination.decontaminate(frame(spark, rows), items(spark, benchmark), window=5, shard_bytes=shard, block_bytes=block)
    assert left.columns == frame(spark, rows).columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted(
        (str(i), str(t)) for i, t, _ in rows if not brute_hits(t, benchmark, 5)[1]
    )


def test_longest_matches_equal_brute_force(spark, mixed):
    rows, benchmark = mixed
    rows = [(i, t, lang) for i, t, lang in rows if i is not None]
    texts = [(i, words(t)) for i, t, _ in rows]
    expected = {}
    for item, t in benchmark:
        iw = words(t)
        for at in range(len(iw)):
            best, places = 0, []
            for i, ws in texts:
                for p in range(len(ws)):
                    n = 0
                    while at + n < len(iw) and p + n < len(ws) and iw[at + n] == ws[p + n]:
                        n += 1
                    best, places = (n, [(i, p)]) if n > best else (best, [*places, (i, p)] if n == best else places)
            if best >= 4:
                key = ("" if item is None else str(item), at)
                expected[key] = max(expected.get(key, (0,)), (best, len(places), *min(places)))
    # Items that share an identifier share rows; without them places are exact.
    shared = {"15", "16"}
    got = decontamination.longest_matches(frame(spark, rows), items(spark, benchmark), least=4, shard_bytes=250).collect()
    assert {(r["item"], r.start): (r.length, r.places, r.doc_id, r["at"]) for r in got if r["item"] not in shared} == {
        k: v for k, v in expected.items() if k[0] not in shared
    }


def test_decontamination_without_rows(spark, mixed):
    rows, benchmark = mixed
    assert decontamination.find(frame(spark, []), items(spark, benchmark)).collect() == []
    got = decontamination.find(frame(spark, rows), items(spark, [])).collect()
    assert len(got) == len(rows) and not any(r.n_hit or r["items"] for r in got)
    assert decontamination.decontaminate(frame(spark, rows), items(spark, [])).count() == len(rows)
    assert decontamination.longest_matches(frame(spark, []), items(spark, benchmark)).collect() == []


def test_a_very_long_text(spark):
    rng = random.Random(8)
    long = " ".join(str(rng.randrange(1000)) for _ in range(400_000))
    item = " ".join(long.split()[399_980:])
    got = decontamination.find(frame(spark, [(1, long, "en"), (2, "x", "en")]), items(spark, [(1, item)])).collect()
    assert {r.doc_id: (r.n_words, r.n_hit) for r in got} == {1: (400_000, 20), 2: (1, 0)}


# ---- filter audit ------------------------------------------------------------------------------------------


def test_merges_equal_sets():
    rng = random.Random(2)
    for _ in range(200):
        lists = [np.array(sorted(rng.sample(range(400), rng.choice([0, 1, 5, 60, 300]))), np.int32) for _ in range(rng.randrange(6))]
        assert filter_audit.union_size(lists) == len(set().union(*[x.tolist() for x in lists]))
        if len(lists) > 1:
            assert filter_audit.difference(lists[0], lists[1]).tolist() == sorted(set(lists[0].tolist()) - set(lists[1].tolist()))


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    docs = []
    for i, t, lang in rows:
        t = t or ""
        ws = t.encode().split()
        fails = "".join(name for name, bad in (
            ("A", len(ws) < 100), ("B", 100 * len(set(ws)) < 80 * len(ws)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)),
            ("D", any(c in "#$%&*|" for c in t)),
            ("E", i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)),
        ) if bad)
        docs.append((i, lang or "", fails))
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                total[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f for _, f in own) - len(gone), sum(f == name for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name,
                ]
        for (p, *_), v in out.items():
            if p == part:
                v[-1] = total[v[-1]]
    return out


@pytest.mark.parametrize("size", [65_536, 3])
def test_audit_equals_brute_force(spark, size):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["One", "two", "THREE", "4", "f#ve", "éé"]) + str(rng.randrange(m)) for _ in range(n))
             for n in (0, 5, 99, 100, 130) for m in (2, 1000)]
    rows = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(60)]
    rows += [(7, rows[7][1], "en"), (7, rows[7][1], "en"), (None, rows[1][1], "en"), (100, None, None), (101, "", "fr")]
    labels = [(k, rng.randrange(2), rng.randrange(2)) for k in range(0, 70, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    lists = filter_audit.postings(frame(spark, rows), marks, range_rows=size)
    got = filter_audit.audit(lists, list(filter_audit.FILTERS)).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in got} == brute_audit(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_audit_of_other_filters(spark):
    rows = [(1, "a b", "en"), (2, "a b", "en"), (3, "c", "en")]
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    filters = {"short": lambda ws, text: len(ws) < 2, "same": filter_audit.COPIES}
    got = filter_audit.audit_documents(frame(spark, rows), marks, filters).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in got} == {
        ("shortsame", 1): (2, 1, 2), ("shortsame", 2): (1, 1, 2), ("sameshort", 1): (2, 1, 2), ("sameshort", 2): (1, 1, 2),
    }
    assert filter_audit.audit_documents(frame(spark, []), marks).collect() == []


# ---- importance resampling ---------------------------------------------------------------------------------


def brute_draw(rows, target, order, buckets, percent, least):
    def features(text):
        ws = [w.encode() for w in words(text)]
        return Counter(zlib.crc32(b" ".join(ws[p : p + n])) % buckets for n in range(1, order + 1) for p in range(len(ws) - n + 1))

    corpus = sum((features(t) for _, t, _ in rows), Counter())
    wanted = sum((features(t) for _, t in target), Counter())
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, t, _ in rows:
        f = features(t)
        weight = sum(gain[b] * n for b, n in f.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(t)), sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(str, out))


@pytest.mark.parametrize("order", [1, 3])
def test_draw_equals_brute_force(spark, order):
    rng = random.Random(6)
    line = "the same Line, in many texts"
    rows = [(k, prose(rng, rng.randrange(80)) + ("\n" + line) * rng.randrange(3), "en") for k in range(80)]
    rows += [(80, None, None), (81, "", "en"), (82, "\n\n \n", "en"), (None, rows[2][1], "en"), (5, rows[5][1], "en"), (5, rows[5][1], "en")]
    target = [(1, line), (2, "É a b\nc"), (3, None), (4, "")]
    got = importance.resample(frame(spark, rows), items(spark, target), 40, 20, order, 97)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(str(list(r)) for r in got.collect()) == brute_draw(rows, target, order, 97, 40, 20)


def test_hot_lines_meet_by_broadcast(spark, monkeypatch):
    rows = [(k, f"line one\nline {k}\nline one " + "x " * 20, "en") for k in range(50)]
    expected = brute_draw(rows, [(1, "line one")], 1, 50, 50, 20)
    for share in (1, 10, 10**9):
        monkeypatch.setattr(importance, "HOT_SHARE", share)
        got = importance.resample(frame(spark, rows), items(spark, [(1, "line one")]), 50, 20, 1, 50).collect()
        assert sorted(str(list(r)) for r in got) == expected


def test_draw_without_rows(spark):
    rows = [(k, "w " * 30, "en") for k in range(10)]
    assert importance.resample(frame(spark, []), items(spark, [(1, "a")])).collect() == []
    assert [r["rank"] for r in importance.resample(frame(spark, rows), items(spark, [])).collect() if r["rank"]] == [1]
    drawn = importance.draw(frame(spark, rows), items(spark, [(1, "w")]), percent=30)
    assert drawn.count() == 3 and drawn.columns == frame(spark, rows).columns
