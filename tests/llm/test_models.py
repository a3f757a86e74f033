"""Language models, language identification and quality rules against brute force."""

import itertools
import math
import random
import tracemalloc
import zlib
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from palisade.llm import language_id, ppm, quality_rules
from palisade.llm.common import held_out

# ---- prediction by partial matching ---------------------------------------------------------------------------

DOCS = [
    (1, "the cat sat on the mat"), (2, "The hat"), (3, None), (4, ""), (5, "der Hund im Haus é"), (5, "a second five"),
    (6, "the cat sat on the mat"), (6, "the cat sat on the mat"), (None, "no name"), (7, "zebra \x0b\x0c quick\nfox\tjumps"),
    (8, "unseen ẞ symbols 梦"), (9, "  "), (10, "the the the the"),
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", b"g") for i, t in rows], "doc_id bigint, text string, block int, w string, g binary")


def learns(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 != 2


@pytest.mark.parametrize("order", [0, 2, 5])
def test_scores_equal_the_trie(spark, order):
    found = ppm.score(docs(spark, DOCS), ~held_out("doc_id", 3, 2), order).collect()
    trie, counts = ppm.Trie(order), {}
    for i, t in DOCS:
        if learns(i):
            trie.read(t or "", True)
            for w in [*(t or "").encode().lower().split(), b"\n"]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, t in DOCS:
        words = [*(t or "").encode().lower().split(), b"\n"]
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words)
        expected.append((str(i), len(words), sum(w in counts for w in words), n, round(base, 6), round(trie.read(t or "", False), 6)))
    got = [(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found]
    assert sorted(got) == sorted(expected)


def test_scores_without_training_and_without_rows(spark):
    found = ppm.score(docs(spark, DOCS[:2]), F.lit(False), 3).collect()
    assert [round(r.score, 6) for r in sorted(found, key=lambda r: r.doc_id)] == [
        round(-math.log10(256) * (len(t) + 1), 6) for _, t in DOCS[:2]
    ]
    assert ppm.score(docs(spark, []), F.lit(True), 3).collect() == []


def test_chances_add_up_to_one():
    trie = ppm.Trie(3)
    trie.read("banana bandana", True)
    for context in (b"\xff\xff\xff", b"ana", b"xyz", b"nba"):
        assert math.isclose(sum(10 ** trie.log_chance(context, s) for s in range(256)), 1)


def test_parts_of_long_texts_hold_the_same_strings(monkeypatch):
    data = b"some words and more words " * 30
    monkeypatch.setattr(ppm, "CHUNK", 100)
    cut = ppm._chunks(data)
    assert len(cut) > 3 and b"".join(cut) == data
    parts = [(before[-4:], own, i == len(cut) - 1) for i, (before, own) in enumerate(zip([b"", *cut[:-1]], cut, strict=True))]
    codes, lengths = ppm.symbols(parts, 4)
    assert codes.tolist() == ppm.symbols([(b"", data, True)], 4)[0].tolist()
    assert [w for c in cut for w in c.split()] == data.split() and lengths.sum() == len(data) + 1


def test_adaptive_scores(spark):
    rows = [(1, "abab" * 20), (2, None), (3, "")]
    found = {r.doc_id: r.score for r in ppm.adaptive(docs(spark, rows), 3).collect()}
    assert found == {i: pytest.approx(ppm.Trie(3).read(t or "", True)) for i, t in rows}
    assert found[1] > -81 * math.log10(256) / 4


def test_lookup_with_shared_slots():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 48, 5000))
    codes = rng.choice(keys, 20_000)
    assert (keys[ppm._lookup(keys, codes)] == codes).all()


def by_blocks(monkeypatch, texts, order=5, buckets=4):
    """Sums per text by blocks alone, with made-up chances; the sums of all requests; blocks; most bytes held at once."""
    monkeypatch.setattr(ppm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batches = [pa.RecordBatch.from_pydict({"id": [i], "mark": [i], "train": [i % 7 > 0], "content": [t]}) for i, t in enumerate(texts)]
    tracemalloc.start()
    made = pa.Table.from_batches(ppm._requests(order, buckets)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    asked = made.filter(pc.is_valid(made["bucket"])).drop_columns(["texts"])
    model = {b: ppm._merged(asked.filter(pc.equal(asked["bucket"], b))).to_pylist()[0] for b in range(buckets)}
    counts = dict(pair for m in model.values() for pair in zip(ppm._unpack_words(m["w"]), ppm._unpack(m["w_n"], np.float64).tolist(), strict=True))
    strings = [ppm._unpack(m[c], k).tobytes() for m in model.values() for c, k in (("g", np.int64), ("g_n", np.float64))]
    known = {b: pa.Table.from_pylist([{**m, "g_v": ppm._pack(-(ppm._unpack(m["g"], np.int64) % 1000 / 8))}]) for b, m in model.items()}
    sums = {}
    numbers = sorted(set(made["block"].to_pylist()))
    for number in numbers:
        own = made.filter(pc.equal(made["block"], number))
        answers = pa.concat_tables(
            ppm._answered(own.filter(pc.equal(own["bucket"], b)).drop_columns(["texts"]), known[b]) for b in range(buckets)
        )
        held = own.filter(pc.is_valid(own["texts"])).select(["block", "texts"])
        tracemalloc.reset_peak()
        for r in ppm._scorer(order, 1000)(held, answers).to_pylist():
            sums.setdefault(r["id"], np.zeros(4))
            sums[r["id"]] += [r["n_tokens"], r["n_known"], r["base_score"], r["score"]]
        peak = max(peak, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    return np.array([sums[i] for i in range(len(texts))]), (counts, strings), len(numbers), peak


@pytest.mark.parametrize("limits", [{"BLOCK": 900}, {"BLOCK_WORDS": 5}, {"BLOCK_STRINGS": 40}, {"SLICE": 1, "BLOCK": 1}])
def test_scores_do_not_depend_on_blocks(monkeypatch, limits):
    texts = [*(t or "" for _, t in DOCS), "long text of many words " * 20, "other words here " * 9, "unseen"]
    expected, model, n, _ = by_blocks(monkeypatch, texts)
    assert n == 1
    for name, value in {"CHUNK": 100, "SLICE": 300, **limits}.items():
        monkeypatch.setattr(ppm, name, value)
    found, same_model, n, _ = by_blocks(monkeypatch, texts)
    assert n > 2 and np.allclose(found, expected, rtol=1e-12) and same_model == model


def test_memory_of_a_block(monkeypatch):
    """8 MB of text are counted and scored a slice at a time."""
    rng = np.random.default_rng(5)
    words = [bytes(w).decode() for w in rng.integers(97, 123, (200, 6), dtype=np.uint8)]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 1000)) for _ in range(1200)]
    sums, _, n, peak = by_blocks(monkeypatch, texts)
    assert n == 1 and (sums[:, 0] == 1001).all() and peak < 80e6


# ---- languages ------------------------------------------------------------------------------------------------


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(3)
    lengths = np.array([4, 3, 3, 1])
    scores, move, start = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    chance, loglik, moves = language_id.forward_backward(scores, lengths, move, start)
    at, total, expected_moves = 0, 0.0, np.zeros((3, 3))
    for n in lengths:
        own, weight, sums, paths = scores[at:at + n], 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = math.exp(start[path[0]] + sum(own[t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
            weight += w
            for t, y in enumerate(path):
                sums[t, y] += w
            for a, b in zip(path, path[1:], strict=False):
                paths[a, b] += w
        assert np.allclose(chance[at:at + n], sums / weight)
        total += math.log(weight)
        expected_moves += paths / weight
        at += n
    assert math.isclose(loglik, total) and np.allclose(moves, expected_moves)


EN = "the house and the river with that thing from there which they thought".split()
DE = "das Haus und der Fluss mit dem Ding von dort welches sie dachten".split()


def speak(words, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


def test_languages_word_by_word():
    texts = [speak(EN, 60, i) for i in range(20)] + [speak(DE, 60, i) for i in range(20)]
    field = language_id.fit(texts, ["en"] * 20 + ["de"] * 20)
    assert np.all(np.diag(field.transition) > field.transition.T[~np.eye(2, dtype=bool)])
    memo = language_id._Memo(field)
    found = language_id.label_texts([speak(EN, 30, 99), speak(DE, 9, 98), "", "12 !?", speak(EN, 30, 1) + " " + speak(DE, 10, 2)], field, memo)
    assert [f[0] for f in found] == ["en", "de", "und", "und", "en"]
    assert found[2][1] == found[3][1] == 0 and found[0][1] > 0.9 > found[4][1] > 0.5


def test_language_tables(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(-1, None, "en"), (-2, "", "de"), (-3, "123 !!", None), (-3, "123 !!", None)], "doc_id bigint, text string, lang string")
    rows = table.select("doc_id", "text", "lang").unionByName(more).withColumn("prediction", F.lit("mine"))
    held = held_out("doc_id", 4, 2)
    found, _ = language_id.identify(rows.drop("prediction"), ~held)
    got = found.withColumn("held", held).collect()
    assert [r.prediction.lang for r in got if r.doc_id < 0] == ["und"] * 4
    known = [r for r in got if r.held and r.doc_id >= 0]
    assert sum(r.prediction.lang == r.lang for r in known) > 0.95 * len(known)
    assert all(0 <= r.prediction.score <= 1 for r in got)
    assert language_id.identify(rows.filter("false").drop("prediction"), ~held)[0].collect() == []
    nothing, _ = language_id.identify(rows.drop("prediction").withColumn("lang", F.lit(None).cast("string")).limit(3), ~held)
    assert {r.prediction.lang for r in nothing.collect()} == {"und"}


def test_the_sample_is_the_first_texts_by_hash(spark):
    rows = [(i, f"text number {i}", "en" if i % 3 else "de") for i in range(300)] + [(7, "text number 7", "en")] * 400 + [(1, None, "en"), (2, "x", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(7)
    texts, labels = language_id.training_sample(table, F.col("doc_id") != 5, 20, "doc_id", "text", "lang")
    hashed = table.where("doc_id <> 5 AND lang IS NOT NULL AND text IS NOT NULL").selectExpr("lang", "xxhash64(doc_id, text) h", "text").distinct().collect()
    expected = [sorted((r.h, r.text) for r in hashed if r.lang == lang)[:20] for lang in ("de", "en")]
    assert texts == [t for part in expected for _, t in part] and labels == ["de"] * 20 + ["en"] * 20
    assert language_id.training_sample(table, F.col("doc_id") < 0, 20, "doc_id", "text", "lang") == ([], [])


# ---- quality --------------------------------------------------------------------------------------------------


def slow_measure(text):
    lines, words = text.split("\n"), [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    full = [line for line in lines if line.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(line in full[:i] for i, line in enumerate(full)), len(marked))


@pytest.mark.parametrize("text", ["", " ", "a", "a b c a b c", "x x x x", "a a\nb\na a\n\n\nb", "é#\u00a0ß *|\n a b c d a b c", "q w e r q w e q w e"])
def test_measures(text):
    assert quality_rules.measure(text)[:5] == slow_measure(text)


def test_binomial_tail_is_exact():
    for n, k, rate in ((10, 0, Fraction(1, 10)), (40, 3, Fraction(1, 20)), (25, 25, Fraction(1, 2))):
        exact = sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))
        assert math.isclose(quality_rules.binomial_tail(k, n, float(rate)), exact, rel_tol=1e-9)


def test_certified_cutoffs_stop_at_the_first_failure():
    assert quality_rules.certified([0, 0, 1, 900, 0], 2000, 0.01, 0.001) == 3
    assert quality_rules.certified([0], 10, 0.01, 0.001) == 0
    assert quality_rules.certified([0], 0, 0.01, 0.001) == 0


def test_quality_tables(spark):
    rng = random.Random(5)
    clean = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)), "en") for i in range(1200)]
    junk = [(2000 + i, " ".join("$$$" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)), "en") for i in range(50)]
    odd = [(-1, None, "en"), (-2, "", None), (-3, "few words", None), (-4, "a b c " * 30, "fr"), (-4, "a b c " * 30, "fr"), (None, clean[0][1], None)]
    rows = spark.createDataFrame(clean + junk + odd, "doc_id bigint, text string, lang string").withColumns({"stratum": F.lit(1), "n_words": F.lit("x")})
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(1000)] + [(2000 + i, 0, 0) for i in range(25)] + [(5, 0, 0), (99_999, 1, 0), (None, 1, 0), (7, None, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    measured = quality_rules.assess(rows, labels, risk=0.05)
    got = measured.collect()
    assert len(got) == len(clean + junk + odd)
    assert all(r.kept for r in got if r.doc_id is not None and 0 <= r.doc_id < 1200)
    assert not any(r.kept for r in got if r.doc_id is not None and (r.doc_id >= 2000 or r.doc_id < 0))
    kept = quality_rules.keep_good(rows, labels, risk=0.05)
    assert kept.columns == rows.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    none = quality_rules.assess(rows, labels.filter("false")).collect()
    assert all(r.kept != r.base_failed for r in none)
    assert quality_rules.assess(rows.filter("false"), labels).collect() == []
