import random
import re

from pyspark.sql import functions as F

from palisade.operators import detect as D
from palisade.operators.matching import contains_join, prefix_join, regex_join
from palisade.operators.numbering import number_rows


def col(spark, name, values):
    return spark.createDataFrame([(v,) for v in sorted(set(values))], f"{name} string")


def words(rng, n, size):
    return {"".join(rng.choice("ab/.") for _ in range(rng.randint(1, size))) for _ in range(n)}


def test_prefix_join(spark):
    rng = random.Random(1)
    texts, prefixes = words(rng, 300, 8), words(rng, 60, 4)
    got = {tuple(r) for r in prefix_join(col(spark, "t", texts), "t", col(spark, "p", prefixes), "p").collect()}
    assert got == {(t, p) for t in texts for p in prefixes if t.startswith(p)}


def test_contains_join(spark):
    rng = random.Random(2)
    texts, needles = words(rng, 300, 10), {w.upper() for w in words(rng, 60, 5)} | {"a", "B/"}
    rows = contains_join(col(spark, "t", texts), "t", col(spark, "n", needles), "n").collect()
    assert len(rows) == len(set(rows))
    assert {tuple(r) for r in rows} == {(t, n) for t in texts for n in needles if n.lower() in t.lower()}


def test_regex_join_with_a_broken_regex(spark):
    texts = ["/a.php", "/A.PHP", "/wp-admin", "/x"]
    patterns = [(r"\.php$", True), (r"\.php$", False), (r"^/wp-(admin|login)", False), ("[", True), ("x", False)]
    df = spark.createDataFrame(patterns, "p string, i boolean")
    got = {tuple(r) for r in regex_join(col(spark, "t", texts), "t", df, "p", "i").collect()}
    assert got == {(t, p, i) for t in texts for p, i in patterns if p != "[" and re.search(p, t, re.I if i else 0)}


def test_numbering_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.7 else f"g{i % 5}") for i in rng.sample(range(10**6), 3000)]
    df = spark.createDataFrame(rows, "o long, g string").repartition(11)
    got = {r.o: r.n for r in number_rows(df, "o", ["g"], buckets=8).collect()}
    seen = {}
    for o, g in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        assert got[o] == seen[g]
    flat = number_rows(df, "o", buckets=8).orderBy("o").select("n").collect()
    assert [r.n for r in flat] == list(range(1, 3001))


def test_burst_slices_do_not_change_the_answer(spark):
    rng = random.Random(4)
    base = 1_700_000_000
    rows = [(i, "1.1.1.1", "dotfile", base + rng.randint(0, 4 * 3600) / 1.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "ord long, remote_addr string, path_class string, s double").select(
        "ord", "remote_addr", "path_class", F.timestamp_seconds("s").alias("ts"))
    got = {r.ord: r.probes for r in D.burst_detect(df, 2, 1).collect()}
    for o, _, _, s in rows:
        assert got[o] == sum(1 for r in rows if s - 2 <= r[3] <= s)
