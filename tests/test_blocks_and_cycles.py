"""Blocks against a stack, cycles of includes against a search, and both at sizes that a quadratic way would not survive."""

import random
import time

import numpy as np

from palisade.operators import config as K
from palisade.operators.blocks import matched

FILES = "file_id string, host string, path string, snapshot_id string, text string"


def by_stack(text):
    stack, out = [], []
    for i, ch in enumerate(text):
        if ch == "{":
            stack.append(i)
        elif ch == "}" and stack:
            out.append((stack.pop(), i))
    return sorted(out)


def test_braces_equal_a_stack():
    rng = random.Random(1)
    for _ in range(300):
        texts = ["".join(rng.choice("{}{}a") for _ in range(rng.randrange(25))) for _ in range(rng.randrange(1, 6))]
        at = [(f, i, ch) for f, t in enumerate(texts) for i, ch in enumerate(t) if ch in "{}"]
        opened, closed = matched(np.array([k for k, _ in enumerate(at)], np.int64), np.array([c == "{" for *_, c in at], bool),
                                 np.array([f for f, *_ in at], np.int64))
        got = [[] for _ in texts]
        for o, c in zip(opened.tolist(), closed.tolist(), strict=True):
            assert at[o][0] == at[c][0]
            got[at[o][0]].append((at[o][1], at[c][1]))
        assert got == [by_stack(t) for t in texts]


def parsed(spark, texts):
    return K.parse_files(spark.createDataFrame([(f"f{k}", "h", f"/p{k}", "s", t) for k, t in enumerate(texts)], FILES))


def test_blocks_of_odd_files(spark):
    texts = [None, "", "}", "server {", "é{\nserver {\n  listen 1;\n  location ~* \\.Ä$ {\n return 404;\n }\n}\n", "location /a { } } location = /b {x}"]
    rows = parsed(spark, texts).orderBy("file_id").collect()
    assert [len(r.locs) for r in rows] == [0, 0, 0, 0, 1, 2] and [r.unbalanced for r in rows] == [False, False, True, True, True, True]
    loc, server = rows[4].locs[0], rows[4].servers[0]
    assert (loc.expr, loc.modifier, loc.path, loc.body, loc.line, server.line) == ("~* \\.Ä$", "~*", "\\.Ä$", "return 404;", 4, 2)
    assert [(b.modifier, b.path, b.body) for b in rows[5].locs] == [("", "/a", ""), ("=", "/b", "x")]


def test_five_megabytes_take_linear_time(spark):
    def seconds(n):
        text = "server {\n" + "".join(f"  location /p{k} {{\n    return 404; # {'x' * 20}\n  }}\n" for k in range(n)) + "}\n"
        started = time.time()
        row = parsed(spark, [text]).selectExpr("size(locs) AS n", "locs[size(locs) - 1].line AS line", "length(text) AS chars").first()
        assert (row.n, row.line) == (n, 2 + 3 * (n - 1))
        return time.time() - started, row.chars

    seconds(10)
    (small, _), (large, chars) = seconds(8_000), seconds(80_000)
    assert chars > 5_000_000 and large < 20 * max(small, 0.5)


def edges_of(spark, pairs):
    return spark.createDataFrame([("h", "s", f"f{a}", f"f{b}") for a, b in pairs], "host string, snapshot_id string, includer string, included string")


def on_cycles(pairs):
    nxt = {}
    for a, b in pairs:
        nxt.setdefault(a, set()).add(b)
    out = set()
    for start in nxt:
        seen, todo = set(), list(nxt[start])
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += nxt.get(v, ())
        if start in seen:
            out.add(f"f{start}")
    return out


def test_cycles_equal_a_search(spark):
    rng = random.Random(7)
    graphs = [[(rng.randrange(n), rng.randrange(n)) for _ in range(m)] for n, m in ((6, 5), (9, 12), (30, 28), (40, 60))]
    graphs.append([(k, k + 1) for k in range(10)] + [(4, 2), (10, 11), (11, 12), (12, 10), (3, 20), (21, 3), (6, 6)])
    for pairs in graphs:
        assert {r.file for r in K.cycle_files(edges_of(spark, pairs)).collect()} == on_cycles(pairs)
    assert K.cycle_files(edges_of(spark, [(0, 1)])).collect() == []


def test_a_long_chain_and_a_long_ring(spark):
    chain = [(k, k + 1) for k in range(10_000)] + [(k, 50_000 + k) for k in range(0, 10_000, 997)]
    ring = [(20_000 + k, 20_000 + (k + 1) % 3_000) for k in range(3_000)] + [(10_000, 20_005), (20_007, 60_000)]
    found = {r.file for r in K.cycle_files(edges_of(spark, chain + ring)).collect()}
    assert found == {f"f{20_000 + k}" for k in range(3_000)}


def test_includes_do_not_build_pairs(spark, monkeypatch):
    files = [(f"/etc/nginx/a{k}.conf", f"include a{k + 1}.conf;" if k < 200 else "") for k in range(201)]
    files += [(f"/etc/nginx/z{k}.conf", f"include z{(k + 1) % 3}.conf;") for k in range(3)]
    df = spark.createDataFrame([(p, "h", p, "s", t) for p, t in files], FILES)
    monkeypatch.setattr(K, "_closure", None)
    assert {r.path for r in K.compat_includes(df).where("status = 'fail'").collect()} == {f"/etc/nginx/z{k}.conf" for k in range(3)}
