"""Regexes as data: the JVM's reading against the standard library, and joins without all pairs."""

import random
import re
import warnings

import pytest

from palisade.operators.matching import regex_join
from palisade.operators.patterns import read_regex

ATOMS = ["a", "b", "B", "1", "/", r"\.", ".", "[ab]", "[^a]", r"\d", r"\w", r"\s", r"\b", "^", "$", "é", "ſ", "K", "[a-c1]", r"\B",
         r"\Z", "(?i:a)", "x{,2}", "{", "(?=a)", "(?<!b)", "[[a]", "[a&&b]", r"\W"]


def some_regex(rng, depth):
    r = rng.random()
    inner = lambda: some_regex(rng, depth - 1)
    if not depth or r < .4:
        return rng.choice(ATOMS)
    if r < .6:
        return inner() + inner()
    if r < .7:
        return f"({inner()}|{inner()})"
    if r < .8:
        return f"(?:{inner()}){rng.choice(['*', '+', '?', '{2}', '{1,2}', '*?'])}"
    if r < .85:
        return rf"(?:({inner()})\1)"
    if r < .9:
        return rng.choice(["(?s)", "(?m)", "(?i)", "(?a)"]) + inner()
    return inner() + inner() + inner()


def found(texts, patterns):
    out = set()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for p, c in patterns:
            try:
                rx = re.compile(p, re.IGNORECASE if c else 0)
            except re.error:
                continue
            out |= {(t, p, c) for t in texts if rx.search(t)}
    return out


def joined(spark, texts, patterns):
    rows = regex_join(spark.createDataFrame([(t,) for t in texts], "t string"), "t",
                      spark.createDataFrame(patterns, "p string, c boolean"), "p", "c").collect()
    assert len(set(rows)) == len(rows)
    return {tuple(r) for r in rows}


def test_join_equals_the_standard_library(spark):
    rng = random.Random(3)
    patterns = list({(some_regex(rng, 4), rng.random() < .5) for _ in range(600)})
    patterns += [("(a)?(?(1)b|c)", False), ("(", False), ("", True), ("(?P<x>a)(?P=x)", True), ("a{3000000000}", False)]
    texts = list({"".join(rng.choice("abB1/. \nAéſKİıxs\x1c{[&") for _ in range(rng.randrange(9))) for _ in range(120)})
    assert joined(spark, texts, patterns) == found(texts, patterns)


def test_no_row_on_either_side(spark):
    assert joined(spark, [], [("a", False)]) == set() == joined(spark, ["a"], [])
    assert joined(spark, ["a"], [("[", False)]) == set()


@pytest.mark.parametrize(("pattern", "ignore_case", "literals"), [
    (r"\.(php|asp)x?$", False, [".asp", ".aspx", ".php", ".phpx"]), (r"^/wp-(Admin|login)", True, ["/wp-admin", "/wp-login"]),
    (r"/a+b", False, ["/"]), (r"(?:secret|token)+=\w", False, ["secret", "token"]), (r"\d+", False, [""]), (r"x*", False, [""]),
    (r"a|", False, [""]), (r"[ab]c(?=d)", False, ["ac", "bc"]), (r"é/x", False, ["/x"]),
])
def test_literals(pattern, ignore_case, literals):
    assert read_regex(pattern, ignore_case)[1] == literals


def test_five_thousand_regexes_meet_only_texts_that_may_match(spark):
    patterns = [(rf"^/app{k}/[a-z]+\.(php|jsp)$", k % 2 == 0) for k in range(5000)]
    texts = [f"/app{k}/Index.php" if k % 3 else f"/app{k}/index.jsp" for k in range(0, 9000, 3)] + [f"/app{k}/x.PHP" for k in range(500)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    hits = regex_join(frame, "t", spark.createDataFrame(patterns, "p string, c boolean"), "p", "c")
    assert hits.count() == len([1 for t in set(texts) for k in [int(t[4:t.index("/", 4)])] if k < 5000
                                and re.search(patterns[k][0], t, re.IGNORECASE if patterns[k][1] else 0)])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
