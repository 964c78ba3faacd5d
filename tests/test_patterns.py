"""Rule indexes against Python's regular expressions."""

import random
import re

from pyspark.sql import functions as F

from lorekeep.functions.patterns import any_found, expressions, last_at_most, longest_rule
from lorekeep.operators.crawl import robots_decide, rule_list


def expected(rules, path):
    """(size, allow) of the longest rule, read as a regular expression."""
    found = []
    for pattern, allow in rules:
        body, anchored = (pattern[:-1], "$") if pattern.endswith("$") else (pattern, "")
        if re.match("^" + ".*".join(map(re.escape, body.split("*"))) + ("\\Z" if anchored else ""), path, re.S):
            found.append((len(pattern), allow))
    return max(found, default=None)


def test_longest_rule_matches_regular_expressions(spark):
    rng = random.Random(5)

    def text(letters, least, most):
        return "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))

    rules = [(f"o{o}", "/" + text("ab/", 0, 5) if rng.random() < 0.5 else text("a/b*é", 1, 6) + rng.choice(["", "$", "*$"]), rng.random() < 0.5) for o in range(12) for _ in range(25)]
    rules += [("o1", "*", False), ("o1", "$", True), ("o2", "/a.b", False), ("only", "/a", False), ("only", "/a", True), ("stars", "/*b$", False)]
    paths = [(i, rng.choice([f"o{rng.randrange(12)}", "only", "stars", "none"]), "/" + text("ab/é", 0, 8)) for i in range(1500)]
    paths += [(2000, "o1", ""), (2001, "o2", "/axb"), (2002, "o2", "/a.b"), (2003, None, "/a")]
    index = rule_list(spark.createDataFrame(rules, "origin string, pattern string, allow boolean"))
    table = spark.createDataFrame(paths, "id int, origin string, path string")
    best = table.join(index, "origin", "left").select("id", longest_rule(F.col("rules"), F.col("path")).alias("best"))
    of = {o: [(p, a) for origin, p, a in rules if origin == o] for _, o, _ in paths}
    want = {i: expected(of[o], p) for i, o, p in paths}
    assert {r["id"]: tuple(r["best"]) if r["best"] else None for r in best.collect()} == want
    decided = robots_decide(table, spark.createDataFrame(rules, "origin string, pattern string, allow boolean"))
    assert {r["id"]: r["allowed"] for r in decided.collect()} == {i: True if w is None else w[1] for i, w in want.items()}


def test_last_at_most_halves_any_length(spark):
    rows = [(n, v) for n in range(0, 20) for v in range(-1, 2 * n + 2)]
    table = spark.createDataFrame(rows, "n int, v int")
    ordered = F.transform(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>")), lambda x: 2 * x)
    got = table.select("n", "v", last_at_most(ordered, F.col("v")).alias("at")).collect()
    assert all(r["at"] == sum(2 * x <= r["v"] for x in range(r["n"])) for r in got)


def test_configured_patterns_are_constants_of_the_plan(spark, monkeypatch):
    rows = [(1, "https://a.example/fr/x.html", ["/fr/", r"\.pdf$"]), (2, "https://a.example/x.html", [r"\.html$"]), (3, "https://a.example/xhtml", [r"\.html$", ".html?"]), (4, "x", []), (5, "y", None)]
    table = spark.createDataFrame(rows, "id int, url string, patterns array<string>")
    known = expressions(table.select("patterns"))
    assert known == sorted([r"\.pdf$", r"\.html$", ".html?"])
    want = {1: True, 2: True, 3: True, 4: False}
    for each in (known, None):
        got = {r["id"]: r["found"] for r in table.select("id", any_found(F.col("url"), F.col("patterns"), each).alias("found")).collect()}
        assert {k: v for k, v in got.items() if k != 5} == want and not got[5]
    monkeypatch.setattr("lorekeep.functions.patterns.MOST_EXPRESSIONS", 2)
    assert expressions(table.select("patterns")) is None
