"""Path rules as an index: literal starts by binary search, starred rules piece by piece, expressions compiled once.

A regular expression that comes from a column is compiled for every row. Nothing here does that: robots rules need no
regular expression at all, and those of a configuration become constants of the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that make a configured pattern more than a piece of text.
SPECIAL = r"[.*+?^${}()|\[\]\\]"
#: Distinct expressions that one plan holds as constants.
MOST_EXPRESSIONS = 1000


def last_at_most(ordered: Column, value: Column) -> Column:
    """Place (from 1; 0: none) of the last element of a sorted array that is not above ``value``, by halving."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"] + 1, 1)
        below = F.get(ordered, middle - 1) <= value
        return F.when(s["low"] >= s["high"], s).when(below, _span(middle, s["high"])).otherwise(_span(s["low"], middle - 1))

    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size(ordered))))
    return F.aggregate(halvings, _span(F.lit(0), F.size(ordered)), halve)["low"]


def _span(low: Column, high: Column) -> Column:
    return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))


def starred(pattern: Column) -> Column:
    """Whether a robots pattern is more than a literal start."""
    return F.contains(pattern, F.lit("*")) | F.endswith(pattern, F.lit("$"))


def pieces_of(pattern: Column) -> Column:
    """A robots pattern cut at its stars: what a path starts with, what follows in order, what an anchored one ends with."""
    anchored = F.endswith(pattern, F.lit("$"))
    body = F.when(anchored, pattern.substr(F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    pieces = F.split(body, r"\*")
    tail = F.size(pieces) - F.when(anchored, 2).otherwise(1)
    return F.struct(
        F.get(pieces, F.lit(0)).alias("start"),
        F.filter(F.slice(pieces, 2, F.greatest(tail, F.lit(0))), lambda p: p != "").alias("inner"),
        F.when(anchored, F.element_at(pieces, -1)).alias("end"),
        (F.size(pieces) == 1).alias("single"),
    )


def fits(path: Column, rule: Column) -> Column:
    """Whether a path has the pieces of a rule in their order. The leftmost place of each piece is always good enough."""

    def behind(at: Column, piece: Column) -> Column:
        found = F.position(piece, path, at)
        return F.when((at == 0) | (found == 0), F.lit(0)).otherwise(found + F.length(piece))

    after = F.aggregate(rule["inner"], F.length(rule["start"]) + 1, behind)
    ended = F.when(rule["single"], path == rule["start"]).otherwise(
        F.endswith(path, rule["end"]) & (F.length(path) - F.length(rule["end"]) + 1 >= after)
    )
    return F.startswith(path, rule["start"]) & (after > 0) & (rule["end"].isNull() | ended)


def rule_index(rules: DataFrame, key: str) -> DataFrame:
    """(key, pattern, allow) -> (key, rules): the rules of a key as an index that ``longest_rule`` reads.

    ``starts`` are the literal rules in order; ``nested`` has for each the literal rules that it starts with, longest
    first. Every literal that a path starts with lies at or before the path in order, and so is among those of the last
    start that does. ``starred`` rules come with their pieces.
    """
    size = F.length("pattern").alias("size")
    literal = rules.filter(~starred(F.col("pattern"))).groupBy(key, "pattern").agg(F.max("allow").alias("allow"))
    shorter = literal.select(F.col(key).alias("_key"), F.col("pattern").alias("start"), size, "allow")
    cuts = F.explode(F.sequence(F.lit(1), F.length("pattern"))).alias("_cut")
    begun = literal.filter("pattern <> ''").select(key, "pattern", cuts).select(key, "pattern", F.col("pattern").substr(F.lit(1), F.col("_cut")).alias("_start"))
    nested = (
        begun.join(shorter, (F.col(key) == F.col("_key")) & (F.col("_start") == F.col("start")))
        .groupBy(key, "pattern")
        .agg(F.sort_array(F.collect_list(F.struct("size", "allow", "start")), asc=False).alias("nested"))
    )
    starts = nested.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pattern", "nested"))).alias("starts"))
    pieces = rules.filter(starred(F.col("pattern"))).select(key, F.struct(size, "allow", pieces_of(F.col("pattern")).alias("pieces")).alias("rule"))
    index = starts.join(pieces.groupBy(key).agg(F.collect_list("rule").alias("starred")), key, "full")
    return index.select(
        key,
        F.struct(
            F.coalesce(F.col("starts.pattern"), F.array().cast("array<string>")).alias("starts"),
            F.col("starts.nested").alias("nested"),
            F.col("starred"),
        ).alias("rules"),
    )


def longest_rule(rules: Column, path: Column) -> Column:
    """(size, allow) of the longest rule that fits a path; an allowing rule wins ties. NULL if none fits."""
    at = last_at_most(rules["starts"], path)
    begun = F.filter(F.get(rules["nested"], at - 1), lambda r: F.startswith(path, r["start"]))
    begun = F.transform(begun, lambda r: F.struct(r["size"], r["allow"]))
    pieced = F.transform(F.filter(rules["starred"], lambda r: fits(path, r["pieces"])), lambda r: F.struct(r["size"], r["allow"]))
    # a null list has no maximum, and the greater of a null and a value is the value
    return F.greatest(F.get(begun, F.lit(0)), F.array_max(pieced))


def expressions(*lists: DataFrame) -> list[str] | None:
    """The distinct patterns of one-column tables of arrays that are more than text, for ``any_found``.

    None if they are too many for one plan; they are then compiled row by row.
    """
    every = reduce(DataFrame.union, [t.select(F.explode(t.columns[0]).alias("pattern")) for t in lists])
    rows = every.filter(F.col("pattern").rlike(SPECIAL)).distinct().limit(MOST_EXPRESSIONS + 1).collect()
    return sorted(r["pattern"] for r in rows) if len(rows) <= MOST_EXPRESSIONS else None


def any_found(text: Column, patterns: Column, known: list[str] | None) -> Column:
    """Whether any of a row's patterns is found in ``text``; ``known`` has all that are more than text."""
    if known is None:
        return F.exists(patterns, lambda p: F.regexp_like(text, p))
    plain = F.exists(patterns, lambda p: ~p.rlike(SPECIAL) & F.contains(text, p))
    return reduce(Column.__or__, [F.array_contains(patterns, p) & text.rlike(p) for p in known], plain)
