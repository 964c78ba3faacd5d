"""Allow and block rules for URLs, matched by a sweep over sorted keys.

A rule names a host and a path prefix. It fits the host itself and every subdomain, for paths that start with its
prefix; the longest fitting rule wins. With the labels of a host in reverse order and a separator before the path, the
URLs that a rule fits through one given host are those whose key lies in one interval: the keys that start with the
rule's key. Such intervals are nested or apart. So each URL is given one key per host that it lies under
(``a.example.org``: ``org``, ``org.example``, ``org.example.a``), rules and keys are range-sorted together, and a sweep
carries the stack of rules that are open at each place; the topmost that is still open at a key is that key's longest.

Rows are dealt out by ranges of (key, row), so even one key that holds most rows is cut into many ranges. What is open
at the start of a range comes from a table with one row per range. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import lower_ascii, stored

#: Lower than every character of a host, so a host's own paths come before its subdomains.
GAP = "\x01"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or if null."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://`` or if null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_table(rules: DataFrame) -> DataFrame:
    """(host, path, verdict) -> one row per rule key, with the stack of rules open there, outermost first.

    Rules with a null part are left out. Of rules with the same host and path, the one with the smallest verdict stays.
    """
    clean = (
        rules.select(lower_ascii("host").alias("host"), "path", "verdict")
        .na.drop()
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
        .withColumn("rule_key", F.concat(host_key(F.col("host")), F.lit(GAP), "path"))
    )
    rule = F.struct("rule_key", F.concat("host", "path").alias("rule"), "verdict")
    one = clean.select("rule_key", "host", "path", rule.alias("open"))
    starts = one.select("host", "rule_key", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substr("path", F.lit(1), n))).alias("path"))
    outer = one.select("host", "path", "open")
    return starts.join(outer, ["host", "path"]).groupBy("rule_key").agg(F.sort_array(F.collect_list("open")).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Rows (id, url) -> id, host, path, rule (null if none fits), verdict (``default`` if none fits).

    The length of a rule is that of its host and path together; of equally long ones the longer host wins. A null url or
    one without ``://`` has an empty host and path and no rule. Repeated rows give repeated results; null ids are kept;
    other columns are left out; an empty table gives no rows.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = F.reverse(F.split("host", r"\."))
    # no rule has more labels than the longest rule host, so deeper keys of a URL would find none
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    levels = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda n: F.array_join(F.slice(labels, 1, n), "."))
    stack_type = "array<struct<rule_key:string,rule:string,verdict:string>>"
    keys = urls.select("_id", "host", "path", F.posexplode(levels).alias("_level", "_host")).select(
        F.concat("_host", F.lit(GAP), "path").alias("key"), F.lit(1).alias("kind"), "_id", "host", "path", "_level",
        F.lit(None).cast(stack_type).alias("stack"),
    )
    opened = rule_table(rules).select(
        F.col("rule_key").alias("key"), F.lit(0).alias("kind"), F.lit(None).cast(pages.schema[id_col].dataType).alias("_id"),
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("_level"), "stack",
    )
    dealt = keys.unionByName(opened).repartitionByRange(ranges, "key", "kind", F.xxhash64("_id", "host")).withColumn("range", F.spark_partition_id())
    swept = stored(dealt, "url-sweep")  # both readers below must see the same ranges
    order = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = swept.withColumn("inside", F.last("stack", ignorenulls=True).over(order))
    ends = swept.filter("kind = 0").groupBy("range").agg(F.max_by("stack", "key").alias("stack"))
    carried = (
        spark.range(ranges).select(F.col("id").cast("int").alias("range"))
        .join(ends, "range", "left")
        .select("range", F.last("stack", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    )
    return _longest(inside.filter("kind = 1").join(F.broadcast(carried), "range", "left"), id_col, default)


def _longest(swept: DataFrame, id_col: str, default: str) -> DataFrame:
    at = F.coalesce("inside", "carried")
    still = F.filter(at, lambda r: F.startswith(F.col("key"), r["rule_key"]))
    found = swept.withColumn("top", F.try_element_at(still, F.lit(-1)))
    best = found.groupBy("_id", "host", "path").agg(
        F.max(F.when(F.col("top").isNotNull(), F.struct(F.length("top.rule").alias("n"), F.instr("top.rule_key", GAP).alias("host_end"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict")))).alias("best"),
        F.sum((F.col("_level") == 0).cast("int")).alias("copies"),
    )
    return best.select(
        F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
