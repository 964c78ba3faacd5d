"""The crawl frontier as joins: hosts, filters, robots rules and breadth-first expansion over a pages table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.patterns import any_found, expressions, longest_rule, rule_index
from lorekeep.functions.text import js_trim
from lorekeep.functions.urls import normalize_url, url_host, url_origin, url_path
from lorekeep.scale import position
from lorekeep.session import durable

AGENT = "lorekeepbot/1.0"


def allowed_hosts(sources: DataFrame) -> DataFrame:
    """Adds ``hosts``: the explicit list in lower case, else the distinct hosts of all seeds."""
    seeds = F.concat(F.coalesce("start_urls", F.array().cast("array<string>")), F.coalesce("sitemaps", F.array().cast("array<string>")))
    derived = F.array_distinct(
        F.filter(F.transform(seeds, lambda u: url_host(normalize_url(u))), lambda h: h.isNotNull())
    )
    explicit = F.transform("allowed_hosts", lambda h: F.lower(h))
    return sources.withColumn("hosts", F.when(F.size("allowed_hosts") > 0, explicit).otherwise(derived))


def configured(sources: DataFrame) -> list[str] | None:
    """The regular expressions that ``crawlable`` needs for these sources."""
    return expressions(sources.select("include"), sources.select("exclude"))


def crawlable(url: Column, hosts: Column, include: Column, exclude: Column, known: list[str] | None) -> Column:
    host = url_host(url)
    host_ok = F.exists(hosts, lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))
    excluded = any_found(url, exclude, known)
    included = (F.size(include) == 0) | any_found(url, include, known)
    return F.coalesce(url.isNotNull() & host_ok & ~excluded & included, F.lit(False))


def url_filter(urls: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of ``urls(source_id, url, …)`` that their source may crawl. ``sources`` carries ``hosts``."""
    rules = sources.select(F.col("id").alias("source_id"), "hosts", "include", "exclude")
    return (
        urls.join(rules, "source_id")
        .filter(crawlable(F.col("url"), F.col("hosts"), F.col("include"), F.col("exclude"), configured(sources)))
        .drop("hosts", "include", "exclude")
    )


def robots_directives(files: DataFrame) -> DataFrame:
    """(origin, contents) -> origin, line, field, value."""
    line = js_trim(F.regexp_extract("raw", r"^([^#]*)", 1))
    return (
        files.select("origin", F.posexplode(F.split("contents", r"\r?\n")).alias("line", "raw"))
        .withColumn("text", line)
        .filter(F.col("text").contains(":"))
        .select(
            "origin",
            "line",
            F.lower(js_trim(F.regexp_extract("text", r"^([^:]*):", 1))).alias("field"),
            js_trim(F.regexp_extract("text", r"^[^:]*:([\s\S]*)$", 1)).alias("value"),
        )
    )


def robots_rules(files: DataFrame) -> DataFrame:
    """Directives with their group: a user-agent line opens a new group unless the line before it was one too.

    A robots file is one small row, so its lines form a small group. Sitemap lines belong to no group, but like any
    other line they end a run of user-agent lines once a group is open.
    """
    by_line = Window.partitionBy("origin").orderBy("line")
    agent = F.col("field") == "user-agent"
    opens = agent & ~F.coalesce(F.lag(agent).over(by_line), F.lit(False))
    return (
        robots_directives(files)
        .withColumn("opens", opens.cast("int"))
        .withColumn("group", F.sum("opens").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("opens")
    )


def robots_group(directives: DataFrame, agent: str = AGENT) -> DataFrame:
    """The rules that apply to ``agent`` per origin: origin, pattern, allow.

    The first group that names the agent by a prefix wins, else the first group for everybody; never a merge.
    """
    return _chosen(directives, agent).filter(
        F.col("field").isin("allow", "disallow") & (F.col("value") != "")
    ).select("origin", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow"))


def _chosen(directives: DataFrame, agent: str) -> DataFrame:
    name = F.lower("value")
    rank = F.when((name != "*") & F.startswith(F.lit(agent.lower()), name), 0).when(name == "*", 1)
    winners = (
        directives.filter((F.col("field") == "user-agent") & (F.col("group") > 0))
        .withColumn("rank", rank)
        .filter(F.col("rank").isNotNull())
        .groupBy("origin")
        .agg(F.min(F.struct("rank", "group")).alias("best"))
        .select("origin", F.col("best.group").alias("group"))
    )
    return directives.join(winners, ["origin", "group"], "left_semi")


def robots_origins(files: DataFrame, agent: str = AGENT) -> DataFrame:
    """Per origin: crawl_delay (last valid one of the group that applies) and the declared sitemaps."""
    directives = robots_rules(files)
    seconds = F.col("value").try_cast("double")
    seconds = F.when(F.col("value") == "", 0.0).otherwise(seconds)
    delays = (
        _chosen(directives, agent)
        .filter((F.col("field") == "crawl-delay") & (seconds >= 0) & (seconds < float("inf")))
        .groupBy("origin")
        .agg(F.max_by(seconds, "line").alias("crawl_delay"))
    )
    declared = (
        directives.filter((F.col("field") == "sitemap") & (F.col("value") != ""))
        .groupBy("origin")
        .agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("found"))
        .select("origin", F.array_distinct(F.col("found.value")).alias("sitemaps"))
    )
    return (
        files.select("origin")
        .join(delays, "origin", "left")
        .join(declared, "origin", "left")
        .withColumn("sitemaps", F.coalesce("sitemaps", F.array().cast("array<string>")))
    )


def rule_list(rules: DataFrame) -> DataFrame:
    """One row per origin with its rules as an index; a robots file bounds its length."""
    return rule_index(rules, "origin")


def allowed_by(rules: Column, path: Column) -> Column:
    """Longest matching pattern wins and Allow wins ties; nothing matching means allowed."""
    return F.coalesce(longest_rule(rules, path)["allow"], F.lit(True))


def robots_decide(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``allowed`` to ``urls(origin, path, …)``. One equi-join on origin, no row multiplication."""
    return (
        urls.join(rule_list(rules), "origin", "left")
        .withColumn("allowed", allowed_by(F.col("rules"), F.col("path")))
        .drop("rules")
    )


def robots_merge(paths: DataFrame, source_origins: DataFrame, rules: DataFrame, origins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules of every origin a source starts from, applied together.

    Returns (paths with ``allowed``, one row per source with ``crawl_delay`` and ``sitemaps``): a path must pass every
    origin, the slowest delay counts, and sitemaps are united.
    """
    per_source = (
        source_origins.join(rule_list(rules), "origin")
        .groupBy("source_id")
        .agg(F.collect_list("rules").alias("rule_sets"))
    )
    decided = (
        paths.join(per_source, "source_id", "left")
        .withColumn(
            "allowed",
            F.coalesce(F.forall("rule_sets", lambda r: allowed_by(r, F.col("path"))), F.lit(True)),
        )
        .drop("rule_sets")
    )
    declared = (
        source_origins.join(origins, "origin", "left")
        .groupBy("source_id")
        .agg(
            F.max("crawl_delay").alias("crawl_delay"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("sitemaps")))).alias("sitemaps"),
        )
    )
    return decided, declared


def effective_rate(configured: Column, delay: Column) -> Column:
    """The slower of the configured rate and what the site asks for."""
    return F.when(delay > 0, F.least(configured, 1 / delay)).otherwise(configured)


def fetch_schedule(urls: DataFrame, order: str, bucket: Column) -> DataFrame:
    """Start offset in ms per address: one slot per interval and source, no bursts. Needs ``rate`` per row.

    ``bucket`` grows with ``order`` and cuts a large source into pieces that are numbered separately.
    """
    slotted = position(urls, ["source_id"], bucket, order, "slot")
    return slotted.withColumn("start_ms", (F.col("slot") - 1) * (1000.0 / F.col("rate")))


def seed_frontier(sources: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """source_id, url, seq, depth: start addresses first and unfiltered, then crawlable sitemap addresses.

    ``sitemap_urls``: source_id, url, position. ``seq`` orders the seeds of a source; it grows but may have gaps.
    """
    starts = sources.select(
        F.col("id").alias("source_id"), F.posexplode("start_urls").alias("position", "raw")
    ).select("source_id", normalize_url("raw").alias("url"), F.lit(0).alias("tier"), F.col("position").cast("long").alias("position"))
    listed = url_filter(
        sitemap_urls.select("source_id", normalize_url("url").alias("url"), F.lit(1).alias("tier"), F.col("position").cast("long").alias("position")),
        sources,
    )
    return (
        starts.unionByName(listed)
        .filter(F.col("url").isNotNull())
        .groupBy("source_id", "url")
        .agg(F.min(F.struct("tier", "position")).alias("at"))
        .select("source_id", "url", F.col("at.tier").alias("tier"), F.col("at.position").alias("position"))
        .withColumn("depth", F.lit(0))
    )


def expand_frontier(seeds: DataFrame, links: DataFrame, sources: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Breadth-first visit order: source_id, url, depth, crawl_seq.

    ``links``: page_url, position, href (already resolved and normalised). ``sources`` carries hosts, include,
    exclude, max_depth and max_pages. ``rules`` (source_id, rule_sets) marks addresses that robots rules block: they
    are seen, cost nothing and lead nowhere. Each depth is one join, written down before the next one starts.
    """
    limits = sources.select(F.col("id").alias("source_id"), "max_depth", "max_pages", "hosts", "include", "exclude")
    known = configured(sources)
    deepest = sources.agg(F.max("max_depth")).first()[0] or 0
    frontier = seeds.select("source_id", "url", "depth", F.struct("tier", "position").alias("at"))
    frontier = frontier.select("source_id", "url", "depth", F.col("at.tier").cast("long").alias("parent"), F.col("at.position").cast("long").alias("position"))
    seen = frontier.select("source_id", "url")
    spent = None
    visited = None
    for depth in range(deepest + 1):
        if rules is not None:
            frontier = (
                frontier.join(rules, "source_id", "left")
                .filter(F.coalesce(F.forall("rule_sets", lambda r: allowed_by(r, url_path(F.col("url")))), F.lit(True)))
                .drop("rule_sets")
            )
        order = Window.partitionBy("source_id").orderBy("parent", "position", "url")
        budget = limits.select("source_id", "max_pages")
        if spent is not None:
            budget = budget.join(spent, "source_id", "left").select(
                "source_id", (F.col("max_pages") - F.coalesce("used", F.lit(0))).alias("max_pages"), "used"
            )
        else:
            budget = budget.withColumn("used", F.lit(0).cast("long"))
        most = sources.agg(F.max("max_pages")).first()[0]
        batch = durable(
            frontier.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= most)
            .join(budget, "source_id")
            .filter(F.col("rank") <= F.col("max_pages"))
            .select(
                "source_id",
                "url",
                F.lit(depth).alias("depth"),
                (F.coalesce("used", F.lit(0)) + F.col("rank")).alias("crawl_seq"),
            )
        )
        visited = batch if visited is None else visited.unionByName(batch)
        if depth == deepest:
            break
        spent = visited.groupBy("source_id").agg(F.count("*").alias("used"))
        found = (
            batch.join(links, batch["url"] == links["page_url"])
            .select("source_id", links["href"].alias("url"), F.col("crawl_seq").alias("parent"), links["position"].cast("long").alias("position"))
            .join(limits, "source_id")
            .filter(F.col("max_depth") > depth)
            .filter(crawlable(F.col("url"), F.col("hosts"), F.col("include"), F.col("exclude"), known))
            .groupBy("source_id", "url")
            .agg(F.min(F.struct("parent", "position")).alias("at"))
            .join(seen, ["source_id", "url"], "left_anti")
        )
        frontier = durable(
            found.select("source_id", "url", F.lit(depth + 1).alias("depth"), F.col("at.parent").alias("parent"), F.col("at.position").alias("position"))
        )
        seen = seen.unionByName(frontier.select("source_id", "url"))
    return visited


def crawl_dedupe(docs: DataFrame) -> DataFrame:
    """One document per (source, hash): the first in crawl order.

    The winners are found on three narrow columns with partial aggregation, so a text copied a million times costs no
    more than another; the full rows then join on the unique (source, crawl_seq).
    """
    firsts = docs.groupBy("source_id", "content_hash").agg(F.min("crawl_seq").alias("crawl_seq"))
    return docs.join(firsts.select("source_id", "crawl_seq"), ["source_id", "crawl_seq"], "left_semi")


SKIP_REASONS = ("robots-disallowed", "not fetched as a page", "noindex", "too little text", "duplicate content")


def crawl_stats(outcomes: DataFrame) -> DataFrame:
    """(source_id, outcome, reason) -> emitted, skipped, failed and one count per skip reason."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("emitted", "skipped", "failed")]
    reasons = [
        F.count_if((F.col("outcome") == "skipped") & (F.col("reason") == r)).alias("skipped_" + r.replace(" ", "_").replace("-", "_"))
        for r in SKIP_REASONS
    ]
    return outcomes.groupBy("source_id").agg(*counts, *reasons)


def source_rules(source_origins: DataFrame, rules: DataFrame) -> DataFrame:
    """(source_id, rule_sets) in the form that ``expand_frontier`` takes."""
    return (
        source_origins.join(rule_list(rules), "origin")
        .groupBy("source_id")
        .agg(F.collect_list("rules").alias("rule_sets"))
    )


def source_origins(sources: DataFrame) -> DataFrame:
    """(source_id, origin) for every origin a source starts from."""
    seeds = F.concat("start_urls", "sitemaps")
    return (
        sources.select(F.col("id").alias("source_id"), F.explode(seeds).alias("raw"))
        .select("source_id", url_origin(normalize_url("raw")).alias("origin"))
        .filter(F.col("origin").isNotNull())
        .distinct()
    )
