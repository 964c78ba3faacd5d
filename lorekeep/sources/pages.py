"""Reading fetched pages, sitemaps and source settings as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import js_trim
from lorekeep.functions.urls import normalize_url
from lorekeep.session import durable
from lorekeep.settings import MAX_PAGE_BYTES, MAX_SITEMAP_DEPTH


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def is_fetched_page(status: Column, content_type: Column, html: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    html_like = (kind == "") | kind.contains("text/html") | kind.contains("application/xhtml+xml")
    small = F.octet_length(html) <= MAX_PAGE_BYTES
    return F.coalesce(status.between(200, 299) & html_like & small, F.lit(False))


def fetch_gate(pages: DataFrame) -> DataFrame:
    """Keep rows that were fetched as an HTML page of an acceptable size; the rest count as skipped."""
    return pages.filter(is_fetched_page(F.col("status"), F.col("content_type"), F.col("html")))


def sitemap_entries(xml_table: DataFrame) -> DataFrame:
    """(url, xml) -> one row per distinct entry: sitemap, loc, position, is_index."""
    raw = F.regexp_extract_all("xml", F.lit(r"(?i)<loc>([\s\S]*?)</loc>"), F.lit(1))
    entities = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))

    def decode(value: Column) -> Column:
        value = js_trim(value)
        for name, character in entities:
            value = F.replace(value, F.lit(name), F.lit(character))
        return value

    return (
        xml_table.select(
            F.col("url").alias("sitemap"),
            F.col("xml").rlike(r"(?i)<sitemapindex[\s>]").alias("is_index"),
            F.posexplode(F.transform(raw, decode)).alias("position", "value"),
        )
        .withColumn("loc", normalize_url("value"))
        .filter(F.col("loc").isNotNull())
        .groupBy("sitemap", "loc", "is_index")
        .agg(F.min("position").alias("position"))
    )


def sitemap_expand(roots: DataFrame, xml_table: DataFrame, max_depth: int = MAX_SITEMAP_DEPTH) -> DataFrame:
    """Page addresses reached from ``roots(url)`` through nested indexes: url, first_depth.

    Entries are parsed once and written down; each round joins the frontier with them and leaves out sitemaps that
    were opened before. A sitemap that has no row in ``xml_table`` adds nothing.
    """
    named = xml_table.withColumn("url", normalize_url("url")).filter(F.col("url").isNotNull())
    entries = durable(sitemap_entries(named))
    frontier = roots.select(normalize_url("url").alias("sitemap")).filter(F.col("sitemap").isNotNull()).distinct()
    visited = frontier.limit(0)
    pages = None
    for depth in range(max_depth + 1):
        opened = frontier.join(visited, "sitemap", "left_anti")
        found = durable(opened.join(entries, "sitemap").select("sitemap", "loc", "is_index"))
        visited = visited.unionByName(opened)
        batch = found.filter(~F.col("is_index")).select(F.col("loc").alias("url"), F.lit(depth).alias("depth"))
        pages = batch if pages is None else pages.unionByName(batch)
        frontier = found.filter("is_index").select(F.col("loc").alias("sitemap")).distinct()
    return pages.groupBy("url").agg(F.min("depth").alias("first_depth"))


def source_errors(config: DataFrame, known_types: tuple[str, ...] = ("website",)) -> DataFrame:
    """(id, error) for every setting that would stop a run."""
    enabled = F.coalesce(F.col("enabled"), F.lit(True))
    unknown = config.filter(enabled & ~F.coalesce(F.col("type").isin(*known_types), F.lit(False))).select(
        "id", F.lit("unknown type").alias("error")
    )
    repeated = config.groupBy("id").count().filter("count > 1").select("id", F.lit("duplicate id").alias("error"))
    seeds = F.coalesce(F.size("start_urls"), F.lit(0)) + F.coalesce(F.size("sitemaps"), F.lit(0))
    seedless = config.filter(seeds <= 0).select("id", F.lit("no seeds").alias("error"))
    return unknown.unionByName(repeated).unionByName(seedless)


def select_sources(config: DataFrame, source_id: str | None = None, check: bool = True) -> DataFrame:
    """Enabled sources, optionally one of them. Raises on settings that would stop a run."""
    if check:
        first = source_errors(config).first()
        if first is not None:
            raise ValueError(f"content source {first['id']}: {first['error']}")
    chosen = config.filter(F.coalesce(F.col("enabled"), F.lit(True)))
    return chosen if source_id is None else chosen.filter(F.col("id") == source_id)


def preview(docs: DataFrame, order: str, limit: int = 10) -> DataFrame:
    """First documents of each source with a short excerpt. The per-source limit runs before the shuffle."""
    window = Window.partitionBy("source_id").orderBy(order)
    return (
        docs.select(
            "source_id",
            order,
            "id",
            F.upper("content_type").alias("content_type"),
            "title",
            F.coalesce("url", "reference").alias("url"),
            F.substring("content_hash", 1, 20).alias("hash"),
            F.length("text").alias("chars"),
            F.concat(F.substring("text", 1, 300), F.lit("…")).alias("excerpt"),
        )
        .withColumn("shown", F.row_number().over(window))
        .filter(F.col("shown") <= limit)
    )
