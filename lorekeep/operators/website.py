"""From crawled pages to documents: links, drafts, one document per text, and what became of every address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.urls import normalize_url
from lorekeep.operators.crawl import crawl_dedupe
from lorekeep.operators.documents import create_document, extract_pages, indexable, skip_reason, to_drafts
from lorekeep.session import durable
from lorekeep.settings import CrawlSettings
from lorekeep.sources.pages import fetch_gate


def read_pages(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html, status, content_type) -> page_id, url and the parsed fields of what was fetched as a page.

    Of several rows of one address the smallest page_id counts, as a crawl fetches an address once. Pages are parsed once
    and written down; links and documents both read that table.
    """
    fetched = fetch_gate(pages).filter(F.col("url").isNotNull())
    once = fetched.groupBy("url").agg(F.min("page_id").alias("page_id"))
    return durable(extract_pages(fetched.join(once.select("page_id"), "page_id", "left_semi").select("page_id", "url", "html"), ["page_id", "url"]))


def page_links(parsed: DataFrame) -> DataFrame:
    """(page_url, position, href): the links of each page in their order, resolved and normalised."""
    found = parsed.select("url", F.posexplode("links").alias("position", "raw"))
    return found.select(F.col("url").alias("page_url"), "position", normalize_url(F.col("raw"), F.col("url")).alias("href")).filter(F.col("href").isNotNull())


def site_documents(
    visited: DataFrame, parsed: DataFrame, site_id: str, rules: list[tuple[str, str]], max_characters: int = CrawlSettings.max_document_characters
) -> tuple[DataFrame, DataFrame]:
    """(documents, outcomes) of the addresses ``visited`` (source_id, url, crawl_seq).

    ``documents`` has one row per source and text, the first in crawl order. ``outcomes`` has one row per address, with
    source_id, url, crawl_seq, outcome and reason as ``crawl_stats`` counts them.
    """
    read = visited.select("source_id", "url", "crawl_seq").join(parsed.drop("links", "page_id"), "url")
    made, _ = create_document(to_drafts(indexable(read), site_id, max_characters, rules))
    kept = crawl_dedupe(made)
    looked = read.select("source_id", "crawl_seq", F.lit(True).alias("read"), skip_reason(F.col("noindex"), F.col("text")).alias("skipped"))
    first = made.groupBy("source_id", "content_hash").agg(F.min("crawl_seq").alias("first"))
    told = made.select("source_id", "content_hash", "crawl_seq").join(first, ["source_id", "content_hash"]).select("source_id", "crawl_seq", "first")
    reason = (
        F.when(F.col("read").isNull(), F.lit("not fetched as a page"))
        .when(F.col("skipped").isNotNull(), F.col("skipped"))
        .when(F.col("first") < F.col("crawl_seq"), F.lit("duplicate content"))
    )
    outcomes = (
        visited.select("source_id", "url", "crawl_seq")
        .join(looked, ["source_id", "crawl_seq"], "left")
        .join(told, ["source_id", "crawl_seq"], "left")
        .withColumn("reason", reason)
        .withColumn("outcome", F.when(F.col("reason").isNotNull(), "skipped").when(F.col("first").isNull(), "failed").otherwise("emitted"))
        .select("source_id", "url", "crawl_seq", "outcome", "reason")
    )
    return kept, outcomes
