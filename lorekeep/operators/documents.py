"""Fetched pages -> parsed pages -> documents."""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.functions.html import parse_page
from lorekeep.functions.ids import content_hash, document_id
from lorekeep.functions.text import js_trim, normalize_line, normalize_text, truncate_text
from lorekeep.functions.urls import normalize_url, url_host
from lorekeep.scale import text_batches
from lorekeep.settings import CONTENT_TYPES, MIN_DOCUMENT_TEXT

PARSED = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("canonical", T.StringType()),
        T.StructField("locale", T.StringType()),
        T.StructField("noindex", T.BooleanType()),
        T.StructField("description", T.StringType()),
        T.StructField("links", T.ArrayType(T.StringType())),
    ]
)


def extract_pages(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Parse ``html``; the result carries the ``keep`` columns (all but html by default) and the parsed fields.

    Python takes the pages of a batch by bytes, so pages of several MB do not pile up in a worker.
    """
    kept = [c for c in pages.columns if c != "html"] if keep is None else keep
    schema = T.StructType([pages.schema[c] for c in kept] + PARSED.fields)

    fields = list(to_arrow_schema(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_batches(batches, "html"):
            parsed = [parse_page(html or "") for html in rows.column("html").to_pylist()]
            made = [pa.array([page[field.name] for page in parsed], field.type) for field in fields]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *made], names=schema.names)

    return pages.select(*kept, "html").mapInArrow(run, schema)


def indexable(pages: DataFrame) -> DataFrame:
    """Pages that ask to be indexed and have enough text. The sibling reasons come from ``skip_reason``."""
    return pages.filter(skip_reason(F.col("noindex"), F.col("text")).isNull())


def skip_reason(noindex: Column, text: Column) -> Column:
    short = F.length(js_trim(text)) < MIN_DOCUMENT_TEXT
    return F.when(noindex, F.lit("noindex")).when(short, F.lit("too little text"))


def resolve_canonical(canonical: Column, fetched: Column) -> Column:
    """The declared address if it stays on the fetched host, else the fetched one."""
    declared = normalize_url(canonical, fetched)
    return F.when(url_host(declared) == url_host(fetched), declared).otherwise(fetched)


def classify(url: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """Content type of the first rule (pattern, type) that the address matches. The patterns are constants of the plan."""
    result = F
    for pattern, content_type in rules:
        result = result.when(url.rlike(pattern), F.lit(content_type))
    return default if result is F else result.otherwise(default)


def build_metadata(**values: Column) -> Column:
    """A map of the values that are there; non-finite numbers are left out by ``scalar``."""
    pairs = [part for name, value in values.items() for part in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def scalar(number: Column) -> Column:
    """A number that a payload can hold, else NULL."""
    value = number.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), number)


def create_document(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) from drafts with site_id, source_id, source_type, reference, url, title, text,
    content_type, locale, retrieved_at, metadata."""
    ready = drafts.withColumns(
        {
            "text": normalize_text("text"),
            "title": normalize_line("title"),
            "site_id": F.coalesce("site_id", F.lit("")),
            "reference": F.coalesce("reference", F.lit("")),
        }
    ).withColumns(
        {
            "title": F.when(F.col("title") == "", F.col("reference")).otherwise(F.col("title")),
            "content_type": F.when(F.col("content_type").isin(*CONTENT_TYPES), F.col("content_type")).otherwise("page"),
            "metadata": F.coalesce(
                F.map_filter("metadata", lambda k, v: v.isNotNull()), F.create_map().cast("map<string,string>")
            ),
            "reason": F.when(js_trim(F.col("site_id")) == "", "no site")
            .when(js_trim(F.col("reference")) == "", "no reference")
            .when(F.col("text") == "", "no text"),
        }
    )
    documents = (
        ready.filter(F.col("reason").isNull())
        .drop("reason")
        .withColumn("id", document_id(F.col("site_id"), F.col("source_id"), F.col("reference")))
        .withColumn("content_hash", content_hash(F.col("title"), F.col("text")))
    )
    rejects = ready.filter(F.col("reason").isNotNull()).select("site_id", "source_id", "reference", "reason")
    return documents, rejects


def to_drafts(parsed: DataFrame, site_id: str, max_characters: int, rules: list[tuple[str, str]]) -> DataFrame:
    """Parsed pages (source_id, url, …) -> document drafts, before rejection. ``text`` is already cut."""
    location = resolve_canonical(F.col("canonical"), F.col("url"))
    return (
        parsed.withColumn("text", truncate_text(F.col("text"), max_characters))
        .withColumn("location", location)
        .select(
            *[c for c in parsed.columns if c not in PARSED.names and c not in ("url", "source_id")],
            F.lit(site_id).alias("site_id"),
            "source_id",
            F.lit("website").alias("source_type"),
            F.col("location").alias("reference"),
            F.col("location").alias("url"),
            "title",
            "text",
            classify(F.col("location"), rules, F.lit("page")).alias("content_type"),
            "locale",
            "noindex",
            build_metadata(
                description=F.col("description"),
                fetchedUrl=F.when(F.col("location") != F.col("url"), F.col("url")),
            ).alias("metadata"),
        )
    )
