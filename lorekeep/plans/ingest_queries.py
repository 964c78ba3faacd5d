"""Incremental ingestion over two versions of the documents table; a chunk here is one line of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators import ingestion
from lorekeep.plans.catalog import query, table
from lorekeep.plans.ingest import run_ingestion
from lorekeep.plans.search_queries import SETTINGS
from lorekeep.session import scratch
from lorekeep.settings import ChunkSettings
from lorekeep.sources import sinks, versions
from lorekeep.operators import evaluation
from lorekeep.plans import search_queries


def line_chunks(docs: DataFrame) -> DataFrame:
    line = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("index", "body"))
    return line.select(
        F.lit("main").alias("site_id"),
        F.col("source").alias("source_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("index").cast("string")).alias("id"),
        "index",
        "body",
        F.sha2("body", 256).alias("content_hash"),
    )


def new_documents(spark, d) -> DataFrame:
    """This run: src5 no longer has its English documents, src6 none of its others."""
    english = F.col("lang") == "en"
    gone = ((F.col("source") == "src5") & english) | ((F.col("source") == "src6") & ~english)
    return table(spark, d, "documents").filter(~gone)


def new_chunks(spark, d) -> DataFrame:
    return line_chunks(new_documents(spark, d))


def stored_chunks(spark, d) -> DataFrame:
    """The run before: src3 unknown, French pages one line longer, German ones worded differently."""
    old = table(spark, d, "documents").filter("source <> 'src3'").withColumn(
        "text",
        F.when(F.col("lang") == "fr", F.concat("text", F.lit("\nold line")))
        .when(F.col("lang") == "de", F.replace("text", F.lit("e"), F.lit("E")))
        .otherwise(F.col("text")),
    )
    return line_chunks(old)


VERSIONS = """
nw AS (SELECT source, doc_id, doc_id || '#' || i AS id, lines[i + 1] AS body FROM (SELECT source, doc_id, string_split(text, chr(10)) AS lines,
  unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE NOT (source = 'src5' AND lang = 'en' OR source = 'src6' AND lang <> 'en'))),
o AS (SELECT source, doc_id, CASE lang WHEN 'fr' THEN text || chr(10) || 'old line' WHEN 'de' THEN replace(text, 'e', 'E') ELSE text END AS text
  FROM documents WHERE source <> 'src3'),
st AS (SELECT source, doc_id, doc_id || '#' || i AS id, lines[i + 1] AS body FROM (SELECT source, doc_id, string_split(text, chr(10)) AS lines,
  unnest(range(len(string_split(text, chr(10))))) AS i FROM o))"""


@query("ing1_diff_chunks", f"WITH {VERSIONS} SELECT nw.id, st.body IS NULL OR st.body <> nw.body AS changed FROM nw LEFT JOIN st USING (id)")
def ing1(spark, d):
    return ingestion.diff_chunks(new_chunks(spark, d), stored_chunks(spark, d)).select("id", "changed")


@query("ing2_orphan_chunks", f"WITH {VERSIONS} SELECT id FROM st WHERE doc_id IN (SELECT doc_id FROM nw) AND id NOT IN (SELECT id FROM nw)")
def ing2(spark, d):
    return ingestion.orphan_chunks(new_chunks(spark, d), stored_chunks(spark, d)).select("id")


CHUNK_COUNTS = """c AS (SELECT nw.doc_id, nw.source, 1 AS total, (st.body IS NULL OR st.body <> nw.body)::INT AS embedded, 0 AS deleted FROM nw LEFT JOIN st USING (id)
  UNION ALL SELECT doc_id, source, 0, 0, 1 FROM st WHERE doc_id IN (SELECT doc_id FROM nw) AND id NOT IN (SELECT id FROM nw))"""


@query(
    "ing3_ingest_counts",
    f"""WITH {VERSIONS}, {CHUNK_COUNTS} SELECT CAST(doc_id AS VARCHAR) AS document_id, sum(total) AS chunks_total, sum(embedded) AS chunks_embedded,
        sum(total - embedded) AS chunks_skipped, sum(deleted) AS chunks_deleted FROM c GROUP BY doc_id""",
)
def ing3(spark, d):
    new, stored = new_chunks(spark, d), stored_chunks(spark, d)
    return ingestion.ingest_counts(ingestion.diff_chunks(new, stored), ingestion.orphan_chunks(new, stored), ["document_id"])


@query("ing4_embed_chunks")
def ing4(spark, d):
    """Built-in hashed vectors of every document at unit length."""
    rows = ingestion.embed_chunks(table(spark, d, "documents").select("doc_id", "text"), dims=64)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return rows.select("doc_id", F.size("embedding").alias("dims"), F.round(norm, 4).alias("norm"))


def word_counts(texts: list[str]) -> list[list[float]]:
    """A model stand-in: characters, spaces and full stops of a text."""
    return [[float(len(t)), float(t.count(" ")), float(t.count("."))] for t in texts]


@query(
    "ing4_embed_with_model",
    """SELECT doc_id, length(text)::DOUBLE AS a, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS b,
       (length(text) - length(replace(text, '.', '')))::DOUBLE AS c FROM documents""",
)
def ing4_model(spark, d):
    rows = ingestion.embed_chunks(table(spark, d, "documents").select("doc_id", "text"), word_counts, dims=3, strict=False)
    parts = [F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("abc")]
    return rows.select("doc_id", *parts)


@query("ing5_embed_query", "SELECT item_id, (length(text) + 7)::DOUBLE AS a FROM benchmark")
def ing5(spark, d):
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    rows = ingestion.embed_query(asked, "query: ", word_counts, 3, strict=False)
    return rows.select("item_id", F.get("embedding", F.lit(0)).cast("double").alias("a"))


@query(
    "ing6_to_points",
    """SELECT doc_id || '#0' AS id, CAST(doc_id AS VARCHAR) AS document_id, source AS source_id, 'main' AS site_id, 0 AS chunk_index,
       lang || ' > ' || source AS heading_path, md5(text) AS text, vec_id IS NOT NULL AS has_vector FROM documents JOIN embeddings ON vec_id = doc_id""",
)
def ing6(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.join(table(spark, d, "embeddings"), F.col("vec_id") == F.col("doc_id")).select(
        F.lit("main").alias("site_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("id"),
        "embedding",
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("source").alias("source_id"),
        F.lit("page").alias("content_type"),
        F.sha2("text", 256).alias("content_hash"),
        F.lit(0).alias("index"),
        F.lit("t").alias("title"),
        F.array("lang", "source").alias("heading_path"),
        F.col("text").alias("body"),
        F.lit(None).cast("string").alias("url"),
    )
    made = ingestion.to_points(rows, F.current_timestamp())
    return made.select(
        "id", "document_id", "source_id", "site_id", "chunk_index", "heading_path", F.md5("text").alias("text"), F.col("embedding").isNotNull().alias("has_vector")
    )


@query(
    "ing6_to_points_of_all",
    """SELECT doc_id || '#0' AS id, CAST(doc_id AS VARCHAR) AS document_id, source AS source_id, 'main' AS site_id, 0 AS chunk_index,
       lang || ' > ' || source AS heading_path, md5(text) AS text, 64 AS dims FROM documents""",
)
def ing6_of_all(spark, d):
    """Every document with the built-in vector of its own text."""
    rows = ingestion.embed_chunks(table(spark, d, "documents"), dims=64).select(
        F.lit("main").alias("site_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("id"),
        "embedding",
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("source").alias("source_id"),
        F.lit("page").alias("content_type"),
        F.sha2("text", 256).alias("content_hash"),
        F.lit(0).alias("index"),
        F.lit("t").alias("title"),
        F.array("lang", "source").alias("heading_path"),
        F.col("text").alias("body"),
        F.lit(None).cast("string").alias("url"),
    )
    made = ingestion.to_points(rows, F.current_timestamp())
    return made.select("id", "document_id", "source_id", "site_id", "chunk_index", "heading_path", F.md5("text").alias("text"), F.size("embedding").alias("dims"))


def failures(spark, d) -> DataFrame:
    """Toxic documents of src7 and src8 stand for failures."""
    bad = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").filter("toxic = 1 AND source IN ('src7', 'src8')")
    return ingestion.document_failures(bad.select(F.lit("main").alias("site_id"), F.col("source").alias("source_id")))


FAILED = "f AS (SELECT source, count(*) AS failures FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND source IN ('src7', 'src8') GROUP BY source)"
DECISION = f"""{VERSIONS}, {FAILED}, sd AS (SELECT source, doc_id, count(*) AS chunks FROM st GROUP BY ALL),
 cv AS (SELECT source, count(*) AS stored, count(*) FILTER (seen) AS seen, sum(chunks) FILTER (NOT seen) AS gone FROM
   (SELECT *, doc_id IN (SELECT doc_id FROM nw) AS seen FROM sd) GROUP BY source),
 dc AS (SELECT source, coalesce(stored, 0) AS stored, coalesce(seen, 0) AS seen, coalesce(failures, 0) AS failures,
   CASE WHEN coalesce(failures, 0) > 0 THEN 'failures' WHEN coalesce(stored, 0) > 0 AND seen / stored < 0.5 THEN 'low coverage' END AS reason, coalesce(gone, 0) AS gone
   FROM cv FULL JOIN f USING (source))"""


def plan(spark, d):
    stored = stored_chunks(spark, d).select("site_id", "source_id", "document_id", "id")
    seen = new_chunks(spark, d).select("site_id", "source_id", "document_id")
    return ingestion.prune_plan(stored, seen, failures(spark, d))


@query(
    "ing7_prune_plan",
    f"""WITH {DECISION} SELECT source AS source_id, stored AS stored_documents, seen AS seen_documents, failures, reason AS skipped_reason, reason IS NULL AS pruned,
        CASE WHEN reason IS NULL THEN stored - seen ELSE 0 END AS documents_removed, CASE WHEN reason IS NULL THEN gone ELSE 0 END AS chunks_removed FROM dc""",
)
def ing7(spark, d):
    return plan(spark, d)[0].drop("site_id")


@query("ing7_prune_removed", f"WITH {DECISION} SELECT id FROM st WHERE doc_id NOT IN (SELECT doc_id FROM nw) AND source IN (SELECT source FROM dc WHERE reason IS NULL)")
def ing7_removed(spark, d):
    return plan(spark, d)[1].select("id")


@query(
    "ing8_run_report",
    f"""WITH {DECISION}, {CHUNK_COUNTS},
        per AS (SELECT source, sum(total) AS t, sum(embedded) AS e, sum(deleted) AS x FROM c GROUP BY source),
        dn AS (SELECT source, count(DISTINCT doc_id) AS n FROM nw GROUP BY source),
        a AS (SELECT source, coalesce(n, 0) AS n, coalesce(t, 0) AS t, coalesce(e, 0) AS e, coalesce(x, 0) AS x,
          CASE WHEN reason IS NULL THEN coalesce(gone, 0) ELSE 0 END AS pr, coalesce(failures, 0) AS f FROM dn FULL JOIN per USING (source) FULL JOIN dc USING (source))
        SELECT source AS source_id, sum(n) AS documents, sum(t) AS chunks_total, sum(e) AS chunks_embedded, sum(t - e) AS chunks_skipped,
          sum(x) + CASE WHEN grouping(source) = 1 THEN sum(pr) ELSE 0 END AS chunks_deleted, sum(pr) AS chunks_pruned, sum(f) AS failures
        FROM a GROUP BY ROLLUP (source)""",
)
def ing8(spark, d):
    new, stored = new_chunks(spark, d), stored_chunks(spark, d)
    counts = ingestion.ingest_counts(ingestion.diff_chunks(new, stored), ingestion.orphan_chunks(new, stored), ["source_id"])
    docs = new_documents(spark, d).groupBy(F.col("source").alias("source_id")).agg(F.count_distinct("doc_id").alias("documents"))
    return ingestion.run_report(docs, counts, plan(spark, d)[0]).drop("is_total")


@query(
    "ing9_quarantine",
    """SELECT source AS source_id, CASE WHEN quality = 0 THEN 'no id' ELSE 'no text' END AS failure, count(*) AS n
       FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 0 GROUP BY ALL""",
)
def ing9(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rows = docs.select(
        F.when(F.coalesce(F.col("quality") != 0, F.lit(True)), F.col("doc_id")).alias("id"),
        F.col("source").alias("source_id"),
        F.when(F.col("toxic") == 1, "").otherwise(F.col("text")).alias("text"),
    )
    return ingestion.quarantine(rows)[1].groupBy("source_id", "failure").agg(F.count("*").alias("n"))


WHOLE = ChunkSettings(max_chunk_characters=10_000_000, min_chunk_characters=0, overlap_characters=0)


def whole_documents(spark, d) -> DataFrame:
    """Documents that make one chunk each: no headings, no blank lines, and a limit beyond all of them."""
    return table(spark, d, "documents").select(
        F.lit("main").alias("site_id"), F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("source_id"), F.lit("page").alias("content_type"),
        F.lit("t").alias("title"), F.concat(F.lit("v1 "), F.md5("text")).alias("text"), F.lit(None).cast("string").alias("url"), "lang", F.lit(1).alias("edition"),
    )


def second_edition(docs: DataFrame) -> DataFrame:
    """English texts as before, French ones changed, Spanish ones emptied, src5 without its German ones, src6 nearly gone."""
    gone = ((F.col("source_id") == "src5") & (F.col("lang") == "de")) | ((F.col("source_id") == "src6") & (F.col("lang") != "fr"))
    text = F.when(F.col("lang") == "fr", F.concat("text", F.lit(" more"))).when(F.col("lang") == "es", "").otherwise(F.col("text"))
    return docs.filter(~gone).withColumn("text", text).withColumn("edition", F.lit(2))


SURVIVORS = """SELECT 'd' || doc_id || '#0' AS id, source AS source_id, 'v1 ' || md5(text) || CASE lang WHEN 'fr' THEN ' more' ELSE '' END AS body FROM documents
  WHERE CASE WHEN source = 'src6' AND lang <> 'fr' THEN {kept} WHEN source = 'src5' AND lang = 'de' THEN {pruned} ELSE lang <> 'es' END"""


@query("ing_full_run", SURVIVORS.format(kept="(SELECT avg((lang = 'fr')::INT) < 0.5 FROM documents WHERE source = 'src6')",
                                        pruned="(SELECT avg((lang <> 'de')::INT) < 0.5 FROM documents WHERE source = 'src5')"))
def full_run(spark, d):
    """Two runs over two editions of the documents; what the table then holds."""
    folder, docs = scratch(spark), whole_documents(spark, d)
    run_ingestion(docs, f"{folder}/table", 0, WHOLE, 16)
    run_ingestion(second_edition(docs), f"{folder}/table", 1, WHOLE, 16)
    return versions.read_current(spark, f"{folder}/table").select("id", "source_id", F.col("text").alias("body"))


@query("ing_run_without_prune", SURVIVORS.format(kept="true", pruned="true"))
def run_without_prune(spark, d):
    """The same runs with pruning switched off: what was not seen stays."""
    folder, docs = scratch(spark), whole_documents(spark, d)
    run_ingestion(docs, f"{folder}/table", 0, WHOLE, 16)
    run_ingestion(second_edition(docs), f"{folder}/table", 1, WHOLE, 16, prune=False)
    return versions.read_current(spark, f"{folder}/table").select("id", "source_id", F.col("text").alias("body"))


def whole_texts(spark, d) -> DataFrame:
    """The documents with their whole texts, for the production chunk settings."""
    return table(spark, d, "documents").select(
        F.lit("main").alias("site_id"), F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("source_id"), F.lit("page").alias("content_type"),
        F.lit("t").alias("title"), "text", F.lit(None).cast("string").alias("url"), "lang", F.lit(1).alias("edition"),
    )


def revised_texts(docs: DataFrame) -> DataFrame:
    """English texts as before, French ones longer at the end, German ones cut to a third, Spanish ones emptied."""
    third = F.substring("text", F.lit(1), F.ceil(F.length("text") / 3).cast("int"))
    text = F.when(F.col("lang") == "fr", F.concat("text", F.lit(" more"))).when(F.col("lang") == "de", third).when(F.col("lang") == "es", "").otherwise(F.col("text"))
    return docs.withColumns({"text": text, "edition": F.lit(2)})


def second_texts(docs: DataFrame) -> DataFrame:
    """The revised texts; src5 is without its German ones, src6 nearly gone."""
    gone = ((F.col("source_id") == "src5") & (F.col("lang") == "de")) | ((F.col("source_id") == "src6") & (F.col("lang") != "fr"))
    return revised_texts(docs.filter(~gone))


def run_texts(spark, d, prune: bool) -> DataFrame:
    folder, docs = scratch(spark), whole_texts(spark, d)
    run_ingestion(docs, f"{folder}/table", 0)
    run_ingestion(second_texts(docs), f"{folder}/table", 1, prune=prune)
    return versions.read_current(spark, f"{folder}/table").select("id", "source_id", F.col("text").alias("body"), F.size("embedding").alias("dims"))


# SQL cannot cut texts into chunks; a test compares these with brute force
@query("ing_full_run_texts")
def full_run_texts(spark, d):
    """Two runs over two editions of the whole texts with the production settings; what the table then holds."""
    return run_texts(spark, d, True)


@query("ing_run_without_prune_texts")
def run_without_prune_texts(spark, d):
    """The same runs with pruning switched off: what was not seen stays."""
    return run_texts(spark, d, False)


MERGED = f"""WITH {VERSIONS} SELECT id, md5(body) AS body FROM nw UNION ALL SELECT id, md5(body) FROM st WHERE id NOT IN (SELECT id FROM nw)"""


@query("snk1_upsert_vectors", MERGED)
def snk1(spark, d):
    """Write the stored version, upsert the new one, read the table back."""
    folder = scratch(spark)
    columns = ["site_id", "id", "source_id", "document_id", "body", "content_hash"]
    versions.upsert_vectors(stored_chunks(spark, d).select(columns), f"{folder}/table", 1)
    versions.upsert_vectors(new_chunks(spark, d).select(columns), f"{folder}/table", 2)
    versions.compact(spark, f"{folder}/table", f"{folder}/compacted")
    return versions.read_current(spark, f"{folder}/compacted").select("id", F.md5("body").alias("body"))


@query("snk2_write_report", f"{search_queries.FULL} SELECT count(*) FILTER (passed) AS passed, count(*) AS total, 'baseline' AS run FROM res")
def snk2(spark, d):
    """Write an evaluation snapshot as JSON and read it back."""
    folder = scratch(spark)
    report = evaluation.summarize(search_queries.results(spark, d), SETTINGS)
    sinks.write_report(report, folder, "baseline")
    return spark.read.json(folder).select("passed", "total", "run")
