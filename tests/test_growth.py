"""Work that must not be done twice, or in one task, as the tables grow."""

from pyspark.sql import functions as F

from lorekeep.operators import commerce, ingestion
from lorekeep.plans import commerce_queries
from lorekeep.plans.ingest import ingest_batch
from lorekeep.settings import ChunkSettings
from lorekeep.sources import versions


def test_json_is_parsed_once_and_parts_are_dealt_to_all_cores(spark, tmp_path):
    good = '{"sku": " a ", "name": "n", "url": "https://x.example/a", "price": {"formatted": "£1", "amount": 1, "currency": "GBP", "taxIncluded": "no"}, "availability": "sold"}'
    rows = [(1, good), (2, good.replace('"n"', '" "')), (3, good.replace("https", "ftp")), (4, "no json"), (5, None), (6, good.replace('"£1"', "1"))]
    found = commerce.clean_products(spark.createDataFrame(rows, "k int, raw string")).select("k", "sku", "price.*")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert sorted(map(tuple, found.collect())) == [(1, "a", "£1", None, "GBP", None), (6, "a", None, None, None, None)]
    orders = commerce.clean_orders(spark.createDataFrame([('{"reference": "r", "items": [{"name": "a", "quantity": 0}, {"name": " "}]}',), ("{}",)], "raw string"))
    assert orders.select("total.*")._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert [(r["reference"], [tuple(i) for i in r["items"]]) for r in orders.collect()] == [("r", [("a", 1, None)])]
    parts = spark.range(100).select(F.col("id").alias("p_partkey"), *[F.lit("x").alias(c) for c in ("p_name", "p_brand", "p_type")], F.lit(9).alias("p_size"), F.lit(1.5).alias("p_retailprice"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert commerce_queries.raw_products(spark, str(tmp_path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def points(spark, rows):
    return spark.createDataFrame([("s" if i % 3 else None, f"d{d}#{i}" if i else None, f"d{d}", text) for d, i, text in rows], "site_id string, id string, document_id string, text string")


def test_a_table_of_one_segment_is_read_where_it_lies_and_holds_each_key_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(d, i, f"{d}.{i}") for d in range(20) for i in range(1, 4)]
    gone = points(spark, [(0, 1, ""), (0, 9, "")]).drop("text")
    versions.write_version(points(spark, [*rows, *rows, (5, 0, "null key"), (5, 0, "null key")]), path, 0, gone.filter("id = 'd0#9'"), buckets=8)
    read = versions.read_current(spark, path)
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()  # before: every column was shuffled
    wanted = {("s" if i % 3 else None, f"d{d}#{i}", f"d{d}", t) for d, i, t in rows} | {(None, None, "d5", "null key")}
    assert sorted(map(str, map(tuple, read.collect()))) == sorted(map(str, wanted))
    assert versions.written_segments(spark, path)[0].rows == len(wanted) + 1  # with a tombstone
    versions.write_version(points(spark, [(5, 0, "newer"), (1, 1, "newer"), (99, 1, "new")]), path, 1, gone, buckets=8)
    versions.write_version(points(spark, []), path, 2)
    now = {t[1]: t for t in wanted} | {None: (None, None, "d5", "newer"), "d1#1": ("s", "d1#1", "d1", "newer"), "d99#1": ("s", "d99#1", "d99", "new")}
    del now["d0#1"]
    for place in (path, f"{tmp_path}/compacted"):
        assert sorted(map(str, map(tuple, versions.read_current(spark, place).collect()))) == sorted(map(str, now.values()))
        if place == path:
            versions.compact(spark, path, f"{tmp_path}/compacted")
    some = versions.read_current(spark, path, ["text"], documents=points(spark, [(1, 1, ""), (99, 1, "")]))
    assert some.columns == ["site_id", "id", "text"] and sorted(r["text"] for r in some.collect()) == ["1.2", "new", "newer"]


def test_a_batch_is_compared_and_laid_out_in_one_shuffle(spark):
    new = spark.createDataFrame([("s", f"d{d}#{i}", f"d{d}", f"h{d}", "body") for d in range(9) for i in range(2)] + [("s", "d1#0", "d1", "h1", "body"), (None, "d1#0", "d1", "h1", "body")],
                                "site_id string, id string, document_id string, content_hash string, body string")
    known = spark.createDataFrame([("s", f"d{d}#0", f"d{d}", "h1") for d in range(3)] + [("s", "d99#0", "d99", "h1"), (None, "d1#0", "d1", "h1")], "site_id string, id string, document_id string, content_hash string")
    near = versions.bucket_of("document_id", 8)
    found = ingestion.diff_chunks(new, known, near=near)
    assert sorted(map(str, found.collect())) == sorted(map(str, ingestion.diff_chunks(new, known).select(*found.columns).collect()))
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_batches_of_repeated_documents_without_a_version(spark, tmp_path):
    docs = [("s", f"d{n}", "src", "page", "t", f"Text number {n}. " * 20, None) for n in range(4)] + [("s", None, "src", "page", "t", "no id", None)]
    frame = lambda rows: spark.createDataFrame(rows, "site_id string, id string, source_id string, content_type string, title string, text string, url string")
    ingest_batch(frame(docs * 2), f"{tmp_path}/t", 0, ChunkSettings(), 8)
    later = [docs[0], (*docs[1][:5], "Other text. " * 20, None), (*docs[2][:5], "", None)]
    ingest_batch(frame(later * 2), f"{tmp_path}/t", 1, ChunkSettings(), 8)
    rows = versions.read_current(spark, f"{tmp_path}/t").collect()
    assert {r["id"]: (r["text"][:6], len(r["embedding"])) for r in rows} == {"d0#0": ("Text n", 8), "d1#0": ("Other ", 8), "d3#0": ("Text n", 8)} and len(rows) == 3
    assert sorted((s.first, s.rows) for s in versions.written_segments(spark, f"{tmp_path}/t")) == [(0, 4), (1, 2)]  # one changed chunk, one tombstone
