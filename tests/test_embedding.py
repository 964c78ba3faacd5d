"""Rows without text: chunks must have one, whole tables may not."""

import pytest

from lorekeep.operators.ingestion import embed_chunks, embed_query
from lorekeep.operators.vectors import knn
from lorekeep.plans import ingest_queries, search_queries


def lengths(texts):
    return [[float(len(t)), 1.0] for t in texts]


TEXTS = [(1, "one"), (2, None), (3, ""), (4, " \n"), (5, "three")]


def test_a_chunk_needs_a_text_and_a_row_of_a_table_does_not(spark):
    rows = spark.createDataFrame(TEXTS, "id long, text string").coalesce(1)
    for n in (2, 3, 4):
        with pytest.raises(Exception, match="cannot embed an empty text"):
            embed_chunks(rows.filter(f"id = {n}"), lengths, 2).collect()
    want = {n: None if t is None else [float(len(t)), 1.0] for n, t in TEXTS}
    for batch in (1, 2, 16):
        assert {r["id"]: r["embedding"] for r in embed_chunks(rows, lengths, 2, batch, strict=False).collect()} == want
    asked = embed_query(rows.withColumnRenamed("text", "question"), "q: ", lengths, 2, strict=False)
    assert {r["id"]: r["embedding"] for r in asked.collect()} == {n: v and [v[0] + 3, 1.0] for n, v in want.items()}


def test_what_has_no_vector_neither_finds_nor_is_found(spark):
    stored = spark.createDataFrame([("s", 1, [1.0, 0.0]), ("s", 2, None), ("s", 3, [1.0, 0.0]), ("s", None, [1.0, 0.0])], "site_id string, id long, embedding array<float>")
    asked = spark.createDataFrame([(7, [2.0, 0.0]), (8, None)], "query_id long, embedding array<float>")
    for bound in (0, 1 << 20):
        found = knn(asked, stored, "s", 2, broadcast_bytes=bound).select("query_id", "id", "rank").collect()
        assert sorted(map(tuple, found), key=lambda r: r[2]) == [(7, None, 1), (7, 1, 2)]
        assert knn(asked.filter("query_id = 8"), stored, "s", 2, broadcast_bytes=bound).collect() == []


def test_queries_take_documents_and_questions_without_text(spark, tmp_path):
    said = ["the end and then", None, "", "  ", "on the other", "question and answer"]
    docs = spark.createDataFrame([(i, t, "en", f"src{i}") for i, t in enumerate(said)], "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the and"), (2, None), (3, " ")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    made = {r["doc_id"]: (r["a"], r["b"]) for r in ingest_queries.ing4_model(spark, str(tmp_path)).collect()}
    assert made == {i: (None, None) if t is None else (float(len(t)), float(t.count(" "))) for i, t in enumerate(said)}
    met = {(r["query_id"], r["id"]) for r in search_queries.vec2(spark, str(tmp_path)).collect()}
    assert {i for q, i in met if q == 3} == {0, 2, 3, 4, 5} and not any(q == 2 or i == 1 for q, i in met)
    passed = {r["query_id"]: r["retrieved"] for r in search_queries.ev2(spark, str(tmp_path)).collect()}
    assert passed == {1: 5, 2: 0, 3: 5}
    context = {r["query_id"]: r["used"] for r in search_queries.ret8(spark, str(tmp_path)).collect()}
    assert context[2] == 0 and context[1] > 0 and context[3] > 0
