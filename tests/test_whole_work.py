"""Queries over all rows and whole texts, which SQL cannot state, against brute force on small tables."""

import random
from urllib.parse import urldefrag, urljoin

import pytest

from lorekeep.operators.chunking import chunk_text
from lorekeep.plans import all_queries
from lorekeep.settings import ChunkSettings


def text(seed: int, paragraphs: int) -> str:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9)))
    return "\n\n".join((f"## Part {i}\n\n" if i % 4 == 3 else "") + " ".join(word() for _ in range(90)) + "." for i in range(paragraphs))


DOCS = [(i, text(i, 1 + i % 13), ("en", "fr", "de", "es")[i % 4], f"src{4 + i % 3}") for i in range(48)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def revised(body: str, lang: str) -> str:
    return {"fr": body + " more", "de": body[: -(-len(body) // 3)], "es": ""}.get(lang, body)


def chunks(doc: int, source: str, body: str) -> set:
    return {(f"d{doc}#{n}", source, piece) for n, (piece, _) in enumerate(chunk_text(body, ChunkSettings()))}


@pytest.mark.parametrize("name", ["ing_full_run_texts", "ing_run_without_prune_texts", "stream_ing10_ingest_texts"])
def test_ingestion_of_whole_texts(spark, folder, name):
    away = lambda lang, source: not name.startswith("stream") and (source == "src5" and lang == "de" or source == "src6" and lang != "fr")
    pruned = set()
    for source in {"src5", "src6"} if name == "ing_full_run_texts" else ():
        held = [not away(lang, s) for _, _, lang, s in DOCS if s == source]
        if sum(held) / len(held) >= 0.5:
            pruned.add(source)
    want, fewer = set(), 0
    for doc, body, lang, source in DOCS:
        first, second = chunks(doc, source, body), chunks(doc, source, revised(body, lang))
        want |= (set() if source in pruned else first) if away(lang, source) else second
        fewer += len(first) > len(second) > 1
    got = [tuple(r) for r in all_queries().QUERIES[name](spark, folder).select("id", "source_id", "body").collect()]
    assert fewer and len(got) == len(want) and set(got) == want


def test_every_document_becomes_a_point(spark, folder):
    got = all_queries().QUERIES["ing6_to_points_of_all"](spark, folder).select("id", "dims").collect()
    assert sorted(map(tuple, got)) == sorted((f"{i}#0", 64) for i, *_ in DOCS)


LINKS = ["/plain", "/a/b?x=1", "/a#part", "../up", "./same", "next.html", "sub/deep/../x", "https://other.example/y?z=1", "//third.example/w", "?q=2", "/a/./b/../c"]


def test_all_links_are_resolved(spark, tmp_path):
    base = "https://kb.example/one/two/page.html"
    html = "<html><body><p>" + " ".join(f'<a href="{x}">go</a>' for x in LINKS) + "</p></body></html>"
    spark.createDataFrame([(1, base, html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.href: r.url for r in all_queries().QUERIES["cr1_all_links"](spark, str(tmp_path)).collect()}
    assert got == {x: urldefrag(urljoin(base, x))[0] for x in LINKS}
