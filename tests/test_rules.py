"""Small hand-made cases that the sample tables do not hold."""

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.html import parse_page
from lorekeep.functions.privacy import redact_keys, redact_text
from lorekeep.functions.urls import normalize_url, punycode_url
from lorekeep.operators.chunking import chunk_text, split_oversized, tail_overlap, text_blocks
from lorekeep.operators.ingestion import quarantine
from lorekeep.plans.ingest import ingest_batch, run_ingestion
from lorekeep.settings import ChunkSettings
from lorekeep.sources.versions import compact, read_current, write_version


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# chunking


def test_blocks_and_nested_headings():
    text = "intro\nmore\n\n# One\nbody\n## Two\nx\n### Three\ny\n# Four\nz"
    assert list(text_blocks(text)) == [(0, "intro\nmore"), (1, "One"), (0, "body"), (2, "Two"), (0, "x"), (3, "Three"), (0, "y"), (1, "Four"), (0, "z")]
    found = chunk_text(text, ChunkSettings(min_chunk_characters=0, overlap_characters=0))
    assert [path for _, path in found] == [[], ["One"], ["One", "Two"], ["One", "Two", "Three"], ["Four"]]
    assert found[2][0] == "## Two\n\nx"


def test_oversized_blocks_are_cut_at_sentences():
    assert split_oversized("One is. Two is. Three is long.", 15) == ["One is. Two is.", "Three is long."]
    assert split_oversized("a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5]
    assert split_oversized("short", 10) == ["short"]


def test_overlap_starts_at_a_sentence():
    assert tail_overlap("First one. Second one.", 14) == "Second one."
    assert tail_overlap("short", 10) == "" and tail_overlap("anything", 0) == ""


def test_size_cut_overlap_and_runts():
    sentence = "Word word word word."
    paragraphs = "\n\n".join([sentence] * 6)
    cut = chunk_text(paragraphs, ChunkSettings(max_chunk_characters=45, min_chunk_characters=0, overlap_characters=0))
    assert [b for b, _ in cut] == [f"{sentence}\n\n{sentence}"] * 3
    merged = chunk_text(f"{sentence}\n\n## H\n\ntiny", ChunkSettings(max_chunk_characters=100, min_chunk_characters=50, overlap_characters=0))
    assert [b for b, _ in merged] == [f"{sentence}\n\n## H\n\ntiny"]


# pages


def test_page_fields_and_furniture():
    page = parse_page(
        "<html lang='de'><head><title>T</title><meta name='robots' content='NOINDEX, follow'><link rel=canonical href='https://bücher.example/a'></head>"
        "<body><nav>menu</nav><main><h1>Head</h1><p>one<br>two<script>x()</script><ul><li>a<li>b</ul></main><footer>f</footer><a href='https://bücher.example/x'>l</a></body>"
    )
    assert page["title"] == "Head" and page["noindex"] and page["locale"] == "de"
    assert "menu" not in page["text"] and "x()" not in page["text"] and "one" in page["text"] and "b" in page["text"]
    assert page["canonical"] == "https://xn--bcher-kva.example/a" and page["links"] == ["https://xn--bcher-kva.example/x"]


@pytest.mark.parametrize(
    "url, wanted",
    [("http://bücher.example/ü", "http://xn--bcher-kva.example/ü"), ("https://u@BÜCHER.example:80?x", "https://u@xn--bcher-kva.example:80?x"), ("/path/ü", "/path/ü"), ("https://plain.example", "https://plain.example"), (None, None)],
)
def test_international_hosts(url, wanted):
    assert punycode_url(url) == wanted


def test_addresses(spark):
    cases = [("HTTP://Example.COM:80/a/../b/?utm_source=x&b=2&a=1#f", "http://example.com/b?a=1&b=2"), ("ftp://example.com", None), ("https://example.com", "https://example.com/"), ("https://example.com/" + "p/" * 3000 + "..", None)]
    got = [r[0] for r in spark.createDataFrame(cases, "u string, w string").select(normalize_url("u")).collect()]
    assert got[:3] == [w for _, w in cases[:3]] and got[3].count("/p") == 2999


# privacy


def test_personal_data():
    text, kinds = redact_text("Mail a.b@c.example, card 4111 1111 1111 1111, not 1234 5678 9012 3456")
    assert "a.b@c.example" not in text and "4111" not in text and "1234 5678 9012 3456" in text and len(kinds) == 2
    assert redact_text("nothing here") == ("nothing here", [])


def test_log_values(spark):
    cases = [('{"password": "x", "a": [{"token": 1}]}', '{"password":"[redacted]","a":[{"token":"[redacted]"}]}'), ("no json: hello", "no json: hello"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(cases, "v string, w string").select(redact_keys("v")).collect()]
    assert got == [w for _, w in cases]


# ingestion

ONE = ChunkSettings(max_chunk_characters=10_000, min_chunk_characters=0, overlap_characters=0)


def documents(spark, *found):
    full = [("s", i, source, "page", "t", text, None, edition) for i, source, text, edition in found]
    return spark.createDataFrame(full, "site_id string, id string, source_id string, content_type string, title string, text string, url string, edition int")


def stored(spark, table):
    return rows(read_current(spark, table).select("id", "text"))


def test_a_run_embeds_once_and_removes_what_is_gone(spark, tmp_path):
    table = str(tmp_path / "table")
    first = documents(spark, ("a", "x", "A", 1), ("b", "x", "B", 1), ("c", "x", "C", 1), ("d", "y", "D", 1), ("e", "y", "E", 1), ("f", "y", "F", 1))
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return [[1.0, 2.0] for _ in texts]

    run_ingestion(first, table, 0, ONE, 2, embed)
    assert calls.value == 6 and len(stored(spark, table)) == 6
    second = documents(spark, ("a", "x", "A", 2), ("b", "x", "B2", 2), ("d", "y", "", 2), (None, "y", "lost", 2))
    report = {r["source_id"]: r for r in run_ingestion(second, table, 1, ONE, 2, embed).collect()}
    # c is pruned; source y had a failure, so e and f stay; d was seen and is empty
    assert calls.value == 7
    assert [i for i, _ in stored(spark, table)] == ["a#0", "b#0", "e#0", "f#0"] and ("b#0", "B2") in stored(spark, table)
    assert report["x"]["chunks_pruned"] == 1 and report["y"]["failures"] == 1 and report["y"]["chunks_deleted"] == 1
    run_ingestion(documents(spark, ("a", "x", "A", 3), ("b", "x", "B2", 3)), table, 2, ONE, 2, embed, prune=False)
    assert calls.value == 7 and len(stored(spark, table)) == 4


def test_batches_replay_and_keep_one_row_per_id(spark, tmp_path):
    table = str(tmp_path / "table")
    batch = documents(spark, ("a", "x", "old", 1), ("a", "x", "new", 2), ("b", "x", "B", 1))
    for _ in range(2):
        ingest_batch(batch, table, 0, ONE, 8, newest="edition")
    assert stored(spark, table) == [("a#0", "new"), ("b#0", "B")]
    for _ in range(2):
        ingest_batch(documents(spark, ("a", "x", "", 3)), table, 1, ONE, 8, newest="edition")
    assert [i for i, _ in stored(spark, table)] == ["b#0"]
    ingest_batch(documents(spark, ("b", "x", "", 3)), table, 2, ONE, 8)
    assert stored(spark, table) == []


def test_versions_and_compaction(spark, tmp_path):
    table, target = str(tmp_path / "v"), str(tmp_path / "w")
    made = lambda *found: spark.createDataFrame([("s", *f) for f in found], "site_id string, id string, body string")
    write_version(made(("1", "a"), ("2", "b"), ("2", "b")), table, 0)
    write_version(made(("2", "c"), ("3", "d")), table, 1, made(("1", None)))
    now = [("s", "2", "c"), ("s", "3", "d")]
    assert rows(read_current(spark, table)) == now
    assert rows(read_current(spark, table, ["body"], before=1)) == [("s", "1", "a"), ("s", "2", "b")]
    compact(spark, table, target)
    assert rows(read_current(spark, target)) == now


def test_long_texts_are_no_failures(spark):
    good, bad = quarantine(documents(spark, ("a", "x", "l" * 300_000, 1), ("b", "x", "", 1), (None, "x", "t", 1)))
    assert [r["id"] for r in good.collect()] == ["a"] and sorted(r["failure"] for r in bad.collect()) == ["no id", "no text"]


# streams


def test_streams_give_one_answer_for_one_batch_and_for_many(spark, tmp_path):
    from lorekeep.streaming.run import drain, newest
    from lorekeep.streaming.stateful import conversation_state, rate_limit_stream

    turns = [("s", c, n, f"2024-01-01 0{h}:{m:02d}:00", "user", f"t{n}") for c in (1, 2) for n, (h, m) in enumerate([(0, 0), (0, 10), (2, 0), (2, 5), (2, 6), (2, 7)])]
    frame = spark.createDataFrame(turns, "site_id string, conversation_id long, seq long, at string, role string, content string").withColumn("at", F.to_timestamp("at"))
    answers = []
    for files in (1, 4):
        folder = str(tmp_path / f"in{files}")
        for n in range(files):
            frame.filter((F.col("seq") * files / 6).cast("int") == n).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        live = newest(drain(conversation_state(stream, 3, 3600), "update"), ["site_id", "conversation_id"])
        requests = stream.select(F.col("conversation_id").alias("client"), F.col("seq").alias("request_id"), "at")
        answers.append((rows(live.select("conversation_id", "seq", "position")), rows(drain(rate_limit_stream(requests, 600_000, 1)))))
    assert answers[0] == answers[1]
    assert answers[0][0] == [(c, s, p) for c in (1, 2) for p, s in enumerate((3, 4, 5), 1)]
    assert [a for c, _, a in answers[0][1] if c == 1] == [True, True, True, False, False, False]
