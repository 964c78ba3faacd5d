"""Language identification against a plain version that goes letter by letter, and its held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from lorekeep.llm import language_id
from lorekeep.llm.queries import QUERIES
from tests.llm.helpers import ODD, documents


def made(seed, letters, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(words)) + r.choice(["", ".", "!\n", " 12"])


KINDS = {"aa": "aeioulnrst", "bb": "äöüszkchei", "cc": "абвгдежзик", "dd": "漢字仮名交文章"}


def corpus(n):
    rows = [(i, made(i, letters, 3 + i % 60), lang) for i in range(n) for lang, letters in [sorted(KINDS.items())[i % 4]]]
    return rows + [(n + i, t, None if i % 2 else "aa") for i, (_, t) in enumerate(ODD)] + [(None, "Ärger ÄÖÜ", "bb"), (900, "123 !?", "bb"), (901, "", "cc"), (902, None, "cc")]


def table(spark, rows):
    full = [(i, t, lang, "x", 1, b"y", 2) for i, t, lang in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, branch string, block int, vector binary, score long")


def plain_bundle(text):
    read = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    read = " " + " ".join(read.split()) + " "
    total = np.zeros(language_id.DIMENSIONS, np.int64)
    if not read.strip():
        return None
    seen = {}
    for i in range(len(read) - 2):
        seen[read[i : i + 3]] = seen.get(read[i : i + 3], 0) + 1
    for gram, n in seen.items():
        one = np.ones(language_id.DIMENSIONS, np.int64)
        for back, c in enumerate(reversed(gram)):
            one = one * np.roll(language_id.letter_vector(ord(c)).astype(np.int64), back)
        total += n * one
    return total


def brute(train, asked):
    sums = {}
    for _, text, lang in train:
        v = plain_bundle(text)
        if lang is not None and v is not None and (size := np.sqrt((v.astype(float) ** 2).sum())):
            sums[lang] = sums.get(lang, 0) + np.rint(v * (language_id.UNIT / size))
    out = []
    for i, text, _ in asked:
        v = plain_bundle(text)
        if v is None or not sums:
            out.append((i, "und", 0.0))
            continue
        cosine = {k: float((s * v).sum() / np.sqrt((s**2).sum()) / np.sqrt((v.astype(float) ** 2).sum())) for k, s in sums.items()}
        best = min(cosine, key=lambda k: (-round(cosine[k], 9), k))
        out.append((i, best, max(0.0, cosine[best])))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 6))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want])


def test_language_id_matches_brute_force(spark):
    train, asked = corpus(60), corpus(90)
    learnt = language_id.learn(table(spark, train).repartition(3))
    got = language_id.identify(table(spark, asked), learnt)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    same(got.collect(), brute(train, asked))


def test_language_id_in_blocks_of_prototypes_gives_the_same(spark):
    train, asked = corpus(60), corpus(40)
    learnt = language_id.learn(table(spark, train))
    got = language_id.identify(table(spark, asked), learnt, at_once=1).select("doc_id", "lang_pred", "score")
    same(got.collect(), brute(train, asked))


def test_a_text_longer_than_a_slice_and_than_what_is_remembered(spark, monkeypatch):
    text = made(1, "".join(map(chr, range(0x4E00, 0x4F00))), 3000)
    want = plain_bundle(text)
    for name, value in (("SLICE", 1000), ("ROWS", 100), ("REMEMBERED", 150)):
        monkeypatch.setattr(language_id, name, value)
    assert (language_id.Bundler().bundle(text) == want).all()


def test_language_id_of_nothing(spark):
    empty = table(spark, [])
    assert language_id.learn(empty).collect() == [] and language_id.identify(empty, language_id.learn(empty)).collect() == []
    asked = corpus(2)
    same(language_id.identify(table(spark, asked), language_id.learn(empty)).collect(), brute([], asked))


def test_held_out_languages_of_the_sample(spark):
    folder = "/root/testdata/sf0.01"
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op13_language_id"](spark, folder).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.95 * len(held)
