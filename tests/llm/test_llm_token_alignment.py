"""Token alignment and perfect hashing against brute force."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from lorekeep.llm import token_alignment
from lorekeep.llm.perfect_hash import PerfectHash, build_shard
from lorekeep.llm.queries import QUERIES
from tests.llm.helpers import ODD, documents, prose

NAMES = token_alignment.Vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def test_perfect_hash_is_minimal_and_tells_strangers():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 31, 50_000))
    put, strange = keys[::2], keys[1::2]
    shard = put % 7
    made = PerfectHash.of(9, [(s, *build_shard(put[shard == s])) for s in range(7)])
    at = made.index(put, shard)
    assert sorted(at) == list(range(len(put))) and (made.keys[at] == put).all()
    assert (made.index(strange, strange % 9) == -1).all()
    assert PerfectHash.of(3, []).index(keys, keys % 3).max() == -1 and build_shard(np.zeros(0, np.int64)) == ([], b"", b"")


def brute(rows):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_tool, b_tool = Tokenizer.from_file(NAMES.byte_level), SentencePieceProcessor(model_file=NAMES.pieces)
    a_tool.encode_special_tokens = True
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    held, alone, docs = [], defaultdict(int), Counter()
    for _, text in rows:
        a = b = []
        if text:
            a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)
            a_bytes = [bytes(byte[c] for c in a_tool.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if b_tool.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_tool.id_to_piece(i)) for i in b)]
            if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a = b = []
        links, groups, i, j, a_at, b_at, ga, gb = [], [], 0, 0, 0, 0, [], []
        while i < len(a):
            a_to, b_to = a_at + len(a_bytes[i]), b_at + len(b_bytes[j])
            links.append((a[i], b[j]))
            if a_to <= b_to:
                ga, i, a_at = [*ga, a[i]], i + 1, a_to
            if b_to <= a_to:
                gb, j, b_at = [*gb, b[j]], j + 1, b_to
            if a_to == b_to:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        held.append((len(a), len(b), groups, links))
        docs.update(set(links))
    for (a, _), n in docs.items():
        alone[a] = max(alone[a], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return Counter((i, na, nb, len(g), len(k), sum(docs[x] == alone[x[0]] for x in k), sum(docs[x] for x in k), sha(g)) for (i, _), (na, nb, g, k) in zip(rows, held))


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_rows():
    r = random.Random(5)
    pool = [*"abcXYZ019 \n\t.,'!é漢😀▁ \x00\x85<>", " the", "  ", "<|endoftext|>", "</s>", "<0x41>", "'ll"]
    rows = ODD + [(100 + i, prose(i, 120, 40)) for i in range(30)] + [(200 + i, "".join(r.choice(pool) for _ in range(r.randrange(40)))) for i in range(300)]
    return rows + [(600, " " * 5000 + "a"), (601, "\n" * 5000), (602, "a b " * 40_000), (603, "▁"), (604, " ")]


def test_alignment_matches_brute_force(spark):
    rows = odd_rows()
    got = token_alignment.align(documents(spark, rows), NAMES)
    assert got.columns == COLUMNS and Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_alignment_in_rounds_and_small_shards_gives_the_same(spark):
    rows = odd_rows()
    docs = documents(spark, rows).repartition(4)
    assert Counter(tuple(r) for r in token_alignment.align(docs, NAMES, round_bytes=20_000, per_shard=100).select(*COLUMNS).collect()) == brute(rows)


def test_alignment_of_nothing(spark):
    assert token_alignment.align(documents(spark, []), NAMES).collect() == []
    assert [tuple(r) for r in token_alignment.align(documents(spark, [(1, None)]), NAMES).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("size", ["0.001"])
def test_alignment_query(spark, size):
    folder = f"/root/testdata/sf{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in QUERIES["op12_token_alignment"](spark, folder).select(*COLUMNS).collect()) == brute(rows)
