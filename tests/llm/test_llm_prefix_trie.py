"""The prefix trie against brute force: odd rows, long conversations, copies."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from lorekeep.llm import prefix_trie
from lorekeep.llm.queries import QUERIES

EXTRA = "name string, d long, conv string, k long, h string, weight string"


def turns(spark, rows):
    """Turns with columns whose names clash with those the operator uses inside."""
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z", "w") for r in rows], "conv_id long, turn long, role string, text string, " + EXTRA)


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = own.get(base, [])[:h] + mine[h:]
    ids, of, text, up = {(): 0}, defaultdict(list), {0: ""}, {}
    ends = defaultdict(list)
    depth = {0: 0}
    step = {}
    for c, path in sorted(paths.items()):
        node = 0
        of[0].append(c)
        for turn in path:
            new = step.setdefault((node, turn), len(depth))
            if new not in depth:
                depth[new], text[new], up[new] = depth[node] + 1, turn[1], node
            node = new
            of[node].append(c)
        ends[node].append(c)
    if not paths:
        return []
    children = defaultdict(int)
    for n, u in up.items():
        children[u] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for n in depth:
        gain, at = (len(of[n]) - 1) * len(text[n]), n
        while True:
            leaves[at] += children[n] == 0
            saved[at] += gain
            if at == 0:
                break
            at = up[at]
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted((min(of[n]), depth[n], min(of[up[n]]) if n else -1, len(of[n]), children[n], leaves[n], saved[n], sha(n)) for n in depth)


def found(spark, rows):
    members, steps = prefix_trie.rebuilt(prefix_trie.ordered_turns(turns(spark, rows)))
    trie = prefix_trie.prefix_trie(members, steps)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert trie.columns == columns
    return sorted(tuple(-1 if v is None else v for v in r) for r in trie.collect())


def test_trie_of_odd_rows(spark):
    rows = [(None, 0, "user", "no id"), (5, None, None, None), (5, 0, "user", ""), (5, 0, "user", ""), (-3, 1, "a", "x"), (-3, 0, "b", "y"), (100, 0, "user", "ä漢😀")]
    rows += [(100 + i, t, "user" if t % 2 else None, f"turn {t} {i % 3 if t > 4 else ''}") for i in range(40) for t in range(i % 9)]
    rows += [(7, 0, "us", "erx"), (8, 0, "user", "x"), (9, 0, "user", "x" * 100_000)]
    assert found(spark, rows) == brute(rows)


def test_trie_of_copies_and_long_conversations(spark):
    rows = [(i, t, "user", f"same {t}") for i in range(60) for t in range(7)]
    rows += [(c, t, "user", f"long {t if t < n else (c, t)}") for c, n, size in ((301, 200, 260), (302, 200, 200), (303, 128, 128), (304, 64, 130), (305, 63, 64), (306, 199, 256)) for t in range(size)]
    assert found(spark, rows) == brute(rows)


def test_trie_of_a_conversation_beyond_two_levels(spark):
    rows = [(c, t, "user", str(t if t < 4097 or c == 401 else -t)) for c in (401, 402) for t in range(4300)]
    assert found(spark, rows) == brute(rows)


def test_trie_of_nothing(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("size", ["0.001"])
def test_trie_query(spark, size):
    folder = f"/root/testdata/sf{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(-1 if v is None else v for v in r) for r in QUERIES["op11_prefix_trie"](spark, folder).collect()) == brute(rows)
