"""Each operator against brute force on small tables, and its results for odd rows and empty tables."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lorekeep.llm import chat_format, components, decontamination, exact_search, jaccard_join, language_model, packing, quality, spans, toxicity, url_rules
from lorekeep.llm.common import runs_of, words
from tests.llm.helpers import ODD, documents, prose

VOCABULARY = __import__("public_tokenizers").path("word_bpe_49k.json")


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


# language model


def brute_scores(train, texts):
    """(N, V, base, score without filter errors) of each text."""
    tokens = [words((t or "").encode()) + [b"\n"] for t in train]
    one = Counter(w for t in tokens for w in t)
    context = Counter(one) + Counter({b"<s>": len(train)})
    two = Counter(p for t in tokens for p in zip([b"<s>"] + t, t))
    kept = Counter()
    for (a, _), n in two.items():
        kept[a] += n - 1
    n, v = sum(one.values()), len(one)
    level = lambda c: float(language_model.VALUES[language_model.level_of(np.array([c]))[0]]) if c > 0 else 0.0
    out = []
    for text in texts:
        t = words((text or "").encode()) + [b"\n"]
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for a, w in zip([b"<s>"] + t, t):
            c = level(context[a])
            k = min(level(kept[a]), max(c - 1, 0))
            b = min(level(two[a, w] - 1), k)
            score += math.log10(min(1.0, b / max(c, 1) + (1 - k / max(c, 1)) * (level(one[w]) + 1) / (n + v + 1)))
        out.append((len(t), sum(one[w] > 0 for w in t), base, score))
    return n, v, out


def test_language_model_matches_brute_force(spark):
    train = [prose(i, 300, 60) for i in range(20)] + [prose(3, 300, 60)] * 3 + [None, ""]
    asked = [(i, prose(i + 15, 200, 60)) for i in range(8)] + ODD
    model = language_model.train(documents(spark, list(enumerate(train))))
    n, v, wanted = brute_scores(train, [t for _, t in asked])
    assert (model.tokens, model.types) == (n, v)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[3], 6))
    got = sorted(rows(language_model.score_documents(documents(spark, asked), model, hot_words=50), "doc_id", "n_tokens", "n_known", "base_score", "score"), key=key)
    want = sorted(((i, *w) for (i, _), w in zip(asked, wanted)), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3])
        assert w[4] - 1e-6 <= g[4] <= w[4] + 0.05 * g[1] + 0.5  # a false hit only raises a count


def test_language_model_in_rounds_gives_the_same(spark):
    asked = documents(spark, [(i, prose(i, 100, 60)) for i in range(6)] + ODD)
    model = language_model.train(asked, shard_bits=1 << 11)
    assert model.shards > 3
    one = sorted(rows(language_model.score_documents(asked, model), "doc_id", "score"), key=str)
    many = sorted(rows(language_model.score_documents(asked, model, filter_bytes=(1 << 11) // 8 * 2), "doc_id", "score"), key=str)
    assert one == many


def test_language_model_reads_texts_once_whatever_the_parts_of_its_filter(spark, monkeypatch):
    asked = documents(spark, [(i, prose(i, 300, 400)) for i in range(6)] + ODD)
    model = language_model.train(asked, shard_bits=1 << 11)
    parts = list(model.parts((1 << 11) // 8 * 2))
    assert len(parts) > 3 and not parts[0].whole
    contexts, tokens, _ = language_model.sequences([prose(i, 50, 800).encode() for i in range(9)], language_model.WordHashes())
    whole = language_model.find_levels(next(model.parts()), contexts, tokens)
    cut = language_model.find_in_parts(parts, contexts, tokens)
    assert (cut[:3] == whole[:3]).all() and (language_model.log_probability(cut, model.tokens, model.types) == language_model.log_probability(whole, model.tokens, model.types)).all()

    def again(*_):
        raise AssertionError("the texts are written and read again")

    monkeypatch.setattr(language_model, "stored", again)
    scored = language_model.score_documents(asked, model, filter_bytes=(1 << 11) // 8 * 2)
    assert scored.count() == 6 + len(ODD)


def test_language_model_of_nothing(spark):
    empty = documents(spark, [])
    model = language_model.train(empty)
    assert (model.tokens, model.types) == (0, 0)
    assert rows(language_model.score_documents(empty, model)) == []
    assert len(rows(language_model.score_documents(documents(spark, ODD), model))) == len(ODD)


# sentence runs


def brute_repeats(docs):
    """Sentences to remove of each (id, text), by comparing runs of sentences as text."""
    cut = {}
    for i, t in docs:
        text = (t or "").encode()
        where, hashes, counts = spans.sentences(text)
        _, _, start, end = spans.runs(hashes, counts, spans.RUN)
        body = [b" ".join(text[s:e].lower().split()) for s, e in where]
        cut[i, t] = [(tuple(body[s:e]), s, e) for s, e in zip(start, end)]
    first = {}
    for (i, _), held in sorted(cut.items(), key=lambda x: x[0][0]):
        for key, _, _ in held:
            first.setdefault(key, i)
    out = {}
    for (i, t), held in cut.items():
        gone, seen = set(), set()
        for key, s, e in held:
            if first[key] != i or key in seen:
                gone |= set(range(s, e))
            seen.add(key)
        where = spans.sentences((t or "").encode())[0]
        out[i] = (None if t is None else b"".join((t.encode())[s:e] for n, (s, e) in enumerate(where) if n not in gone).decode(), len(gone))
    return out


def test_repeated_passages_go_and_first_places_stay(spark):
    passage = prose(99, 60)
    docs = [(i, prose(i, 120)) for i in range(12)]
    docs += [(20 + i, prose(50 + i, 40) + ".\n" + passage + "\n" + prose(70 + i, 40)) for i in range(5)]
    docs += [(40, docs[0][1]), (41, docs[0][1].upper()), (42, "nothing to see here."), (43, "")]
    got = {r[0]: r[1:] for r in rows(spans.remove_repeats(documents(spark, docs)), "doc_id", "text", "n_removed")}
    assert got == brute_repeats(docs)
    assert got[40] == ("", spans.sentences(docs[0][1].encode())[1].size) and got[0][1] == 0
    core = " ".join(passage.split()[15:45])
    assert core in got[20][0] and not any(core in got[20 + i][0] for i in range(1, 5))
    assert got[42][1] == 0 and got[43] == ("", 0)


def test_repeats_of_odd_rows(spark):
    got = rows(spans.remove_repeats(documents(spark, ODD)), "doc_id", "text", "n_removed")
    assert len(got) == len(ODD) and (None, None, 0) in got and (9, None, 0) in got and got.count((10, "one", 0)) == 2
    assert rows(spans.remove_repeats(documents(spark, []))) == []


def test_sentences_cover_the_text():
    for text in [prose(1, 200), "a.\n\n b! c", "no end " * 40, "\n\n", "x", "", "漢字。漢字。 end. "]:
        where, hashes, counts = spans.sentences(text.encode())
        assert b"".join(text.encode()[s:e] for s, e in where) == text.encode()
        assert counts.sum() >= len(text.encode().split()) and len(hashes) == len(where)


def test_passages_of_fifty_words_go_wherever_they_start(spark):
    plain = [prose(300 + i, 50).replace(".", "") for i in range(20)]
    docs = []
    for i, passage in enumerate(plain):
        # four shapes: no stops at all, one or two stops inside, a stop right before it in one of the two texts
        words = passage.split()
        for at in ((), (17,), (16, 33), (24,))[i % 4]:
            words[at] += "."
        passage = " ".join(words)
        for j, (before, after) in enumerate(((3, 2), (9 + i, 14))):
            head = prose(1000 + 2 * i + j, before).replace(".", "") + (". " if i % 3 == 0 and j else " ")
            docs.append((100 * j + i, prose(2000 + 2 * i + j, 60) + ". " + head + passage + " " + prose(3000 + 2 * i + j, after).replace(".", "") + ". " + prose(4000 + 2 * i + j, 60)))
    got = {r[0]: r[1:] for r in rows(spans.remove_repeats(documents(spark, docs)), "doc_id", "text", "n_removed")}
    assert got == brute_repeats(docs)
    for i, passage in enumerate(plain):
        assert got[i] == (docs[2 * i][1], 0)
        held = got[100 + i][0].replace(".", "")
        assert " ".join(passage.split()[14:36]) not in held and got[100 + i][1] >= 3


def test_rows_without_ids_are_documents_of_their_own(spark):
    passage = prose(9, 80)
    docs = [(None, passage), (None, passage), (None, prose(10, 60) + ".\n" + passage), (5, prose(11, 60))]
    got = rows(spans.remove_repeats(documents(spark, docs)), "doc_id", "text")
    assert sum(passage in t for _, t in got) == 1 and sum(t == "" for _, t in got) >= 1 and (5, docs[3][1]) in got


# toxicity


def test_toxicity_on_held_out_rows(spark):
    foul = ["vileword", "grimspeak", "nastyterm"]
    texts, labels = [], []
    for i in range(400):
        t = prose(i, 80, 300).split()
        if i % 4 == 0:
            for j in range(0, 80, 10):
                t[j] = foul[(i + j) % 3]
        texts.append(" ".join(t))
        labels.append(int(i % 4 == 0))
    model = toxicity.train([t.encode() for t in texts[:300]], labels[:300], (225, 75))
    got = {r[0]: r[1:] for r in rows(toxicity.score_toxicity(documents(spark, list(enumerate(texts))[300:]), model), "doc_id", "score", "predicted")}
    right = sum(got[i][1] == labels[i] for i in range(300, 400))
    assert right >= 90 and all(0 <= s <= 1 for s, _ in got.values())


def test_toxicity_without_labels_and_for_odd_rows(spark):
    labels = spark.createDataFrame([(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.learn(documents(spark, ODD), labels)
    got = rows(toxicity.score_toxicity(documents(spark, ODD), model), "doc_id", "score", "predicted")
    assert len(got) == len(ODD) and len({s for _, s, _ in got}) == 1
    assert rows(toxicity.score_toxicity(documents(spark, []), model)) == []


# packing


def test_best_fit_decreasing_takes_the_tightest_window():
    lengths = sorted([int(x) for x in np.random.default_rng(1).integers(1, 65, 300)], reverse=True)
    rooms, wanted = [], []
    for n in lengths:
        fits = [r for r in rooms if r >= n]
        if fits:
            room = min(fits)
            rooms.remove(room)
        else:
            room = 64
        wanted.append(64 - room)
        rooms.append(room - n)
    assert [o for _, o in packing.best_fit_decreasing(lengths, 64)] == wanted


def test_long_texts_are_dealt_to_groups_by_their_pieces(spark):
    frame = documents(spark, [(1, prose(1, 4000)), (2, prose(2, 4000))])
    got = rows(packing.pack(frame, VOCABULARY, window=64, per_group=10), "doc_id", "sequence_id")
    groups = -(-len(got) // 10)
    # by documents there was one group, whose sequences are numbered without gaps
    assert groups > 10 and {i for _, i in got} != set(range(len({i for _, i in got})))
    assert packing.group_count(packing.pieces(frame, VOCABULARY, window=64), 10) == groups


def test_packing_places_every_token_once(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(VOCABULARY)
    docs = [(i, prose(i, 40 + 37 * i)) for i in range(30)] + [(100, "It's <|endoftext|> <|ENDOFTEXT|> ÉCOLE!! don't 12a3 İx e\u0301 'Tis"), *ODD]
    got = rows(packing.pack(documents(spark, docs), VOCABULARY, window=256, per_group=25), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    wanted = Counter()
    for i, t in docs:
        ids = np.array(reference.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        for s in range(0, len(ids), 256):
            wanted[i, s, min(256, len(ids) - s), zlib.crc32(ids[s : s + 256].tobytes()), len(ids)] += 1
    assert Counter(r[:5] for r in got) == wanted
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r[5], []).append((r[6], r[2]))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert rows(packing.pack(documents(spark, []), VOCABULARY)) == []


# URL rules


def brute_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:end].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[end:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules_match_brute_force(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("a.example.org", "/", "allow"), ("org", "/es/deep/path", "allow"), ("example.org", "", "block"), ("com", "/fr/", "allow"), ("b.com", "/fr", "block")]
    hosts = ["example.org", "a.example.org", "x.a.example.org", "EXAMPLE.org", "ample.org", "b.com", "x.b.com", "com", "net", "", "a..org", "é.org"]
    paths = ["", "/", "/es/", "/es/deep/path/1", "/en/12?x=/es/", "/en/", "/fr/#/de/", "/fr", "?q", "#f"]
    urls = [f"http://{h}{p}" for h, p in itertools.product(hosts, paths)] + [None, "", "no scheme/es/", "a://b://c.org/x", "http://example.org/es/"]
    pages = spark.createDataFrame([(i, u, 1, "k") for i, u in enumerate(urls)] + [(None, None, 1, "k"), (3, urls[3], 1, "k")], "page_id long, url string, range int, key string")
    table = spark.createDataFrame(rules + [(None, "/", "block"), ("org", "/", "block")], "host string, path string, verdict string")
    got = Counter(rows(url_rules.judge_urls(pages, table, ranges=5), "page_id", "host", "path", "rule", "verdict"))
    want = Counter((i, *brute_verdict(u, rules)) for i, u in [*enumerate(urls), (None, None), (3, urls[3])])
    assert got == want
    assert rows(url_rules.judge_urls(pages.limit(0), table)) == []
    assert {r[0] for r in rows(url_rules.judge_urls(pages, table.limit(0)), "verdict")} == {"allow"}


def test_url_rules_of_very_long_hosts(spark):
    """A host of 16,000 labels has no more keys than the longest rule host has labels."""
    rules = [("org", "/", "allow"), ("b.a.org", "/x", "block")]
    urls = ["http://" + "a." * 16_000 + "org/x", "http://" + "c." * 8_000 + "b.a.org/xy", "http://" + "." * 9_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = rows(url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")), "page_id", "rule", "verdict")
    assert sorted(got) == [(i, *brute_verdict(u, rules)[2:]) for i, u in enumerate(urls)]


# Jaccard join


def brute_components(docs):
    sets = {}
    for k, (i, t) in enumerate(docs):
        w = words((t or "").encode())
        sets[k] = (i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[root(a)] = root(b)
    least = {}
    for k in sets:
        least[root(k)] = min(least.get(root(k), sets[k][0]), sets[k][0])
    return {sets[k][0]: (len(sets[k][1]), least[root(k)]) for k in sets}


def near_copies(seed, n, edits, words_=150):
    import random

    base = prose(seed, words_).split()
    out = []
    for i in range(n):
        r = random.Random(seed * 1000 + i)
        t = list(base)
        for _ in range(edits):
            t[r.randrange(len(t))] = f"edit{r.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("chunk", [1_500_000, 1500])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK_SHINGLES", chunk)
    monkeypatch.setattr(jaccard_join, "BLOCK_HASHES", 4000)
    monkeypatch.setattr(jaccard_join, "BUCKET_HASHES", 3000)
    texts = [prose(i, 150) for i in range(30)] + near_copies(500, 25, 2) + near_copies(501, 20, 5) + near_copies(502, 12, 8, 80)
    texts += [texts[3], texts[3].upper(), texts[4], "a b", "A b", "a b c d e", "a b c d e", "a b c d f", "a b c", "", None]
    docs = [(1000 - i, t) for i, t in enumerate(texts)]
    got = {r[0]: r[1:] for r in rows(jaccard_join.join_near(documents(spark, docs)), "doc_id", "n_shingles", "component_id")}
    assert got == brute_components(docs)


def test_jaccard_join_of_odd_rows(spark):
    got = rows(jaccard_join.join_near(documents(spark, ODD + [(5, "a text without an id")])), "doc_id", "n_shingles", "component_id")
    assert len(got) == len(ODD) + 1
    assert (None, 1, 5) in got and (7, 0, 7) in got and (None, 0, None) in got and got.count((10, 1, 10)) == 2
    assert rows(jaccard_join.join_near(documents(spark, []))) == []


@pytest.mark.parametrize("long", [2048, 5])
def test_divide_skip_finds_all_partners(monkeypatch, long):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", long)
    sets = [np.unique(runs_of(np.array([hash(w) & (2**63 - 1) for w in t.split()], np.uint64), 5)) for t in near_copies(7, 30, 4) + near_copies(8, 30, 6)]
    index = jaccard_join.InvertedLists(sets)
    for number, q in enumerate(sets):
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))]
        assert sorted(index.partners(number).tolist()) == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    got = dict(rows(components.connected(spark.createDataFrame(links, "a long, b long"))))
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)} | {199: 199, 200: 199}


# quality


def test_quality_shrinks_sites_and_rejects_junk(spark):
    docs, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        text = " ".join(f"{w.upper()}!!" for w in prose(i, 60).split()) if bad else prose(i, 60)
        docs.append((i, text))
        if i < 200:
            labels.append((i, int(not bad)))
    judged = quality.judge(documents(spark, docs + ODD), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, quality int"))
    got = {r[0]: r[1:] for r in rows(judged, "doc_id", "keep", "site_rate")}
    assert sum(got[i][0] == (i % 5 != 0) for i in range(300)) >= 295
    assert all(0 < r < 1 for _, r in got.values()) and judged.count() == len(docs) + len(ODD)
    assert rows(quality.judge(documents(spark, []), spark.createDataFrame([], "doc_id long, quality int"))) == []


def test_sparse_sites_stay_near_the_global_rate(spark):
    evidence = [("big", "p", 1.0)] * 900 + [("big", "q", 0.0)] * 100 + [("tiny", "p", 0.0)] + [(f"h{i}", "p", float(i % 2)) for i in range(40) for _ in range(20)]
    got = {(r[0], r[1]): r[2:] for r in rows(quality.site_rates(spark.createDataFrame(evidence, "host string, path string, good double")))}
    whole = got["big", "p"][0]
    assert got["big", "p"][2] > 0.95 and got["big", "q"][2] < 0.3
    assert abs(got["tiny", "p"][2] - whole) < abs(0.0 - whole)


# exact search


def test_exact_search_matches_brute_force(spark):
    r = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in r.normal(0, 0.3, 8)]) for i in range(60)] + [(60, None), (61, [1.0] * 7 + [None]), (62, [float("nan")] * 8), (63, [float("inf")] * 8), (64, [0.0] * 8), (65, [1.0, 2.0]), (66, []), (None, [1.0] * 8), (5, [0.1] * 8)]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in vectors], "vec_id long, embedding array<double>, id long, score int")
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for block in (32 << 20, 200):
        got = Counter(rows(exact_search.search(df.filter("vec_id % 4 = 0"), df, k=5, block_bytes=block), "query_id", "rank", "vec_id", "score"))
        want = Counter()
        for q, w in sound:
            if q % 4 == 0:
                best = sorted((-sum(a * b for a, b in zip(w, x)), i) for i, x in sound if i != q and len(x) == len(w))[:5]
                want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
        assert got == want
    assert rows(exact_search.search(df.limit(0), df)) == [] and rows(exact_search.search(df.filter("vec_id % 4 = 0"), df.limit(0))) == []


# chat formatting


def test_chats_make_the_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>[\\INST]", "<s", "[/INST", "", None, "[[INST]]</s></s>", "<</s>", "back\\slash <\\", "$1\\2 漢字"]
    turns = [(1, n, ["user", "assistant", "system"][n % 3], t, "x", 1) for n, t in enumerate(hard)]
    turns += [(2, 0, None, "no role", "x", 1), (2, None, "assistant", "a", "x", 1), (2, 0, "<s>[INST]", "role", "x", 1), (None, 1, "assistant", "b", "x", 1), (3, 1, "user", "u", "x", 1), (3, 1, "user", "u", "x", 1)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, turns string, formatted int")
    done = chat_format.format_chats(df)
    got = {r[0]: r[1:] for r in rows(done.withColumn("loss", chat_format.loss_text(done["formatted"], done["loss_spans"])), "conv_id", "turns", "formatted", "loss")}
    assert [tuple(t) for t in got[1][0]] == [(r, t or "") for _, _, r, t, _, _ in turns[:11]]
    assert got[1][2] == "".join(t or "" for _, _, r, t, _, _ in turns[:11] if r == "assistant")
    assert got[1][1].count("</s>") == 11 and got[1][1].count("<s>[INST]") == 11
    assert [tuple(t) for t in got[2][0]] == [("assistant", "a"), ("", "no role"), ("<s>[INST]", "role")]
    assert got[None][2] == "b" and len(got[3][0]) == 2
    assert rows(chat_format.format_chats(df.limit(0))) == []


# decontamination


def brute_leaks(docs, items):
    import re
    import unicodedata

    letter = lambda c: unicodedata.category(c)[0] in "LN"
    cut = lambda t: re.sub(r"\s+", " ", "".join(c if letter(c) else " " for c in (t or "").lower())).split()
    out = set()
    for (i, t), (k, b) in itertools.product(docs, items):
        w, v = cut(t), cut(b)
        s, u = [tuple(w[j : j + 5]) for j in range(len(w) - 4)], Counter(tuple(v[j : j + 5]) for j in range(len(v) - 4))
        m = sum(u.values())
        for start in range(len(s)) if m else ():
            have = Counter(s[start : start + m])
            if 100 * sum((have & u).values()) >= 75 * sum((have | u).values()):
                out.add((i, k))
    return out


def test_leaks_match_brute_force(spark):
    items = [(i, prose(900 + i, 14 + 5 * i)) for i in range(8)] + [(50, "too short item"), (51, None), (52, ""), (53, "again and again and again and again and again and again")]
    docs = [(i, prose(i, 150)) for i in range(10)]
    docs += [(20 + i, prose(i, 60) + " " + items[i][1].upper().replace(".", " ;") + " " + prose(i + 40, 60)) for i in range(8)]
    edited = items[7][1].split()
    edited[20] = "changed"
    docs += [(40, prose(3, 30) + " " + " ".join(edited)), (41, items[4][1]), (42, " ".join(items[5][1].split()[:20])), (43, "again and again and again and again and again and again and more"), *ODD]
    df, bench = documents(spark, docs), spark.createDataFrame(items + [items[0]], "item_id long, text string")
    got = set(rows(decontamination.find_leaks(df, bench), "doc_id", "item_id"))
    assert got == brute_leaks(docs, items) and (40, 7) in got and len(got) >= 11
    kept = [r[0] for r in rows(decontamination.remove_leaks(df, bench), "doc_id")]
    assert sorted(map(str, kept)) == sorted(str(i) for i, _ in docs if i not in {d for d, _ in got})
    assert rows(decontamination.find_leaks(df.limit(0), bench)) == [] and rows(decontamination.find_leaks(df, bench.limit(0))) == []
