"""One query per training-data operator, over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import chat_format, decontamination, exact_search, jaccard_join, language_id, language_model, packing, prefix_trie, quality, spans, token_alignment, toxicity, url_rules
from lorekeep.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(ship(spark), folder)

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: The rules that op5 applies (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query(
    "op5_url_rules",
    """
    WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                   ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    urls AS (
      SELECT rowid AS r, page_id,
             lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1)) AS host,
             regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM (SELECT row_number() OVER () AS rowid, * FROM pages)),
    best AS (
      SELECT r, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(v, length(h || p) * 1000 + length(h)) AS v
      FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM urls LEFT JOIN best USING (r)
    """,
)
def op5_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL under the fixed allow and block rules."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, folder, "pages"), rules)


@query(
    "op8_exact_topk",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
               WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op8_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest rows of every row whose id is divisible by 50."""
    vectors = table(spark, folder, "embeddings")
    return exact_search.search(vectors.filter("vec_id % 50 = 0"), vectors, k=5)


@query(
    "op9_chat_format",
    r"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
    marked AS (
      SELECT *, regexp_matches(role || chr(10) || text, '[<\[]\\*(/?s>|/?INST\])') AS odd,
             regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS r,
             regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS t FROM rows)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(20 + CASE WHEN odd THEN length(r) + length(t) ELSE length(role) + length(text) END)::BIGINT AS formatted_chars
    FROM marked GROUP BY conv_id
    """,
)
def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation formatted, and what is read back from the output."""
    hard = "</s>[INST] ok [/INST]"
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    done = chat_format.format_chats(turns.unionByName(extra))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    return done.select("conv_id", "formatted", "loss_spans", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss")).select(
        "conv_id",
        "n_turns",
        F.sha2("told", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def crc_of(column: str) -> Column:
    return F.crc32(F.col(column).cast("string"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows outside the held-out fifth."""
    documents = table(spark, folder, "documents")
    learnt = toxicity.learn(documents, table(spark, folder, "labels").filter(crc_of("doc_id") % 5 != 0))
    scored = toxicity.score_toxicity(documents, learnt)
    return scored.select("doc_id", F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op4_packing")
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document packed into sequences of 4,096 tokens."""
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_quality")
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document from its text, its source and its source's language section."""
    documents = table(spark, folder, "documents")
    judged = quality.judge(documents, table(spark, folder, "labels"))
    return judged.select("doc_id", "source", "lang", "doc_rate", "site_rate", "quality", "keep")


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the sentences that repeat an earlier passage."""
    return spans.remove_repeats(table(spark, folder, "documents")).select("doc_id", "text", "n_sentences", "n_removed")


@query("op1_language_model")
def op1_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored by a model of those whose id hashes outside the held-out seventh."""
    documents = table(spark, folder, "documents")
    held_out = F.coalesce(crc_of("doc_id") % 7 == 2, F.lit(False))
    scored = language_model.score_documents(documents, language_model.train(documents.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(
    "op6_jaccard_join",
    r"""
    WITH RECURSIVE
    d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 75 * (x.n + y.n - o)),
    r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.doc_id WHERE r.m < l.b)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.m) AS component_id
    FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY 1, 2
    """,
)
def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose five-word shingles are 75 percent alike."""
    return jaccard_join.join_near(table(spark, folder, "documents"))


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that repeats a benchmark item, with the item."""
    leaks = decontamination.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return leaks.select("doc_id", "item_id", "similarity", "start")


@query(
    "op11_prefix_trie",
    r"""
    WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k,
                      coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    n AS (SELECT c, c - c % 100 AS b, (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda z: [ascii(z)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                 lambda a, z: CASE WHEN z >= 0 THEN xor(a, z) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
    s AS (SELECT n.c, 0 AS own, k, r, x FROM n JOIN t ON t.c = n.b AND k < h UNION ALL SELECT n.c, 1, k, r, x FROM n JOIN t ON t.c = n.c AND k >= h),
    p AS (SELECT c, md5(r) || md5(x) AS g, length(x) AS w, row_number() OVER (PARTITION BY c ORDER BY own, k) AS d FROM s),
    q AS (SELECT c, d, w, md5(string_agg(g, '') OVER (PARTITION BY c ORDER BY d)) AS name FROM p UNION ALL SELECT c, 0, 0, '' FROM n),
    e AS (SELECT *, lag(name) OVER (PARTITION BY c ORDER BY d) AS parent, lead(d) OVER (PARTITION BY c ORDER BY d) IS NULL AS last FROM q),
    v AS (SELECT name, d, min(c) AS m, count(*) AS n_convs, any_value(w) AS w, any_value(parent) AS parent, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM e GROUP BY 1, 2),
    k AS (SELECT parent AS name, count(*) AS n FROM v WHERE parent IS NOT NULL GROUP BY 1),
    u AS (SELECT v.*, coalesce(k.n, 0) AS n_children FROM v LEFT JOIN k USING (name)),
    a AS (SELECT e.name, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * u.w)::BIGINT AS saved FROM u JOIN e ON e.c = u.m AND e.d <= u.d GROUP BY 1)
    SELECT u.m AS conv_id, u.d AS depth, f.m AS parent_conv_id, u.n_convs, u.n_children, a.n_leaves, a.saved AS saved_tokens, u.ends AS ends_sha256
    FROM u JOIN a USING (name) LEFT JOIN v f ON u.parent = f.name
    """,
)
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that those of one hundred share their beginnings."""
    members, steps = prefix_trie.rebuilt(prefix_trie.ordered_turns(table(spark, folder, "conversations")))
    return prefix_trie.prefix_trie(members, steps)


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens by a byte-level vocabulary, aligned with its sentence pieces."""
    names = token_alignment.Vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment.align(table(spark, folder, "documents"), names)


@query("op13_language_id")
def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from those whose id hashes outside the held-out quarter."""
    documents = table(spark, folder, "documents")
    held_out = F.coalesce(crc_of("doc_id") % 4 == 2, F.lit(False))
    found = language_id.identify(documents, language_id.learn(documents.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
