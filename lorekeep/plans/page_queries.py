"""Queries over crawled pages and documents: addresses, robots rules, frontier, text and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import normalize_line, normalize_text, scrub, truncate_text
from lorekeep.functions.urls import ascii_host, normalize_url, url_host, url_origin, url_path
from lorekeep.operators import chunking, crawl, documents, website
from lorekeep.plans.catalog import query, table, text_list
from lorekeep.settings import ChunkSettings
from lorekeep.sources import pages as sources

CONFIG = (
    "id string, type string, enabled boolean, start_urls array<string>, sitemaps array<string>, include array<string>, "
    "exclude array<string>, allowed_hosts array<string>, max_depth int, max_pages int, rate double"
)
NORM = """regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '')"""
# the sample's addresses: an optional ?page=2&ref=x or ?utm_source=feed, an optional fragment, an optional slash
NORMALIZED = f"""(regexp_replace({NORM}, '/+$', '') || CASE WHEN contains(url, '?page=2') THEN '?page=2' ELSE '' END)"""
N = f"n AS (SELECT page_id, {NORMALIZED} AS url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM pages)"
PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"


def page_urls(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", normalize_url("url").alias("url"))


def hosted(spark, d) -> DataFrame:
    return page_urls(spark, d).withColumns({"host": url_host(F.col("url")), "origin": url_origin(F.col("url")), "path": url_path(F.col("url"))})


def source_config(spark, d) -> DataFrame:
    """One source per top-level domain of the sample, each with its first address as a start."""
    domain = F.regexp_extract("host", r"(example\.[a-z]+)$", 1)
    return (
        hosted(spark, d)
        .groupBy(domain.alias("domain"))
        .agg(F.min("url").alias("start"))
        .select(
            F.col("domain").alias("id"),
            F.lit("website").alias("type"),
            (F.col("domain") != "example.none").alias("enabled"),
            F.array("start").alias("start_urls"),
            F.array(F.concat(F.lit("https://www."), "domain", F.lit("/sitemap.xml"))).alias("sitemaps"),
            F.array().cast("array<string>").alias("include"),
            F.array(F.lit("/fr/"), F.lit(r"\.html$")).alias("exclude"),
            F.array(F.upper("domain")).alias("allowed_hosts"),
            F.lit(2).alias("max_depth"),
            F.lit(100000).alias("max_pages"),
            F.lit(2.0).cast("double").alias("rate"),
        )
    )


def sitemap_files(spark, d) -> DataFrame:
    """Sitemap files of at most a thousand entries per host, and an index per host that lists them."""
    rows = page_urls(spark, d).join(table(spark, d, "pages").select("page_id", F.col("url").alias("raw")), "page_id")
    rows = rows.select(url_host(F.col("url")).alias("host"), F.floor(F.col("page_id") / 1000).alias("part"), "raw")
    name = F.concat(F.lit("https://"), "host", F.lit("/sitemap-"), F.col("part").cast("string"), F.lit(".xml"))
    entry = F.concat(F.lit("<url><loc> "), F.replace("raw", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    files = rows.groupBy("host", "part").agg(F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("body"))
    lists = files.select("host", name.alias("url"), F.concat(F.lit("<urlset>"), "body", F.lit("</urlset>")).alias("xml"))
    index = lists.groupBy("host").agg(
        F.concat(
            F.lit("<sitemapindex >"),
            F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<loc>"), "url", F.lit("</loc>")))), ""),
            F.lit("<loc>https://gone.example.com/missing.xml</loc></sitemapindex>"),
        ).alias("xml")
    )
    roots = index.select(F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("url"), "xml")
    return lists.select("url", "xml").unionByName(roots)


@query("src1_scan_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def src1(spark, d):
    return sources.scan_pages(spark, f"{d}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("chars"))


@query(
    "src2_fetch_gate",
    """SELECT page_id FROM pages WHERE NOT contains(url, '/fr/') AND NOT contains(url, 'www.') AND strlen(html) <= 5000000""",
)
def src2(spark, d):
    fetched = table(spark, d, "pages").withColumns(
        {
            "status": F.when(F.contains("url", F.lit("/fr/")), 404).otherwise(200),
            "content_type": F.when(F.contains("url", F.lit("www.")), "application/pdf").otherwise("Text/HTML; charset=utf-8"),
        }
    )
    return sources.fetch_gate(fetched).select("page_id")


@query(
    "src3_sitemap_entries",
    f"""WITH {N} SELECT 'https://' || host || '/sitemap-' || CAST(page_id // 1000 AS BIGINT) || '.xml' AS sitemap, url AS loc, false AS is_index FROM n GROUP BY ALL
        UNION ALL SELECT DISTINCT 'https://' || host || '/sitemap.xml', 'https://' || host || '/sitemap-' || CAST(page_id // 1000 AS BIGINT) || '.xml', true FROM n
        UNION ALL SELECT DISTINCT 'https://' || host || '/sitemap.xml', 'https://gone.example.com/missing.xml', true FROM n""",
)
def src3(spark, d):
    return sources.sitemap_entries(sitemap_files(spark, d)).select("sitemap", "loc", "is_index")


@query("src4_sitemap_expand", f"WITH {N} SELECT url, 1 AS first_depth FROM n WHERE NOT contains(host, 'www.') GROUP BY url")
def src4(spark, d):
    files = sitemap_files(spark, d)
    roots = files.filter(F.col("url").endswith("/sitemap.xml") & ~F.contains("url", F.lit("www.")))
    return sources.sitemap_expand(roots.select("url"), files)


@query("src5_select_sources", f"WITH {N} SELECT regexp_extract(host, '(example\\.[a-z]+)$', 1) AS id, min(url) AS start FROM n GROUP BY 1")
def src5(spark, d):
    return sources.select_sources(source_config(spark, d)).select("id", F.get("start_urls", F.lit(0)).alias("start"))


@query(
    "src5_source_errors",
    "SELECT DISTINCT source AS id, CASE WHEN lang = 'fr' THEN 'unknown type' ELSE 'duplicate id' END AS error FROM documents "
    "WHERE lang = 'fr' OR source IN (SELECT source FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source HAVING count(*) > 1)",
)
def src5_errors(spark, d):
    config = table(spark, d, "documents").select("source", "lang").distinct().select(
        F.col("source").alias("id"),
        F.when(F.col("lang") == "fr", "ftp").otherwise("website").alias("type"),
        F.lit(True).alias("enabled"),
        F.array(F.lit("https://a.example/")).alias("start_urls"),
        F.array().cast("array<string>").alias("sitemaps"),
    )
    return sources.source_errors(config).distinct()


DOC = """doc AS (SELECT doc_id, source, lang, text AS raw,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text
  FROM documents)"""
MADE = f"""{DOC}, made AS (SELECT doc_id, source, lang, 'Document ' || doc_id AS title, text,
  'doc_' || sha256('main' || chr(0) || source || chr(0) || 'kb/' || doc_id)[1:32] AS id,
  'sha256:' || sha256('Document ' || doc_id || chr(0) || text) AS content_hash,
  CASE WHEN lang = 'fr' THEN 'guide' ELSE 'page' END AS content_type FROM doc WHERE text <> '')"""


def drafts(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id",
        F.lit("main").alias("site_id"),
        F.col("source").alias("source_id"),
        F.lit("table").alias("source_type"),
        F.concat(F.lit("kb/"), "doc_id").alias("reference"),
        F.lit(None).cast("string").alias("url"),
        F.concat(F.lit("Document "), "doc_id").alias("title"),
        "text",
        F.when(F.col("lang") == "fr", "guide").when(F.col("lang") == "de", "sale").alias("content_type"),
        F.col("lang").alias("locale"),
        F.lit(None).cast("timestamp").alias("retrieved_at"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("none"), F.lit(None).cast("string")).alias("metadata"),
    )


def made_documents(spark, d) -> DataFrame:
    return documents.create_document(drafts(spark, d))[0]


@query(
    "src6_preview",
    f"""WITH {MADE} SELECT source AS source_id, doc_id, upper(content_type) AS content_type, title, 'kb/' || doc_id AS url, content_hash[1:20] AS hash,
        length(text) AS chars, text[1:300] || '…' AS excerpt, shown FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS shown FROM made) WHERE shown <= 10""",
)
def src6(spark, d):
    shown = sources.preview(made_documents(spark, d), "doc_id")
    return shown.select("source_id", "doc_id", "content_type", "title", "url", "hash", F.col("chars").cast("long").alias("chars"), "excerpt", F.col("shown").cast("long").alias("shown"))


@query("cr1_normalize_url", f"WITH {N} SELECT page_id, url FROM n")
def cr1(spark, d):
    return page_urls(spark, d)


@query("cr1_international_hosts", f"WITH {N} SELECT page_id, replace(url, '://', '://xn--bcher-kva.') AS url FROM n")
def cr1_international(spark, d):
    """Every page's address below a host name in another script."""
    pages = table(spark, d, "pages").select("page_id", F.replace("url", F.lit("://"), F.lit("://B\u00fccher.")).alias("url"))
    return pages.select("page_id", normalize_url(ascii_host("url")).alias("url"))


LINKS = """l AS (SELECT page_id, url, unnest(hrefs) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages))"""


@query(
    "cr1_relative_links",
    f"""WITH {LINKS} SELECT page_id, href, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS url FROM l
        WHERE regexp_matches(href, '^(/[!-~]+)$') AND NOT regexp_matches(href, '[?#<>"{{}}`^\\\\]|/\\.|/$')""",
)
def cr1_links(spark, d):
    """Links of every page against its address, for the plain spellings that SQL can resolve."""
    parsed = documents.extract_pages(table(spark, d, "pages"))
    links = parsed.select("page_id", "url", F.explode("links").alias("href"))
    plain = F.col("href").rlike(r"^(/[!-~]+)$") & ~F.col("href").rlike(r"[?#<>\"{}`^\\]|/\.|/$")
    return links.filter(plain).select("page_id", "href", normalize_url("href", normalize_url("url")).alias("url"))


@query("cr1_all_links")
def cr1_all_links(spark, d):
    """Every link of every page against its address; null where it is not an http(s) address. Tests compare with brute force."""
    parsed = documents.extract_pages(table(spark, d, "pages"))
    links = parsed.select("page_id", "url", F.explode("links").alias("href"))
    return links.select("page_id", "href", normalize_url("href", normalize_url("url")).alias("url"))


@query("cr2_allowed_hosts", f"WITH {N} SELECT regexp_extract(host, '(example\\.[a-z]+)$', 1) AS id, min(regexp_extract(host, '(example\\.[a-z]+)$', 1)) AS hosts FROM n GROUP BY 1")
def cr2(spark, d):
    return crawl.allowed_hosts(source_config(spark, d)).select("id", text_list("hosts").alias("hosts"))


@query(
    "cr3_url_filter",
    f"""WITH {N} SELECT page_id, s.id AS source_id FROM n JOIN (SELECT DISTINCT regexp_extract(host, '(example\\.[a-z]+)$', 1) AS id FROM n) s
        ON (n.host = s.id OR ends_with(n.host, '.' || s.id)) WHERE NOT contains(url, '/fr/') AND NOT ends_with(url, '.html')""",
)
def cr3(spark, d):
    """Every page offered to the source of its own domain."""
    config = crawl.allowed_hosts(source_config(spark, d))
    urls = hosted(spark, d).withColumn("source_id", F.regexp_extract("host", r"(example\.[a-z]+)$", 1))
    return crawl.url_filter(urls, config).select("page_id", "source_id")


def robots_files(spark, d) -> DataFrame:
    """A robots file per origin, its rules depending on the host."""
    host = F.regexp_extract("origin", "//(.*)", 1)
    general = F.concat(
        F.lit("# rules\nUser-agent: other\nUser-Agent: *\nDisallow: /fr/\nAllow: /fr/8 # some\nDisallow:\nCrawl-delay: 1\nCrawl-delay: "),
        F.length(host).cast("string"),
        F.lit("\nDisallow: /*.html$\nSitemap: https://"), host, F.lit("/sitemap.xml\n"),
    )
    named = F.lit("User-agent: Lorekeep\nDisallow: /en/1\nDisallow: /es/\n")
    contents = F.when(F.contains(host, F.lit("www.")), F.concat(general, named)).otherwise(general)
    return hosted(spark, d).select("origin").distinct().withColumn("contents", contents)


# what the files above say: hosts with www. name this crawler and replace the general rules
DECIDED = f"""decided AS (SELECT *, {PATH} AS path FROM n), verdict AS (SELECT *, CASE
  WHEN contains(host, 'www.') THEN NOT (starts_with(path, '/en/1') OR starts_with(path, '/es/'))
  WHEN ends_with(path, '.html') AND NOT starts_with(path, '/fr/') THEN false
  WHEN ends_with(path, '.html') THEN false
  WHEN starts_with(path, '/fr/8') THEN true
  WHEN starts_with(path, '/fr/') THEN false ELSE true END AS allowed FROM decided)"""


@query(
    "cr4_robots_rules",
    f"""WITH {N}, o AS (SELECT DISTINCT origin, host FROM n), f AS (
        SELECT origin, unnest(['user-agent','user-agent','disallow','allow','disallow','crawl-delay','crawl-delay','disallow','sitemap']) AS field,
               unnest(['other','*','/fr/','/fr/8','','1',CAST(length(host) AS VARCHAR),'/*.html$','https://' || host || '/sitemap.xml']) AS value, 1 AS "group" FROM o
        UNION ALL SELECT origin, unnest(['user-agent','disallow','disallow']), unnest(['Lorekeep','/en/1','/es/']), 2 FROM o WHERE contains(host, 'www.'))
        SELECT origin, field, value, "group" FROM f""",
)
def cr4(spark, d):
    return crawl.robots_rules(robots_files(spark, d)).select("origin", "field", "value", F.col("group").cast("int").alias("group"))


@query(
    "cr5_robots_group",
    f"""WITH {N}, o AS (SELECT DISTINCT origin, host FROM n)
        SELECT origin, unnest(['/en/1', '/es/']) AS pattern, false AS allow FROM o WHERE contains(host, 'www.')
        UNION ALL SELECT origin, unnest(['/fr/', '/fr/8', '/*.html$']), unnest([false, true, false]) FROM o WHERE NOT contains(host, 'www.')""",
)
def cr5(spark, d):
    return crawl.robots_group(crawl.robots_rules(robots_files(spark, d)))


@query("cr6_robots_decide", f"WITH {N}, {DECIDED} SELECT page_id, allowed FROM verdict")
def cr6(spark, d):
    rules = crawl.robots_group(crawl.robots_rules(robots_files(spark, d)))
    return crawl.robots_decide(hosted(spark, d), rules).select("page_id", "allowed")


def origins_by_domain(spark, d) -> DataFrame:
    return hosted(spark, d).select(F.regexp_extract("host", r"(example\.[a-z]+)$", 1).alias("source_id"), "origin").distinct()


@query(
    "cr7_robots_merge_paths",
    f"""WITH {N}, {DECIDED} SELECT page_id, NOT (ends_with(path, '.html') OR starts_with(path, '/fr/') AND NOT starts_with(path, '/fr/8')
        OR (www AND (starts_with(path, '/en/1') OR starts_with(path, '/es/')))) AS allowed FROM decided
        JOIN (SELECT regexp_extract(host, '(example\\.[a-z]+)$', 1) AS domain, bool_or(contains(host, 'www.')) AS www FROM n GROUP BY 1) s
        ON s.domain = regexp_extract(host, '(example\\.[a-z]+)$', 1)""",
)
def cr7(spark, d):
    files = robots_files(spark, d)
    urls = hosted(spark, d).withColumn("source_id", F.regexp_extract("host", r"(example\.[a-z]+)$", 1))
    rules = crawl.robots_group(crawl.robots_rules(files))
    decided, _ = crawl.robots_merge(urls, origins_by_domain(spark, d), rules, crawl.robots_origins(files))
    return decided.select("page_id", "allowed")


@query(
    "cr7_robots_merge_sources",
    f"""WITH {N} SELECT regexp_extract(host, '(example\\.[a-z]+)$', 1) AS source_id,
        max(CASE WHEN NOT contains(host, 'www.') THEN length(host) END)::DOUBLE AS crawl_delay, count(DISTINCT host) AS sitemaps FROM n GROUP BY 1""",
)
def cr7_sources(spark, d):
    files = robots_files(spark, d)
    rules = crawl.robots_group(crawl.robots_rules(files))
    _, declared = crawl.robots_merge(hosted(spark, d).withColumn("source_id", F.lit("")), origins_by_domain(spark, d), rules, crawl.robots_origins(files))
    return declared.select("source_id", "crawl_delay", F.size("sitemaps").cast("long").alias("sitemaps"))


@query("cr8_effective_rate", f"WITH {N} SELECT page_id, round(CASE WHEN length(host) > 20 THEN least(0.045, 1.0 / length(host)) ELSE 0.045 END, 9)::DOUBLE AS rate FROM n")
def cr8(spark, d):
    delay = F.when(F.length("host") > 20, F.length("host"))
    return hosted(spark, d).select("page_id", F.round(crawl.effective_rate(F.lit(0.045), delay), 9).alias("rate"))


@query(
    "cr9_fetch_schedule",
    f"""WITH {N} SELECT page_id, slot, round((slot - 1) * 500.0, 3)::DOUBLE AS start_ms FROM
        (SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(host, '(example\\.[a-z]+)$', 1) ORDER BY page_id) AS slot FROM n)""",
)
def cr9(spark, d):
    urls = hosted(spark, d).select("page_id", F.regexp_extract("host", r"(example\.[a-z]+)$", 1).alias("source_id"), F.lit(2.0).cast("double").alias("rate"))
    return crawl.fetch_schedule(urls, "page_id", F.floor(F.col("page_id") / 100)).select("page_id", "slot", "start_ms")


SEEDS = f"""s AS (SELECT regexp_extract(host, '(example\\.[a-z]+)$', 1) AS source_id, min(url) AS start FROM n GROUP BY 1),
  seeds AS (SELECT source_id, start AS url FROM s UNION
    SELECT regexp_extract(host, '(example\\.[a-z]+)$', 1), url FROM n WHERE contains(url, '/es/') AND NOT ends_with(url, '.html'))"""


def seeds(spark, d) -> DataFrame:
    config = crawl.allowed_hosts(source_config(spark, d))
    listed = hosted(spark, d).filter(F.contains("url", F.lit("/es/"))).select(
        F.regexp_extract("host", r"(example\.[a-z]+)$", 1).alias("source_id"), "url", F.col("page_id").alias("position")
    )
    return crawl.seed_frontier(config, listed)


@query("cr10_seed_frontier", f"WITH {N}, {SEEDS} SELECT source_id, url, 0 AS depth FROM seeds")
def cr10(spark, d):
    return seeds(spark, d).select("source_id", "url", "depth")


# a link graph over the pages themselves: page i links to pages 2i+1 and 2i+2
@query(
    "cr11_expand_frontier",
    f"""WITH RECURSIVE {N}, {SEEDS}, e AS (SELECT a.url AS page_url, b.url AS href FROM n a JOIN n b ON b.page_id IN (2 * a.page_id + 1, 2 * a.page_id + 2)
          WHERE NOT contains(b.url, '/fr/') AND NOT ends_with(b.url, '.html')),
        walk(source_id, url, depth) AS (SELECT source_id, url, 0 FROM seeds UNION
          SELECT w.source_id, e.href, w.depth + 1 FROM walk w JOIN e ON e.page_url = w.url
          WHERE w.depth < 2 AND ends_with(regexp_extract(e.href, '^https?://([^/?#]+)', 1), '.' || w.source_id))
        SELECT source_id, url, min(depth) AS depth FROM walk GROUP BY 1, 2""",
)
def cr11(spark, d):
    config = crawl.allowed_hosts(source_config(spark, d))
    return crawl.expand_frontier(seeds(spark, d), page_graph(spark, d), config).select("source_id", "url", "depth")


def page_graph(spark, d) -> DataFrame:
    """Page i links to pages 2i+1 and 2i+2: page_url, position, href."""
    urls = page_urls(spark, d)
    target = urls.select(F.col("page_id").alias("to"), F.col("url").alias("href"))
    return (
        urls.select(F.col("url").alias("page_url"), F.posexplode(F.array(2 * F.col("page_id") + 1, 2 * F.col("page_id") + 2)).alias("position", "to"))
        .join(target, "to")
        .select("page_url", "position", "href")
    )


# the page graph again, with the robots rules of each source's start and twenty pages a source
BUDGET = f"""n0 AS (SELECT *, {PATH} AS path FROM n), r AS (SELECT source_id, start, contains(regexp_extract(start, '^https?://([^/?#]+)', 1), 'www.') AS www FROM s),
  open AS (SELECT DISTINCT r.source_id, url, host FROM n0, r WHERE CASE WHEN www THEN NOT (starts_with(path, '/en/1') OR starts_with(path, '/es/'))
    ELSE NOT (ends_with(path, '.html') OR (starts_with(path, '/fr/') AND NOT starts_with(path, '/fr/8'))) END),
  f0 AS (SELECT source_id, url, min(place) AS place FROM (SELECT source_id, start AS url, -1 AS place FROM s
    UNION ALL SELECT regexp_extract(host, '(example\\.[a-z]+)$', 1), url, page_id FROM n WHERE contains(url, '/es/') AND NOT ends_with(url, '.html')) GROUP BY 1, 2),
  v0 AS (SELECT source_id, url, 0 AS depth, row_number() OVER (PARTITION BY source_id ORDER BY place, url) AS crawl_seq
    FROM f0 SEMI JOIN open USING (source_id, url) QUALIFY crawl_seq <= 20),
  e AS (SELECT a.url AS page_url, b.url AS href, b.host AS target, b.page_id - 2 * a.page_id AS position FROM n a JOIN n b ON b.page_id IN (2 * a.page_id + 1, 2 * a.page_id + 2)
    WHERE NOT contains(b.url, '/fr/') AND NOT ends_with(b.url, '.html')),
  f1 AS (SELECT source_id, href AS url, min(crawl_seq * 10 + position) AS place FROM v0 JOIN e ON page_url = url
    WHERE (target = source_id OR ends_with(target, '.' || source_id)) AND (source_id, href) NOT IN (SELECT source_id, url FROM f0) GROUP BY 1, 2),
  v1 AS (SELECT source_id, url, 1 AS depth, used + row_number() OVER (PARTITION BY source_id ORDER BY place, url) AS crawl_seq
    FROM f1 SEMI JOIN open USING (source_id, url) JOIN (SELECT source_id, count(*) AS used FROM v0 GROUP BY 1) u USING (source_id) QUALIFY crawl_seq <= 20),
  f2 AS (SELECT source_id, href AS url, min(crawl_seq * 10 + position) AS place FROM v1 JOIN e ON page_url = url
    WHERE (target = source_id OR ends_with(target, '.' || source_id)) AND (source_id, href) NOT IN (SELECT source_id, url FROM f0 UNION SELECT source_id, url FROM f1) GROUP BY 1, 2),
  v2 AS (SELECT source_id, url, 2 AS depth, used + row_number() OVER (PARTITION BY source_id ORDER BY place, url) AS crawl_seq
    FROM f2 SEMI JOIN open USING (source_id, url) JOIN (SELECT source_id, count(*) AS used FROM (SELECT * FROM v0 UNION ALL SELECT * FROM v1) GROUP BY 1) u USING (source_id) QUALIFY crawl_seq <= 20)"""


@query(
    "cr11_rules_and_budget",
    f"WITH {N}, {SEEDS}, {BUDGET} SELECT source_id, url, depth, crawl_seq FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2",
)
def cr11_budget(spark, d):
    """Visit order under the robots rules of the start's origin and a budget of twenty pages a source."""
    config = crawl.allowed_hosts(source_config(spark, d)).withColumns({"max_pages": F.lit(20), "sitemaps": F.array().cast("array<string>")})
    rules = crawl.source_rules(crawl.source_origins(config), crawl.robots_group(crawl.robots_rules(robots_files(spark, d))))
    return crawl.expand_frontier(seeds(spark, d), page_graph(spark, d), config, rules).select("source_id", "url", "depth", "crawl_seq")


def crawled_site(spark, d) -> tuple[DataFrame, DataFrame]:
    """(documents, outcomes) of a crawl from all pages: sitemaps name every address, links come from the pages' text."""
    offered = page_urls(spark, d).join(table(spark, d, "pages").select("page_id", "html"), "page_id")
    parsed = website.read_pages(offered.withColumns({"status": F.lit(200), "content_type": F.lit("text/html")}))
    config = crawl.allowed_hosts(source_config(spark, d))
    listed = hosted(spark, d).select(F.regexp_extract("host", r"(example\.[a-z]+)$", 1).alias("source_id"), "url", F.col("page_id").alias("position"))
    rules = crawl.source_rules(crawl.source_origins(config), crawl.robots_group(crawl.robots_rules(robots_files(spark, d))))
    visited = crawl.expand_frontier(crawl.seed_frontier(config, listed), website.page_links(parsed), config, rules)
    return website.site_documents(visited, parsed, "shop", [("/en/", "guide")])


@query("pages_to_chunks")
def pages_to_chunks(spark, d):
    """Chunks of every document that a crawl of the pages yields; a test compares the steps with plain Python."""
    made, _ = crawled_site(spark, d)
    return chunking.chunk_documents(made, keep=("source_id", "crawl_seq")).select("source_id", "crawl_seq", "document_id", "id", "index", "heading_path", "body", "content_hash")


@query("pages_to_outcomes")
def pages_to_outcomes(spark, d):
    return crawl.crawl_stats(crawled_site(spark, d)[1])


@query("cr12_crawl_dedupe", "SELECT min(doc_id) AS crawl_seq, source AS source_id, md5(text) AS content_hash FROM documents GROUP BY source, text")
def cr12(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("source_id"), F.md5("text").alias("content_hash"), F.col("doc_id").alias("crawl_seq"), "text")
    return crawl.crawl_dedupe(docs).select("crawl_seq", "source_id", "content_hash")


@query(
    "cr13_crawl_stats",
    """WITH o AS (SELECT source, CASE WHEN lang = 'de' THEN 'failed' WHEN coalesce(toxic, 0) = 1 THEN 'noindex' WHEN length(text) < 120 THEN 'short'
         WHEN row_number() OVER (PARTITION BY source, text ORDER BY doc_id) > 1 THEN 'dup' ELSE 'emitted' END AS k FROM documents LEFT JOIN labels USING (doc_id))
       SELECT source AS source_id, count(*) FILTER (k = 'emitted') AS emitted, count(*) FILTER (k IN ('noindex', 'short', 'dup')) AS skipped,
         count(*) FILTER (k = 'failed') AS failed, 0 AS skipped_robots_disallowed, 0 AS skipped_not_fetched_as_a_page,
         count(*) FILTER (k = 'noindex') AS skipped_noindex, count(*) FILTER (k = 'short') AS skipped_too_little_text,
         count(*) FILTER (k = 'dup') AS skipped_duplicate_content FROM o GROUP BY source""",
)
def cr13(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    hashed = docs.select(F.col("source").alias("source_id"), F.md5("text").alias("content_hash"), F.col("doc_id").alias("crawl_seq"))
    first = crawl.crawl_dedupe(hashed).select(F.col("crawl_seq").alias("doc_id"), F.lit(True).alias("first"))
    short = F.when(F.coalesce(F.col("toxic") == 1, F.lit(False)), "noindex").when(F.length("text") < 120, "too little text").when(F.col("first").isNull(), "duplicate content")
    outcomes = docs.join(first, "doc_id", "left").select(
        F.col("source").alias("source_id"),
        F.when(F.col("lang") == "de", "failed").when(short.isNotNull(), "skipped").otherwise("emitted").alias("outcome"),
        short.alias("reason"),
    )
    return crawl.crawl_stats(outcomes)


@query(
    "doc1_extract_pages",
    r"""SELECT page_id, regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS title,
        regexp_extract(html, '<html lang="([^"]*)"', 1) AS locale, false AS noindex, len(regexp_extract_all(html, '<a href="[^"]+"')) AS links FROM pages""",
)
def doc1(spark, d):
    parsed = documents.extract_pages(table(spark, d, "pages"), ["page_id"])
    return parsed.select("page_id", "title", "locale", "noindex", F.size("links").cast("long").alias("links"))


@query("doc2_doc3_page_text")
def doc2(spark, d):
    """Readable text of every page without its furniture."""
    parsed = documents.extract_pages(table(spark, d, "pages"), ["page_id"])
    return parsed.select("page_id", F.length("text").alias("chars"), F.md5("text").alias("text"))


NOISY = "(text || chr(173) || '  ' || chr(9) || ' x' || chr(8203) || 'y' || chr(13) || chr(10) || chr(13) || chr(10) || ' ' || chr(10) || chr(10) || 'e' || chr(769) || chr(8195) || 'z' || chr(7))"


def noisy() -> Column:
    tail = "\u00ad  \t x\u200by\r\n\r\n \n\ne\u0301\u2003z\x07"
    return F.concat("text", F.lit(tail))


DELETED = r"[\x{00AD}\x{200B}\x{200C}\x{200D}\x{FEFF}\x00-\x08\x0B-\x1F\x7F]"
FOLDED = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
TIDY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(%s, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def scrub_sql(expression: str) -> str:
    return f"regexp_replace(regexp_replace({expression}, '{DELETED}', '', 'g'), '{FOLDED}', ' ', 'g')"


@query("doc4_scrub", f"SELECT doc_id, md5({scrub_sql(NOISY)}) AS text FROM documents")
def doc4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(scrub(noisy())).alias("text"))


NORMAL = TIDY % scrub_sql(f"nfc_normalize({NOISY})")


@query("doc5_normalize_text", f"SELECT doc_id, md5({NORMAL}) AS text FROM documents")
def doc5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(normalize_text(noisy())).alias("text"))


@query("doc6_normalize_line", f"SELECT doc_id, md5(regexp_replace({NORMAL}, '\\n+', ' ', 'g')) AS text FROM documents")
def doc6(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(normalize_line(noisy())).alias("text"))


@query(
    "doc7_truncate_text",
    """WITH t AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents), c AS (SELECT *, text[1:1000] AS clip FROM t),
       b AS (SELECT *, strpos(reverse(clip), chr(10) || chr(10)) AS tail FROM c)
       SELECT doc_id, md5(CASE WHEN length(text) <= 1000 THEN text WHEN tail > 0 AND length(clip) - tail - 1 > 500 THEN clip[1:length(clip) - tail - 1] ELSE clip END) AS text FROM b""",
)
def doc7(spark, d):
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(truncate_text(text, 1000)).alias("text"))


@query(
    "doc8_indexable",
    """SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0
       AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 120""",
)
def doc8(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return documents.indexable(docs.withColumn("noindex", F.coalesce(F.col("toxic") == 1, F.lit(False)))).select("doc_id")


@query(
    "doc9_resolve_canonical",
    f"""WITH {N} SELECT page_id, CASE WHEN contains(url, '/en/') THEN origin || '/doc/' || page_id WHEN contains(url, '/fr/') THEN url
        WHEN contains(url, '/es/') THEN origin || '/x' ELSE url END AS url FROM n""",
)
def doc9(spark, d):
    url = F.col("url")
    declared = (
        F.when(F.contains(url, F.lit("/en/")), F.concat(F.lit("/doc/"), "page_id", F.lit("/?utm_campaign=z#top")))
        .when(F.contains(url, F.lit("/fr/")), F.lit("https://elsewhere.example.org/y"))
        .when(F.contains(url, F.lit("/es/")), F.concat("origin", F.lit("/a/../x")))
    )
    return hosted(spark, d).select("page_id", documents.resolve_canonical(declared, url).alias("url"))


@query(
    "doc10_classify",
    f"""WITH {N} SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'guide' WHEN ends_with(url, '.html') THEN 'blog' WHEN contains(url, '/fr/') THEN 'policy' ELSE 'page' END AS content_type FROM n""",
)
def doc10(spark, d):
    rules = [("/en/", "guide"), (r"\.html$", "blog"), ("/(fr|en)/", "policy")]
    return page_urls(spark, d).select("page_id", documents.classify(F.col("url"), rules, F.lit("page")).alias("content_type"))


@query(
    "doc11_build_metadata",
    """SELECT p_partkey, 'description=' || p_name || CASE WHEN p_size > 10 THEN '|size=' || p_size ELSE '' END AS metadata FROM part""",
)
def doc11(spark, d):
    built = documents.build_metadata(
        description=F.col("p_name"),
        size=F.when(F.col("p_size") > 10, F.col("p_size")),
        weight=documents.scalar(F.lit(float("nan"))),
    )
    pairs = F.transform(F.array_sort(F.map_entries(built)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, d, "part").select("p_partkey", F.array_join(pairs, "|").alias("metadata"))


@query("doc12_create_document", f"WITH {MADE} SELECT doc_id, id, content_hash, content_type, title, 'lang' AS metadata FROM made")
def doc12(spark, d):
    return made_documents(spark, d).select("doc_id", "id", "content_hash", "content_type", "title", text_list(F.map_keys("metadata")).alias("metadata"))


@query("doc12_rejects", f"WITH {DOC} SELECT 'kb/' || doc_id AS reference, 'no text' AS reason FROM doc WHERE text = '' OR lang = 'es'")
def doc12_rejects(spark, d):
    broken = drafts(spark, d).withColumn("text", F.when(F.col("locale") == "es", " \n ").otherwise(F.col("text")))
    return documents.create_document(broken)[1].select("reference", "reason")


def sectioned(spark, d) -> DataFrame:
    """Documents whose every further line becomes a section of its own."""
    return made_documents(spark, d).select(
        "doc_id", "id", "title", F.replace("text", F.lit("\n"), F.lit("\n\n## Section\n\n")).alias("text")
    )


WIDE = ChunkSettings(max_chunk_characters=10_000_000, min_chunk_characters=0, overlap_characters=0)
SECTIONS = f"""{MADE}, lines AS (SELECT doc_id, id, title, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS index FROM made),
  ch AS (SELECT doc_id, id AS document_id, index, title, CASE WHEN index = 0 THEN '' ELSE 'Section' END AS path,
    CASE WHEN index = 0 THEN line WHEN line = '' THEN '## Section' ELSE '## Section' || chr(10) || chr(10) || line END AS body FROM lines)"""


def section_chunks(spark, d) -> DataFrame:
    return chunking.chunk_documents(sectioned(spark, d), WIDE, ("doc_id",))


@query(
    "ch5_chunk_sections",
    f"""WITH {SECTIONS} SELECT doc_id, document_id || '#' || index AS id, index, md5(body) AS body, path AS heading_path,
        'sha256:' || sha256(title || CASE WHEN path = '' THEN '' ELSE ' > ' || path END || chr(10) || chr(10) || body) AS content_hash FROM ch""",
)
def ch5(spark, d):
    return section_chunks(spark, d).select(
        "doc_id", "id", F.col("index").cast("long").alias("index"), F.md5("body").alias("body"), text_list("heading_path").alias("heading_path"), "content_hash"
    )


@query(
    "ch7_chunk_prefix",
    "SELECT doc_id, lang || CASE WHEN source <> lang THEN ' > ' || source ELSE '' END || chr(10) || chr(10) AS prefix FROM documents",
)
def ch7(spark, d):
    return table(spark, d, "documents").select("doc_id", chunking.chunk_prefix(F.col("lang"), F.array("source", "lang", F.lit(""))).alias("prefix"))


@query("ch8_chunk_documents")
def ch8(spark, d):
    """Whole documents with the default sizes and overlap."""
    cut = chunking.chunk_documents(made_documents(spark, d), ChunkSettings(), ("doc_id",))
    return cut.select("doc_id", "id", "index", F.length("body").alias("chars"), "content_hash")


@query(
    "ch9_corpus_audit",
    f"""WITH {SECTIONS} SELECT count(*) AS chunks, round(avg(length(body)), 2) AS mean_length, round(avg((path <> '')::INT), 4) AS heading_path_share,
        0.0::DOUBLE AS multi_topic_share, count(DISTINCT body) AS distinct_bodies, round(1 - count(DISTINCT body) / count(*), 4) AS repeated_share FROM ch""",
)
def ch9(spark, d):
    return chunking.corpus_audit(section_chunks(spark, d))


@query(
    "ch10_boilerplate_sections",
    f"""WITH {SECTIONS} SELECT path AS section, count(*) AS chunks, count(DISTINCT document_id) AS documents, count(DISTINCT body) AS distinct_bodies
        FROM ch WHERE path <> '' GROUP BY path HAVING count(DISTINCT document_id) >= 10""",
)
def ch10(spark, d):
    return chunking.boilerplate_sections(section_chunks(spark, d), 10)
