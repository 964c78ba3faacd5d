"""From pages to documents, against plain Python over a small site."""

from pyspark.sql import functions as F

from lorekeep.operators import chunking, crawl, website

LONG = "A sentence about the shop and what it sells, long enough to be kept. " * 3


def page(text, links=(), head=""):
    anchors = "".join(f'<nav><a href="{u}">x</a></nav>' for u in links)
    return f"<html><head><title>T</title>{head}</head><body>{anchors}<main><h1>Head</h1><p>{text}</p></main></body></html>"


PAGES = [
    (1, "https://a.example/", page(LONG, ["/one", "two", "/private/x", "https://b.example/", "/gone", "/one#part"]), 200, "text/html"),
    (2, "https://a.example/one", page(LONG + "One.", ["/three"]), 200, "text/html; charset=utf-8"),
    (3, "https://a.example/two", page(LONG), 200, None),  # the text of page 1
    (4, "https://a.example/three", page("short"), 200, "text/html"),
    (5, "https://a.example/private/x", page(LONG + "Private."), 200, "text/html"),
    (6, "https://a.example/gone", page(LONG + "Gone."), 404, "text/html"),
    (7, "https://a.example/hidden", page(LONG + "Hidden.", head='<meta name="robots" content="noindex">'), 200, "text/html"),
    (8, "https://b.example/", page(LONG + "Other host."), 200, "text/html"),
    (9, "https://a.example/one", page(LONG + "Fetched again."), 200, "text/html"),
    (10, None, page(LONG + "Nowhere."), 200, "text/html"),
    (11, "https://a.example/null", None, 200, "text/html"),
    (12, "https://a.example/four", page(LONG + "Four.", head='<link rel="canonical" href="/fourth">'), 200, "text/html"),
]


def crawled(spark, max_pages=50, rows=PAGES):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, status int, content_type string")
    source = ("s", ["https://a.example/"], [], [], [r"\.pdf$"], ["a.example"], 2, max_pages)
    config = spark.createDataFrame([source], "id string, start_urls array<string>, sitemaps array<string>, include array<string>, exclude array<string>, hosts array<string>, max_depth int, max_pages int")
    listed = spark.createDataFrame([("s", "https://a.example/hidden", 5), ("s", "https://a.example/four", 6), ("s", "https://a.example/x.pdf", 7)], "source_id string, url string, position int")
    robots = spark.createDataFrame([("https://a.example", "User-agent: *\nDisallow: /*vate/\nAllow: /")], "origin string, contents string")
    rules = crawl.source_rules(crawl.source_origins(config), crawl.robots_group(crawl.robots_rules(robots)))
    parsed = website.read_pages(pages)
    visited = crawl.expand_frontier(crawl.seed_frontier(config, listed), website.page_links(parsed), config, rules)
    return visited, *website.site_documents(visited, parsed, "shop", [("/one$", "guide")])


def test_site_documents(spark):
    visited, made, outcomes = crawled(spark)
    order = ["", "hidden", "four", "one", "two", "gone", "three"]  # seeds, then links by page and place
    assert [(r["url"], r["crawl_seq"]) for r in visited.orderBy("crawl_seq").collect()] == [(f"https://a.example/{p}", i + 1) for i, p in enumerate(order)]
    told = {r["url"].rsplit("/", 1)[1]: (r["outcome"], r["reason"]) for r in outcomes.collect()}
    assert told == {
        "": ("emitted", None), "hidden": ("skipped", "noindex"), "four": ("emitted", None), "one": ("emitted", None),
        "two": ("skipped", "duplicate content"), "gone": ("skipped", "not fetched as a page"), "three": ("skipped", "too little text"),
    }
    got = {r["reference"]: r for r in made.collect()}
    assert set(got) == {"https://a.example/", "https://a.example/one", "https://a.example/fourth"}
    assert got["https://a.example/one"]["content_type"] == "guide" and got["https://a.example/one"]["text"].endswith("One.")
    assert got["https://a.example/fourth"]["metadata"] == {"fetchedUrl": "https://a.example/four"}
    counts = crawl.crawl_stats(outcomes).first()
    assert (counts["emitted"], counts["skipped"], counts["failed"]) == (3, 4, 0)
    chunks = chunking.chunk_documents(made, keep=("crawl_seq",)).groupBy("crawl_seq").agg(F.array_sort(F.collect_list(F.struct("index", "body"))).alias("parts")).collect()
    assert {r["crawl_seq"] for r in chunks} == {1, 3, 4}
    assert all(LONG.strip() in "\n".join(p["body"] for p in r["parts"]) for r in chunks)


def test_budget_and_empty_table(spark):
    visited, _, outcomes = crawled(spark, max_pages=4)
    assert [r["crawl_seq"] for r in visited.orderBy("crawl_seq").collect()] == [1, 2, 3, 4] and outcomes.count() == 4
    visited, made, outcomes = crawled(spark, rows=[])
    assert made.count() == 0 and {r["reason"] for r in outcomes.collect()} == {"not fetched as a page"}
