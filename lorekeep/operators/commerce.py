"""Products, orders, baskets and confirmations. Amounts stay text; decimals are used only for order and totals."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.binding import bind
from lorekeep.functions.text import blank_to_null, js_trim
from lorekeep.functions.urls import is_http
from lorekeep.settings import MAX_CART_LINES, MAX_CART_QUANTITY, MAX_COMPARE, MAX_LISTING, MAX_ORDERS, PROPOSAL_LIFETIME_SECONDS

AVAILABILITY = ("in_stock", "out_of_stock", "backorder", "unknown")
DECIMAL = r"^[0-9]+(\.[0-9]+)?\z"
AMOUNT = "decimal(38,18)"
PRICE_TYPE = "struct<formatted:string,amount:string,currency:string,tax_included:boolean>"


def _field(value: Column, path: str, kind: str) -> Column:
    """A JSON field if it has exactly the wanted type, else NULL."""
    return bind(F.try_variant_get(value, path, "variant"), lambda found: _typed(found, kind))


def _typed(found: Column, kind: str) -> Column:
    name = F.schema_of_variant(found)
    if kind == "string":
        return F.when(name == "STRING", F.try_variant_get(found, "$", "string"))
    if kind == "boolean":
        return F.when(name == "BOOLEAN", F.try_variant_get(found, "$", "boolean"))
    number = F.when(name.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(found, "$", "double"))
    return bind(number, lambda n: F.when(n == F.floor(n), n.cast("long")))


def _text(value: Column, path: str) -> Column:
    return blank_to_null(_field(value, path, "string"))


def _address(value: Column, path: str) -> Column:
    return bind(_text(value, path), lambda text: F.when(is_http(text), text))


def clean_price(value: Column, path: str = "$") -> Column:
    """struct(formatted, amount, currency, tax_included), or NULL without a formatted price.

    ``tax_included`` is NULL unless it is a real boolean: unknown is not the same as excluded.
    """
    at = lambda name: f"{path}.{name}"

    def price(formatted: Column) -> Column:
        parts = F.struct(
            formatted.alias("formatted"),
            _text(value, at("amount")).alias("amount"),
            _text(value, at("currency")).alias("currency"),
            _field(value, at("taxIncluded"), "boolean").alias("tax_included"),
        )
        return F.when(formatted.isNotNull(), parts)

    return bind(_text(value, at("formatted")), price)


def _parsed(raw: DataFrame, column: str, fields: Callable[[Column], list[Column]], required: tuple[str, ...] = ()) -> DataFrame:
    """The ``fields`` of JSON text beside the other columns; rows without one of ``required`` are dropped.

    They leave a generator, which the optimizer takes apart for no filter and no part that is selected of a field, so a
    text is parsed once and a field is read once.
    """
    rows = F.transform(F.array(F.try_parse_json(column)), lambda value: F.struct(*fields(value)))
    if required:
        rows = F.filter(rows, lambda row: reduce(and_, [row[name].isNotNull() for name in required]))
    return raw.select(*[c for c in raw.columns if c != column], F.inline(rows))


def clean_products(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Products from JSON text; rows without sku, name and an http(s) url are dropped."""

    def fields(value: Column) -> list[Column]:
        return [
            _text(value, "$.sku").alias("sku"),
            _text(value, "$.name").alias("name"),
            _address(value, "$.url").alias("url"),
            _address(value, "$.imageUrl").alias("image_url"),
            _text(value, "$.summary").alias("summary"),
            clean_price(value, "$.price").alias("price"),
            bind(_field(value, "$.availability", "string"), lambda found: F.when(found.isin(*AVAILABILITY), found)).alias("availability"),
        ]

    return _parsed(raw, column, fields, ("sku", "name", "url"))


def clean_orders(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Orders from JSON text; they need a reference, their items a name, and bad quantities count as 1."""

    def item(entry: Column) -> Column:
        quantity = bind(_field(entry, "$.quantity", "integer"), lambda n: F.when(n > 0, n).otherwise(F.lit(1).cast("long")))
        return F.struct(_text(entry, "$.name").alias("name"), quantity.alias("quantity"), _text(entry, "$.sku").alias("sku"))

    def fields(value: Column) -> list[Column]:
        entries = F.coalesce(F.try_variant_get(value, "$.items", "array<variant>"), F.array().cast("array<variant>"))
        return [
            _text(value, "$.reference").alias("reference"),
            _text(value, "$.status").alias("status"),
            _text(value, "$.statusLabel").alias("status_label"),
            _text(value, "$.placedAt").alias("placed_at"),
            _text(value, "$.estimatedDelivery").alias("estimated_delivery"),
            _address(value, "$.trackingUrl").alias("tracking_url"),
            clean_price(value, "$.total").alias("total"),
            F.filter(F.transform(entries, item), lambda i: i["name"].isNotNull()).alias("items"),
        ]

    return _parsed(raw, column, fields, ("reference",))


def clean_outcome(raw: DataFrame, column: str = "raw") -> DataFrame:
    def fields(value: Column) -> list[Column]:
        return [
            F.coalesce(_field(value, "$.applied", "boolean"), F.lit(False)).alias("applied"),
            _text(value, "$.message").alias("message"),
            _field(value, "$.itemCount", "integer").alias("item_count"),
            clean_price(value, "$.total").alias("total"),
            _address(value, "$.cartUrl").alias("cart_url"),
        ]

    return _parsed(raw, column, fields)


def search_terms(query: str, longer_than: int) -> list[str]:
    return [word for word in re.split("[^a-z0-9]+", query.lower()) if len(word) > longer_than]


def search_products(products: DataFrame, query: str, order: str = "position", limit: int = MAX_LISTING) -> DataFrame:
    """Best products by number of query terms they contain; ties keep catalogue order. Each task keeps its best."""
    parts = F.concat(
        F.array("sku", "name", F.coalesce("summary", F.lit(""))), F.coalesce("keywords", F.array().cast("array<string>"))
    )
    haystack = F.lower(F.array_join(parts, " "))
    score = F.lit(0)
    for term in search_terms(query, 2):
        score = score + F.contains(haystack, F.lit(term)).cast("int")
    return products.withColumn("score", score).filter(F.col("score") > 0).orderBy(F.desc("score"), order).limit(min(limit, MAX_LISTING))


def page_items(items: DataFrame, order: list[str], after: tuple | None = None, limit: int = 5) -> tuple[DataFrame, tuple | None]:
    """(page, next cursor or None). ``order`` names columns whose values are unique together and never null.

    A cursor is the key of the last row that was shown, so a late page costs what the first one does: each task keeps the
    few rows that follow the key, and only their keys come to the driver.
    """
    size = min(limit or 5, MAX_LISTING)
    rest = items
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for name, value in zip(order, after):
            beyond = beyond | (equal & (F.col(name) > F.lit(value)))
            equal = equal & (F.col(name) == F.lit(value))
        rest = items.filter(beyond)
    ordered = rest.orderBy(*order)
    keys = ordered.limit(size + 1).select(*order).collect()
    return ordered.limit(size), tuple(keys[size - 1]) if len(keys) > size else None


def wanted_skus(requests: DataFrame) -> DataFrame:
    """(request_id, skus) -> request_id, position, sku: trimmed, distinct, at most four, in first-seen order."""
    clean = F.filter(F.transform("skus", js_trim), lambda s: s != "")
    return requests.select("request_id", F.posexplode(F.slice(F.array_distinct(clean), 1, MAX_COMPARE)).alias("position", "sku"))


def find_products(requests: DataFrame, products: DataFrame) -> DataFrame:
    """One row per wanted sku with the product's columns and ``missing``."""
    found = products.withColumn("_found", F.lit(True))
    return (
        wanted_skus(requests).join(found, "sku", "left").withColumn("missing", F.col("_found").isNull()).drop("_found")
    )


def comparable_by_price(amount: Column, currency: Column) -> Column:
    """Aggregate: one currency for all rows, none without, and every amount a plain decimal."""
    decimals = F.bool_and(F.coalesce(amount.rlike(DECIMAL), F.lit(False)))
    return decimals & (F.count_if(currency.isNull()) == 0) & (F.min(currency) == F.max(currency))


def price_order(amount: Column) -> Column:
    """Sort value of a decimal text: numeric, with everything else last (NULLS LAST).

    Text order over (number of whole digits, whole, fraction) is exact at any length, where a decimal cast is not.
    """
    whole = F.regexp_extract(amount, r"^([0-9]+)", 1)
    fraction = F.regexp_replace(F.regexp_extract(amount, r"\.([0-9]+)", 1), "0+$", "")
    return F.when(amount.rlike(DECIMAL), F.struct(F.length(whole).alias("n"), whole.alias("w"), fraction.alias("f")))


def compare_products(sets: DataFrame, key: str = "request_id") -> DataFrame:
    """Per set: products in order (cheapest first if comparable), and how price, availability and tax relate.

    ``sets``: key, position, sku, formatted, amount, currency, availability, tax_included. Absent counts as a value.
    """
    tax = F.when(F.col("tax_included"), "included").when(~F.col("tax_included"), "excluded")
    axes = {"Price": F.col("formatted"), "Availability": F.col("availability"), "Tax treatment": tax}
    comparable = comparable_by_price(F.col("amount"), F.col("currency"))
    row = F.struct(price_order(F.col("amount")).alias("p"), F.col("position").alias("at"), F.col("sku").alias("sku"))
    aggregates = [comparable.alias("ordered"), F.array_sort(F.collect_list(row)).alias("_rows"), F.count("*").alias("_n")]
    for i, value in enumerate(axes.values()):
        aggregates += [F.count(value).alias(f"_c{i}"), (F.min(value) == F.max(value)).alias(f"_d{i}"), F.min(value).alias(f"_v{i}")]
    grouped = sets.groupBy(key).agg(*aggregates)

    def kind(i: int) -> Column:
        absent = F.col(f"_c{i}") == 0
        same = F.col(f"_d{i}") & (F.col(f"_c{i}") == F.col("_n"))
        return F.when(absent, "unknown").when(same, "shared").otherwise("differing")

    def listed(wanted: str, text) -> Column:
        return F.filter(
            F.array(*[F.when(kind(i) == wanted, text(i, label)) for i, label in enumerate(axes)]), lambda x: x.isNotNull()
        )

    by_position = F.array_sort(F.transform("_rows", lambda r: F.struct(r["at"].alias("at"), r["sku"].alias("sku"))))
    return grouped.select(
        key,
        F.coalesce("ordered", F.lit(False)).alias("ordered"),
        F.when(F.col("ordered"), F.transform("_rows", lambda r: r["sku"])).otherwise(F.transform(by_position, lambda r: r["sku"])).alias("skus"),
        listed("shared", lambda i, label: F.concat(F.lit(label + ": "), F.col(f"_v{i}"))).alias("shared"),
        listed("differing", lambda i, label: F.lit(label)).alias("differing"),
        listed("unknown", lambda i, label: F.lit(label)).alias("unknown"),
    )


def _hits(terms: list[str]) -> Column:
    text = F.lower(F.concat_ws(" ", F.col("name"), F.coalesce("summary", F.lit(""))))
    words = F.filter(F.split(text, "[^a-z0-9]+"), lambda w: F.length(w) > 3)
    if not terms:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.exists(words, lambda w: F.startswith(w, t)))


def recommend(query: str, candidates: DataFrame, limit: int, keys: list[str], order: str = "position") -> DataFrame:
    """Best ``limit`` products per pool (``keys``), with ``place`` and ``reason``.

    Columns: sku, name, summary, availability, amount, currency and an input position. What is out of stock is left
    out unless nothing else remains. When a pool is larger than a limit of three or more and its prices compare, the
    cheapest and the dearest are always kept and the rest is filled by rank. The pool itself is only aggregated; the
    ranking window stops at ``limit`` rows per pool.
    """
    terms = list(dict.fromkeys(search_terms(query, 3)))
    sellable = F.coalesce(F.col("availability") != "out_of_stock", F.lit(True))
    hits = _hits(terms)
    scored = candidates.withColumn("_sellable", sellable).withColumn("hits", hits).withColumn(
        "score", F.size("hits") * 2 + F.coalesce((F.col("availability") == "in_stock").cast("int"), F.lit(0))
    )
    best_first = F.struct(-F.col("score"), F.col(order))
    # the stable sort by price runs on the ranked list, so equal prices keep rank order
    cheap = F.struct(price_order(F.col("amount")), -F.col("score"), F.col(order))

    def facts(where: Column) -> list[Column]:
        priced = F.when(where, cheap)
        return [
            F.count_if(where).alias("n"),
            F.min_by(F.when(where, F.col(order)), priced).alias("cheapest"),
            F.max_by(F.when(where, F.col(order)), priced).alias("dearest"),
            (
                F.bool_and(F.when(where, F.coalesce(F.col("amount").rlike(DECIMAL), F.lit(False))))
                & (F.count_if(where & F.col("currency").isNull()) == 0)
                & (F.min(F.when(where, F.col("currency"))) == F.max(F.when(where, F.col("currency"))))
            ).alias("comparable"),
        ]

    both = scored.groupBy(*keys).agg(
        F.struct(*facts(F.col("_sellable"))).alias("_some"), F.struct(*facts(F.lit(True))).alias("_all")
    )
    pools = both.select(
        *keys, (F.col("_some.n") > 0).alias("_filter"), F.when(F.col("_some.n") > 0, F.col("_some")).otherwise(F.col("_all")).alias("_pool")
    )
    spread = (F.col("_pool.n") > limit) & F.lit(limit >= 3) & F.coalesce("_pool.comparable", F.lit(False))
    edge = spread & F.col(order).isin(F.col("_pool.cheapest"), F.col("_pool.dearest"))
    choose = Window.partitionBy(*keys).orderBy(F.desc("_edge"), *[F.desc("score"), F.col(order)])
    emit = Window.partitionBy(*keys).orderBy(F.desc("score"), order)
    reason = (
        F.when(F.size("hits") > 0, F.concat(F.lit('matches "'), F.array_join("hits", '", "'), F.lit("\" in the store's own description")))
        .when(F.col("availability") == "in_stock", "is listed in stock in this category")
        .otherwise("is listed in this category")
    )
    return (
        scored.join(pools, keys)
        .filter(~F.col("_filter") | F.col("_sellable"))
        .withColumn("_edge", edge)
        .withColumn("_choice", F.row_number().over(choose))
        .filter(F.col("_choice") <= limit)
        .withColumn("place", F.row_number().over(emit))
        .withColumn("reason", reason)
        .drop("_sellable", "_filter", "_pool", "_edge", "_choice")
    )


def order_key(reference: Column) -> Column:
    return F.regexp_replace(F.lower(reference), r"[\s_-]", "")


def track_orders(requests: DataFrame, orders: DataFrame, order: list) -> DataFrame:
    """(request_id, subject, reference?) against orders(subject, reference, …), at most five rows per request.

    ``outcome`` is found, no match (recent orders are listed instead) or none. Each subject's orders are limited
    before they meet a request without a reference; a named one is an equi-join on the normalised reference.
    """
    recent_order = Window.partitionBy("subject").orderBy(*order)
    recent = orders.withColumn("place", F.row_number().over(recent_order)).filter(F.col("place") <= MAX_ORDERS)
    asked = requests.withColumn("wanted", order_key(F.trim(F.coalesce("reference", F.lit(""))))).drop("reference")
    keyed = orders.withColumn("wanted", order_key(F.col("reference")))
    named = asked.filter(F.col("wanted") != "").join(keyed, ["subject", "wanted"])
    per_request = Window.partitionBy("request_id").orderBy(*order)
    named = named.withColumn("place", F.row_number().over(per_request)).filter(F.col("place") <= MAX_ORDERS)
    found = named.select("request_id", "subject", "reference", "place", F.lit("found").alias("outcome"))
    rest = asked.join(found.select("request_id").distinct(), "request_id", "left_anti")
    listed = rest.join(recent.select("subject", "reference", "place"), "subject", "left")
    outcome = F.when(F.col("reference").isNull(), "none").when(F.col("wanted") == "", "found").otherwise("no match")
    return found.unionByName(listed.select("request_id", "subject", "reference", "place", outcome.alias("outcome")))


def cart_quantity(quantity: Column) -> Column:
    """1 to the cart maximum; anything that is not a whole number from 1 up counts as 1."""
    number = quantity.cast("double")
    whole = (number == F.floor(number)) & (number >= 1)
    return F.when(whole, F.least(number, F.lit(float(MAX_CART_QUANTITY))).cast("int")).otherwise(1)


def cart_lines(requests: DataFrame, products: DataFrame) -> DataFrame:
    """(request_id, position, sku, quantity) -> the first entry per sku, at most four, joined to products."""
    clean = requests.withColumn("sku", js_trim(F.col("sku"))).filter(F.col("sku") != "")
    first = clean.groupBy("request_id", "sku").agg(F.min("position").alias("position"), F.min_by("quantity", "position").alias("quantity"))
    window = Window.partitionBy("request_id").orderBy("position")
    lines = (
        first.withColumn("line", F.row_number().over(window))
        .filter(F.col("line") <= MAX_CART_LINES)
        .withColumn("quantity", cart_quantity(F.col("quantity")))
        .drop("position")
    )
    known = products.select("sku", F.col("name"), F.col("price"), F.col("url"), F.lit(True).alias("_known"))
    return lines.join(known, "sku", "left").withColumn("missing", F.col("_known").isNull()).drop("_known")


def valid_coupon(code: Column) -> Column:
    """The trimmed code if it is usable, else NULL."""
    trimmed = js_trim(code)
    return F.when(trimmed.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,39}\z"), trimmed)


def proposal_summary(lines: DataFrame, key: str = "request_id") -> DataFrame:
    """One text per request; at most four lines each."""
    price = F.when(F.col("price.formatted").isNotNull(), F.concat(F.lit(" at "), F.col("price.formatted"), F.lit(" each"))).otherwise("")
    text = F.concat(F.col("quantity").cast("string"), F.lit(" × "), F.col("name"), F.lit(" ("), F.col("sku"), F.lit(")"), price)
    rows = F.array_sort(F.collect_list(F.struct(F.col("line"), text.alias("text"))))
    return lines.filter(~F.col("missing")).groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("summary"))


def pence(amount: Column) -> Column:
    """Whole pence of an amount text; further places are cut, a missing product costs nothing."""
    text = F.coalesce(amount, F.lit("0"))
    whole = F.coalesce(F.regexp_extract(text, r"^([0-9]+)", 1).try_cast("long"), F.lit(0).cast("long"))
    fraction = F.substring(F.rpad(F.regexp_extract(text, r"^[0-9]+\.([0-9]+)", 1), 2, "0"), 1, 2)
    return whole * 100 + fraction.cast("long")


def cart_total(lines: DataFrame, key: str = "cart_id") -> DataFrame:
    """(cart, amount, quantity, coupon) -> total per cart in pence, as text and formatted. Integers throughout."""
    total = F.sum(pence(F.col("amount")) * F.col("quantity").cast("long"))
    due = F.when(F.max("coupon").isNull(), total).otherwise(F.floor((total * 9 + 5) / F.lit(10)).cast("long"))
    grouped = lines.groupBy(key).agg(due.alias("pence"))
    amount = F.concat(F.expr("pence div 100").cast("string"), F.lit("."), F.lpad((F.col("pence") % 100).cast("string"), 2, "0"))
    return grouped.withColumn("amount", amount).withColumn("formatted", F.concat(F.lit("£"), F.col("amount")))


def prepare_proposals(requests: DataFrame, turn: str = "turn_id") -> tuple[DataFrame, DataFrame]:
    """(proposals, refused): only the first proposal of a turn counts.

    ``requests``: site_id, conversation_id, turn_id, seq, subject, kind, summary, at. Ids derive from the turn, so a
    re-run gives the same proposal.
    """
    first = requests.groupBy("site_id", "conversation_id", turn).agg(F.min("seq").alias("_first"))
    marked = requests.join(first, ["site_id", "conversation_id", turn]).withColumn("_kept", F.col("seq") == F.col("_first"))
    identity = F.sha2(F.concat_ws("\u0000", "site_id", "conversation_id", F.col(turn).cast("string"), F.col("seq").cast("string")), 256)
    proposals = (
        marked.filter("_kept")
        .withColumn("id", F.concat(F.lit("cp_"), F.substring(identity, 1, 32)))
        .withColumn("expires_at", F.col("at") + F.make_dt_interval(secs=F.lit(PROPOSAL_LIFETIME_SECONDS)))
    )
    return proposals.drop("_kept", "_first"), marked.filter("NOT _kept").drop("_kept", "_first")


def confirm_proposals(proposals: DataFrame, confirms: DataFrame) -> DataFrame:
    """Status per confirmation: applied or rejected for the first valid one, gone for every other.

    ``proposals``: site_id, id, subject, expires_at, accepted (what the shop answers). ``confirms``: confirm_id,
    site_id, proposal_id, subject, at. Valid means same subject and not expired; a stranger does not use one up.
    The winner per proposal comes from a partial aggregation, so a proposal confirmed a million times is no hot task.
    """
    known = proposals.select("site_id", F.col("id").alias("proposal_id"), F.col("subject").alias("_owner"), "expires_at", "accepted")
    matched = confirms.join(known, ["site_id", "proposal_id"], "left").withColumn(
        "_valid", F.coalesce((F.col("subject") == F.col("_owner")) & (F.col("expires_at") > F.col("at")), F.lit(False))
    )
    winners = (
        matched.filter("_valid")
        .groupBy("site_id", "proposal_id")
        .agg(F.min(F.struct("at", "confirm_id")).alias("_first"))
        .select("site_id", F.col("_first.confirm_id").alias("confirm_id"), F.lit(True).alias("_won"))
    )
    status = F.when(F.col("_won"), F.when(F.col("accepted"), "applied").otherwise("rejected")).otherwise("gone")
    return matched.join(winners, ["site_id", "confirm_id"], "left").select(
        "site_id", "confirm_id", "proposal_id", "subject", "at", status.alias("status")
    )


def idempotent_apply(requests: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(replies, errors): every request of an (owner, key) gets the first one's outcome; no key is an error."""
    keyed = F.coalesce("key", F.lit("")) != ""
    first = (
        requests.filter(keyed)
        .groupBy("owner", "key")
        .agg(F.min_by(F.struct("request_id", "outcome"), F.struct(*order)).alias("_first"))
        .select("owner", "key", F.col("_first.request_id").alias("first_request"), F.col("_first.outcome").alias("first_outcome"))
    )
    replies = (
        requests.filter(keyed)
        .join(first, ["owner", "key"])
        .select("request_id", "owner", "key", F.col("first_outcome").alias("outcome"), (F.col("request_id") != F.col("first_request")).alias("replayed"))
    )
    return replies, requests.filter(~keyed).select("request_id", F.lit("IDEMPOTENCY_KEY_REQUIRED").alias("error"))
