"""Queries over products, orders and baskets. Parts are products, orders and their lines are orders and carts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.ids import idempotency_key
from lorekeep.operators import commerce
from lorekeep.plans.catalog import query, table, text_list


def _amount(column: str):
    return F.col(column).cast("decimal(12,2)").cast("string")


def raw_products(spark, d) -> DataFrame:
    """Connector answers as JSON text; small parts are broken in different ways."""
    size = F.col("p_size")
    price = F.struct(
        F.when(size != 3, F.concat(F.lit("£"), _amount("p_retailprice"))).alias("formatted"),
        F.when(size == 4, F.lit("about 9")).otherwise(_amount("p_retailprice")).alias("amount"),
        F.when(size == 5, F.lit("EUR")).otherwise(F.lit("GBP")).alias("currency"),
        F.when(size > 25, F.lit(True)).when(size > 10, F.lit(False)).alias("taxIncluded"),
    )
    wire = F.struct(
        F.concat(F.lit(" SKU-"), "p_partkey").alias("sku"),
        F.when(size == 1, F.lit("  ")).otherwise(F.col("p_name")).alias("name"),
        F.concat(F.when(size == 2, F.lit("ftp")).otherwise(F.lit("https")), F.lit("://shop.example/p/"), "p_partkey").alias("url"),
        F.lower("p_type").alias("summary"),
        price.alias("price"),
        F.when(size > 40, "out_of_stock").when(size > 20, "in_stock").when(size > 15, "sold").alias("availability"),
    )
    # a part is small and costly to clean, so a few files of many parts are dealt to all cores
    parts = table(spark, d, "part").repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    return parts.select("p_partkey", "p_brand", "p_size", F.to_json(wire).alias("raw"))


def products(spark, d) -> DataFrame:
    return commerce.clean_products(raw_products(spark, d))


PRODUCTS = """pr AS (SELECT p_partkey, p_brand, 'SKU-' || p_partkey AS sku, p_name AS name, 'https://shop.example/p/' || p_partkey AS url, lower(p_type) AS summary,
  CASE WHEN p_size > 40 THEN 'out_of_stock' WHEN p_size > 20 THEN 'in_stock' END AS availability,
  CASE WHEN p_size <> 3 THEN '£' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END AS formatted,
  CASE WHEN p_size = 4 THEN 'about 9' WHEN p_size <> 3 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END AS amount,
  CASE WHEN p_size = 5 THEN 'EUR' WHEN p_size <> 3 THEN 'GBP' END AS currency,
  CASE WHEN p_size > 25 THEN true WHEN p_size > 10 THEN false END AS tax_included, p_size FROM part WHERE p_size NOT IN (1, 2))"""


@query("co1_clean_products", f"WITH {PRODUCTS} SELECT sku, name, url, summary, availability FROM pr")
def co1(spark, d):
    return products(spark, d).select("sku", "name", "url", "summary", "availability")


@query("co2_clean_price", f"WITH {PRODUCTS} SELECT sku, formatted, amount, currency, CASE WHEN formatted IS NOT NULL THEN tax_included END AS tax_included FROM pr")
def co2(spark, d):
    return products(spark, d).select("sku", "price.*")


def raw_orders(spark, d) -> DataFrame:
    item = F.struct(
        F.when(F.col("l_returnflag") != "A", F.concat(F.lit("Part "), "l_partkey")).alias("name"),
        F.when(F.col("l_linestatus") == "F", F.lit(0)).otherwise(F.col("l_quantity").cast("int")).alias("quantity"),
        F.concat(F.lit("SKU-"), "l_partkey").alias("sku"),
        "l_linenumber",
        "l_partkey",
    )
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    wire = F.struct(
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("ORD-"), "o_orderkey")).alias("reference"),
        F.col("o_orderstatus").alias("status"),
        F.lit(" ").alias("statusLabel"),
        F.lit("not an address").alias("trackingUrl"),
        F.struct(F.concat(F.lit("£"), _amount("o_totalprice")).alias("formatted")).alias("total"),
        "items",
    )
    return table(spark, d, "orders").join(items, "o_orderkey", "left").select("o_orderkey", F.to_json(wire).alias("raw"))


@query(
    "co3_clean_orders",
    """SELECT 'ORD-' || o_orderkey AS reference, o_orderstatus AS status, NULL::VARCHAR AS status_label, NULL::VARCHAR AS tracking_url,
       '£' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS total, coalesce(n, 0) AS items, coalesce(q, 0) AS quantity
       FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_linestatus = 'F' OR l_quantity < 1 THEN 1 ELSE CAST(floor(l_quantity) AS BIGINT) END) AS q
         FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW'""",
)
def co3(spark, d):
    quantity = F.aggregate("items", F.lit(0).cast("long"), lambda s, i: s + i["quantity"])
    return commerce.clean_orders(raw_orders(spark, d)).select(
        "reference", "status", "status_label", "tracking_url", F.col("total.formatted").alias("total"), F.size("items").cast("long").alias("items"), quantity.alias("quantity")
    )


@query(
    "co4_search_products",
    f"""WITH {PRODUCTS}, h AS (SELECT p_partkey, sku, lower(sku || ' ' || name || ' ' || summary || ' ' || p_brand) AS t FROM pr),
        s AS (SELECT *, contains(t, 'small')::INT + contains(t, 'red')::INT + contains(t, 'bolt')::INT AS score FROM h)
        SELECT sku, score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 10""",
)
def co4(spark, d):
    rows = products(spark, d).withColumn("keywords", F.array("p_brand"))
    return commerce.search_products(rows, "A small, RED bolt", "p_partkey").select("sku", "score")


@query("co5_page_items", f"WITH {PRODUCTS} SELECT sku FROM pr ORDER BY p_partkey LIMIT 10 OFFSET 20")
def co5(spark, d):
    """The third page, by way of the cursors of the first two."""
    cursor, page = None, None
    for _ in range(3):
        page, cursor = commerce.page_items(products(spark, d), ["p_partkey"], cursor, 50)
    return page.select("sku")


def wanted(spark, d) -> DataFrame:
    """What each order asks for: the skus of its lines."""
    line = F.struct("l_linenumber", "l_partkey", F.concat(F.lit(" SKU-"), F.col("l_partkey"), F.lit(" ")).alias("sku"))
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("request_id"))
        .agg(F.sort_array(F.collect_list(line)).alias("lines"))
        .select("request_id", F.col("lines.sku").alias("skus"))
    )


WANTED = f"""{PRODUCTS}, f AS (SELECT l_orderkey, 'SKU-' || l_partkey AS sku, min((l_linenumber, l_partkey)) AS first FROM lineitem GROUP BY 1, 2),
  n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first) - 1 AS position FROM f),
  w AS (SELECT n.l_orderkey AS request_id, n.position, n.sku, pr.sku IS NULL AS missing, pr.* EXCLUDE (sku) FROM n LEFT JOIN pr USING (sku) WHERE position < 4)"""


@query("co6_find_products", f"WITH {WANTED} SELECT request_id, position, sku, missing, name FROM w")
def co6(spark, d):
    return commerce.find_products(wanted(spark, d), products(spark, d)).select(
        "request_id", F.col("position").cast("long").alias("position"), "sku", "missing", "name"
    )


def comparison_sets(spark, d) -> DataFrame:
    found = commerce.find_products(wanted(spark, d), products(spark, d)).filter("NOT missing")
    return found.select("request_id", "position", "sku", "price.formatted", "price.amount", "price.currency", "availability", "price.tax_included")


SETS = f"""{WANTED}, z AS (SELECT request_id, position, sku, formatted, amount, currency, availability, CASE WHEN formatted IS NOT NULL THEN tax_included END AS tax,
  CASE WHEN regexp_matches(amount, '^[0-9]+(\\.[0-9]+)?$') THEN CAST(amount AS DECIMAL(18,2)) END AS value FROM w WHERE NOT missing)"""
COMPARABLE = "bool_and(value IS NOT NULL) AND count(currency) = count(*) AND count(DISTINCT currency) = 1"


@query("co7_comparable_by_price", f"WITH {SETS} SELECT request_id, {COMPARABLE} AS comparable FROM z GROUP BY request_id")
def co7(spark, d):
    comparable = commerce.comparable_by_price(F.col("amount"), F.col("currency"))
    return comparison_sets(spark, d).groupBy("request_id").agg(F.coalesce(comparable, F.lit(False)).alias("comparable"))


@query("co8_price_order", f"WITH {SETS} SELECT request_id, sku, row_number() OVER (PARTITION BY request_id ORDER BY value NULLS LAST, position) AS place FROM z")
def co8(spark, d):
    order = Window.partitionBy("request_id").orderBy(commerce.price_order(F.col("amount")).asc_nulls_last(), "position")
    return comparison_sets(spark, d).select("request_id", "sku", F.row_number().over(order).cast("long").alias("place"))


def _axis(column: str, label: str, wanted_kind: str, text: str) -> str:
    kind = f"CASE WHEN count({column}) = 0 THEN 'unknown' WHEN count(DISTINCT {column}) = 1 AND count({column}) = count(*) THEN 'shared' ELSE 'differing' END"
    return f"CASE WHEN {kind} = '{wanted_kind}' THEN {text.format(label=label, column=column)} END"


def _axes(kind: str, text: str) -> str:
    parts = [_axis("formatted", "Price", kind, text), _axis("availability", "Availability", kind, text), _axis("taxed", "Tax treatment", kind, text)]
    return f"concat_ws('|', {', '.join(parts)})"


@query(
    "co9_compare_products",
    f"""WITH {SETS}, y AS (SELECT *, CASE WHEN tax THEN 'included' WHEN NOT tax THEN 'excluded' END AS taxed FROM z)
        SELECT request_id, {COMPARABLE} AS ordered,
        CASE WHEN {COMPARABLE} THEN string_agg(sku, '|' ORDER BY value, position) ELSE string_agg(sku, '|' ORDER BY position) END AS skus,
        {_axes('shared', "'{label}: ' || min({column})")} AS shared, {_axes('differing', "'{label}'")} AS differing, {_axes('unknown', "'{label}'")} AS unknown
        FROM y GROUP BY request_id""",
)
def co9(spark, d):
    out = commerce.compare_products(comparison_sets(spark, d))
    return out.select("request_id", "ordered", *[text_list(c).alias(c) for c in ("skus", "shared", "differing", "unknown")])


def recommendations(spark, d, limit: int = 4) -> DataFrame:
    rows = products(spark, d).select("p_brand", "p_partkey", "sku", "name", "summary", "availability", "price.amount", "price.currency")
    return commerce.recommend("Small red widgets or a bolt, small", rows, limit, ["p_brand"], "p_partkey")


def recommended_cte(limit: int = 4) -> str:
    return f"""{PRODUCTS},
  wd AS (SELECT *, list_filter(regexp_split_to_array(lower(name || ' ' || summary), '[^a-z0-9]+'), lambda x: length(x) > 3) AS words FROM pr),
  hi AS (SELECT *, list_filter(['small', 'widgets', 'bolt'], lambda t: len(list_filter(words, lambda x: starts_with(x, t))) > 0) AS hits FROM wd),
  sc AS (SELECT *, 2 * len(hits) + coalesce((availability = 'in_stock')::INT, 0) AS score,
    CASE WHEN regexp_matches(amount, '^[0-9]+(\\.[0-9]+)?$') THEN CAST(amount AS DECIMAL(18,2)) END AS value,
    coalesce(availability <> 'out_of_stock', true) AS sellable, bool_or(coalesce(availability <> 'out_of_stock', true)) OVER (PARTITION BY p_brand) AS any_sellable FROM hi),
  po AS (SELECT * FROM sc WHERE sellable OR NOT any_sellable),
  ed AS (SELECT *, count(*) OVER b AS n, bool_and(value IS NOT NULL) OVER b AND count(currency) OVER b = count(*) OVER b AND min(currency) OVER b = max(currency) OVER b AS comparable,
    row_number() OVER (PARTITION BY p_brand ORDER BY value, score DESC, p_partkey) AS up,
    row_number() OVER (PARTITION BY p_brand ORDER BY value DESC, score, p_partkey DESC) AS down FROM po WINDOW b AS (PARTITION BY p_brand)),
  ch AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (n > {limit} AND {limit} >= 3 AND coalesce(comparable, false) AND (up = 1 OR down = 1)) DESC, score DESC, p_partkey) AS choice FROM ed),
  rec AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS place FROM ch WHERE choice <= {limit})"""


@query("co10_recommend", f"WITH {recommended_cte(2)} SELECT p_brand, place, sku, score FROM rec")
def co10(spark, d):
    """A limit of two is too small for the price spread: plain ranking."""
    return recommendations(spark, d, 2).select("p_brand", F.col("place").cast("long").alias("place"), "sku", F.col("score").cast("long").alias("score"))


@query("co11_spread_by_price", f"WITH {recommended_cte(4)} SELECT p_brand, place, sku FROM rec")
def co11(spark, d):
    return recommendations(spark, d, 4).select("p_brand", F.col("place").cast("long").alias("place"), "sku")


@query(
    "co12_recommend_reason",
    f"""WITH {recommended_cte(4)} SELECT sku, CASE WHEN len(hits) > 0 THEN 'matches "' || array_to_string(hits, '", "') || '" in the store''s own description'
        WHEN availability = 'in_stock' THEN 'is listed in stock in this category' ELSE 'is listed in this category' END AS reason FROM rec""",
)
def co12(spark, d):
    return recommendations(spark, d, 4).select("sku", "reason")


@query(
    "co13_track_orders",
    """WITH o AS (SELECT o_custkey AS subject, 'ORD-' || o_orderkey AS reference, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders),
       mine AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1),
       q AS (SELECT c_custkey, CASE WHEN c_nationkey < 8 THEN '' WHEN c_nationkey < 16 AND k IS NOT NULL THEN 'ORD-' || k ELSE 'nope' END AS wanted FROM customer LEFT JOIN mine ON o_custkey = c_custkey)
       SELECT c_custkey AS request_id, reference, CASE WHEN reference = wanted THEN 1 ELSE place END AS place,
         CASE WHEN reference IS NULL THEN 'none' WHEN wanted = '' OR reference = wanted THEN 'found' ELSE 'no match' END AS outcome
       FROM q LEFT JOIN o ON subject = c_custkey AND (CASE WHEN starts_with(wanted, 'ORD') THEN reference = wanted ELSE place <= 5 END)""",
)
def co13(spark, d):
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("subject"), F.concat(F.lit("ORD-"), "o_orderkey").alias("reference"), "o_orderdate", "o_orderkey"
    )
    mine = orders.groupBy(F.col("subject").alias("c_custkey")).agg(F.min("o_orderkey").alias("k"))
    wanted_ref = F.when(F.col("c_nationkey") < 8, F.lit(" ")).when(
        (F.col("c_nationkey") < 16) & F.col("k").isNotNull(), F.concat(F.lit(" ord "), "k")
    ).otherwise("nope")
    asked = table(spark, d, "customer").join(mine, "c_custkey", "left").select(
        F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("subject"), wanted_ref.alias("reference")
    )
    found = commerce.track_orders(asked, orders, [F.desc("o_orderdate"), F.col("o_orderkey")])
    return found.select("request_id", "reference", F.col("place").cast("long").alias("place"), "outcome")


def cart_requests(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount").alias("position"),
        F.concat(F.lit("SKU-"), "l_partkey").alias("sku"),
        F.when(F.col("l_discount") == 0, F.col("l_quantity") + 0.5).otherwise(F.col("l_quantity")).alias("quantity"),
    )


def lines(spark, d) -> DataFrame:
    return commerce.cart_lines(cart_requests(spark, d), products(spark, d))


LINES = f"""{PRODUCTS}, fi AS (SELECT l_orderkey, 'SKU-' || l_partkey AS sku, min((l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount)) AS first,
    arg_min(CASE WHEN l_discount = 0 THEN l_quantity + 0.5 ELSE l_quantity END, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount)) AS q FROM lineitem GROUP BY 1, 2),
  li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first) AS line FROM fi),
  ca AS (SELECT l_orderkey AS request_id, line, li.sku, CASE WHEN q <> floor(q) OR q < 1 THEN 1 ELSE least(q, 10) END::INT AS quantity, pr.sku IS NULL AS missing,
    pr.name, pr.formatted, pr.amount FROM li LEFT JOIN pr ON pr.sku = li.sku WHERE line <= 4)"""


@query("co14_cart_lines", f"WITH {LINES} SELECT request_id, line, sku, quantity, missing, name FROM ca")
def co14(spark, d):
    return lines(spark, d).select("request_id", F.col("line").cast("long").alias("line"), "sku", "quantity", "missing", "name")


@query(
    "co15_valid_coupon",
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type || '_' || p_size END AS coupon FROM part",
)
def co15(spark, d):
    code = F.when(F.col("p_size") > 25, F.concat(F.lit(" "), "p_type", F.lit("_"), "p_size", F.lit("\n"))).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", commerce.valid_coupon(code).alias("coupon"))


@query(
    "co16_proposal_summary",
    f"""WITH {LINES} SELECT request_id, string_agg(quantity || ' × ' || name || ' (' || sku || ')' || CASE WHEN formatted IS NULL THEN '' ELSE ' at ' || formatted || ' each' END, chr(10) ORDER BY line) AS summary
        FROM ca WHERE NOT missing GROUP BY request_id""",
)
def co16(spark, d):
    return commerce.proposal_summary(lines(spark, d))


@query(
    "co17_cart_total",
    f"""WITH {LINES}, pe AS (SELECT *, CASE WHEN regexp_matches(amount, '^[0-9]+\\.') THEN CAST(CAST(amount AS DECIMAL(18,2)) * 100 AS BIGINT) ELSE 0 END AS pence FROM ca),
        su AS (SELECT request_id, sum(pence * quantity)::BIGINT AS total FROM pe GROUP BY 1),
        du AS (SELECT request_id, CASE WHEN o_orderpriority = '1-URGENT' THEN (total * 9 + 5) // 10 ELSE total END AS pence FROM su JOIN orders ON o_orderkey = request_id)
        SELECT request_id AS cart_id, CAST(pence AS BIGINT) AS pence, CAST(CAST(pence // 100 AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(CAST(pence % 100 AS BIGINT) AS VARCHAR), 2, '0') AS amount FROM du""",
)
def co17(spark, d):
    coupons = table(spark, d, "orders").select(F.col("o_orderkey").alias("cart_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "TEN").alias("coupon"))
    rows = lines(spark, d).select(F.col("request_id").alias("cart_id"), "price.amount", "quantity").join(coupons, "cart_id")
    return commerce.cart_total(rows).select("cart_id", "pence", "amount")


def proposals(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.lit("main").alias("site_id"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 10 MINUTES")).alias("expires_at"), (F.col("o_orderstatus") != "P").alias("accepted"),
    )


def confirms(spark, d) -> DataFrame:
    """Each line of an order confirms it, 3 minutes per line number after it was placed; some are strangers."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    stranger = (F.col("l_returnflag") == "A").cast("long")
    return rows.select(
        F.lit("main").alias("site_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("confirm_id"), F.col("l_orderkey").alias("proposal_id"),
        (F.col("o_custkey") - stranger).alias("subject"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=3 * F.col("l_linenumber"))).alias("at"), "l_linenumber", "l_partkey",
    )


@query(
    "co18_confirm_proposals",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus, l_returnflag <> 'A' AND 3 * l_linenumber < 10 AS valid FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
       r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, valid ORDER BY l_linenumber, l_partkey, l_suppkey) AS z FROM c)
       SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN valid AND z = 1 THEN CASE WHEN o_orderstatus <> 'P' THEN 'applied' ELSE 'rejected' END ELSE 'gone' END AS status FROM r""",
)
def co18(spark, d):
    out = commerce.confirm_proposals(proposals(spark, d), confirms(spark, d))
    return out.select("confirm_id.l_orderkey", "confirm_id.l_linenumber", "confirm_id.l_partkey", "status")


@query(
    "co18_idempotency_key",
    "SELECT o_orderkey, sha256('shop:cp_' || o_orderkey)[1:32] AS key FROM orders",
)
def co18_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", idempotency_key(F.concat(F.lit("cp_"), "o_orderkey"), "shop").alias("key"))


def keyed_requests(spark, d) -> DataFrame:
    l = table(spark, d, "lineitem")
    return l.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("request_id"), F.col("l_suppkey").alias("owner"),
        F.when(F.col("l_discount") > 0, F.concat("l_returnflag", "l_linestatus")).alias("key"), F.col("l_orderkey").alias("outcome"), "l_shipdate",
    )


@query(
    "co19_idempotent_apply",
    """SELECT l_orderkey, l_linenumber, l_partkey, first_value(l_orderkey) OVER w AS outcome, row_number() OVER w > 1 AS replayed FROM lineitem WHERE l_discount > 0
       WINDOW w AS (PARTITION BY l_suppkey, l_returnflag || l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity)""",
)
def co19(spark, d):
    replies, _ = commerce.idempotent_apply(keyed_requests(spark, d), ["l_shipdate", "request_id"])
    return replies.select("request_id.l_orderkey", "request_id.l_linenumber", "request_id.l_partkey", "outcome", "replayed")


@query("co19_missing_keys", "SELECT count(*) AS errors FROM lineitem WHERE l_discount = 0")
def co19_errors(spark, d):
    return commerce.idempotent_apply(keyed_requests(spark, d), ["l_shipdate", "request_id"])[1].agg(F.count("*").alias("errors"))


@query(
    "co20_clean_outcome",
    """SELECT o_orderkey, o_orderstatus = 'O' AS applied, CASE WHEN o_orderpriority <> '5-LOW' THEN 'done' END AS message,
       CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS item_count, NULL::VARCHAR AS cart_url FROM orders""",
)
def co20(spark, d):
    status = F.col("o_orderstatus")
    flag = F.when(status == "O", "true").when(status == "F", '"true"').otherwise("1")
    count = F.when(status == "P", F.lit("1.5")).otherwise(F.col("o_custkey").cast("string"))
    message = F.when(F.col("o_orderpriority") == "5-LOW", "   ").otherwise(" done ")
    raw = F.concat(F.lit('{"applied":'), flag, F.lit(',"itemCount":'), count, F.lit(',"message":"'), message, F.lit('","cartUrl":"javascript:1"}'))
    out = commerce.clean_outcome(table(spark, d, "orders").select("o_orderkey", raw.alias("raw")))
    return out.select("o_orderkey", "applied", "message", "item_count", "cart_url")


@query(
    "co21_prepare_proposals",
    """SELECT 'cp_' || sha256('main' || chr(0) || o_custkey || chr(0) || l_orderkey || chr(0) || min(l_linenumber))[1:32] AS id, l_orderkey AS turn_id,
       min(l_linenumber) AS seq, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 10 MINUTE AS expires_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_custkey, o_orderdate
       UNION ALL SELECT NULL, NULL, count(*) - count(DISTINCT l_orderkey), NULL FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
)
def co21(spark, d):
    """Prepared proposals, and in a last row how many were refused."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    asked = rows.select(
        F.lit("main").alias("site_id"), F.col("o_custkey").cast("string").alias("conversation_id"), F.col("l_orderkey").alias("turn_id"),
        F.col("l_linenumber").alias("seq"), F.col("o_custkey").alias("subject"), F.lit("addToCart").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("at"),
    ).dropDuplicates(["turn_id", "seq"])
    made, refused = commerce.prepare_proposals(asked)
    count = refused.agg(F.count("*").cast("int").alias("seq")).select(
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("turn_id"), "seq", F.lit(None).cast("timestamp").alias("expires_at")
    )
    return made.select("id", "turn_id", "seq", "expires_at").unionByName(count)
