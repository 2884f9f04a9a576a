"""Binding of the supplied TPC-H-like tables to the retail model.

The same binding is written as a DuckDB CTE prefix in
``tillpoint.checks.oracle`` so the oracle sees identical model tables.
Every expression is a plain projection or a broadcast-free lookup, so the
binding adds no shuffle except the per-order numbering of items (pruned by
Catalyst when a query does not read the item id).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.functions.expr import subtotal_of, ts_lit
from tillpoint.sources.tables import Tables, conform

# ---------------------------------------------------------------------------
# Fixed values of the binding
# ---------------------------------------------------------------------------
# Categories: one per part type, ids in alphabetical order of the type.
CATEGORY_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
BASE_DATE = dt.datetime(1995, 1, 1)
EMAIL_DOMAIN = "@example.com"
# ---------------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bind_customers(spark, sf_dir) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    df = c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit(EMAIL_DOMAIN)).alias("email"),
        F.substring("c_name", 1, 8).alias("first_name"),
        F.expr("substr(c_name, 10)").alias("last_name"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("city"),
        (ts_lit(BASE_DATE)
         + F.make_interval(days=(F.col("c_custkey") % 365).cast("int"))).alias("created_at"),
        (F.col("c_custkey") % 10 != 0).alias("is_active"),
    )
    return conform(df, "customers")


def bind_categories(spark, sf_dir=None) -> DataFrame:
    rows = [(i + 1, name, f"Parts of type {name}") for i, name in enumerate(CATEGORY_TYPES)]
    df = spark.createDataFrame(rows, "id long, name string, description string") \
              .withColumn("created_at", ts_lit(BASE_DATE))
    return conform(df, "categories")


def category_id_of(p_type) -> "F.Column":
    m = F.create_map(*[x for i, t in enumerate(CATEGORY_TYPES) for x in (F.lit(t), F.lit(i + 1))])
    return m[p_type].cast("long")


def bind_products(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    df = p.select(
        F.col("p_partkey").alias("id"),
        category_id_of(F.col("p_type")).alias("category_id"),
        F.format_string("SKU-%06d", F.col("p_partkey")).alias("sku"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("description"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("unit_price"),
        F.col("p_size").alias("stock"),
        (F.col("p_partkey") % 10 != 0).alias("is_active"),
        ts_lit(BASE_DATE).alias("created_at"),
    )
    return conform(df, "products")


def status_of(orderstatus, priority) -> "F.Column":
    return (F.when(orderstatus == "F", F.when(priority == "5-LOW", "refunded").otherwise("delivered"))
             .when(orderstatus == "O",
                   F.when(priority == "5-LOW", "cancelled")
                    .when(priority.isin("1-URGENT", "2-HIGH"), "shipped")
                    .otherwise("confirmed"))
             .when(orderstatus == "P", "pending"))


def bind_orders(spark, sf_dir) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    df = o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        status_of(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("status"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"),
        F.lit("USD").alias("currency"),
        F.col("o_orderdate").cast("timestamp").alias("placed_at"),
    )
    return conform(df, "orders")


# Item ids: order key * ITEM_ID_STRIDE + position of the line in its order.
ITEM_ID_STRIDE = 1000


def bind_order_items(spark, sf_dir, ranged: bool = False) -> DataFrame:
    """``ranged``: partitions that follow each other by order id.

    Lines of an order that are equal up to the price are equal in every column of the
    result, so l_discount, l_tax and l_shipdate, which come next in the order, decide nothing."""
    li = _read(spark, sf_dir, "lineitem")
    li = li.repartitionByRange("l_orderkey") if ranged else li
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    qty = F.col("l_quantity").cast("int")
    price = F.col("l_extendedprice").cast("decimal(10,2)")
    df = li.select(
        (F.col("l_orderkey") * ITEM_ID_STRIDE + F.row_number().over(w)).alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        qty.alias("quantity"),
        price.alias("unit_price"),
        subtotal_of(qty, price).alias("subtotal"),
    )
    return conform(df, "order_items")


def bind_last_item_ids(spark, sf_dir) -> DataFrame:
    """The last item id of every order: its lines are counted, not sorted."""
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_n"))
    return lines.select((F.col("l_orderkey") * ITEM_ID_STRIDE + F.col("_n")).cast("long").alias("id"))


def bind(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(
        customers=bind_customers(spark, sf_dir),
        categories=bind_categories(spark, sf_dir),
        products=bind_products(spark, sf_dir),
        orders=bind_orders(spark, sf_dir),
        order_items=bind_order_items(spark, sf_dir),
        last_item_ids=bind_last_item_ids(spark, sf_dir),
    )


# ---------------------------------------------------------------------------
# Order feed derived from the supplied tables, with injected defects.
# Defect chosen by item id modulo DEFECT_MOD (fixed table below); rows with
# residue DUPLICATE_RESIDUE appear twice (exact repeat right after).
# ---------------------------------------------------------------------------
DEFECT_MOD = 101
DUPLICATE_RESIDUE = 19


def _cap(s):
    return F.concat(F.upper(F.substring(s, 1, 1)), F.expr("substring(status, 2)"))


def _repeats(df: DataFrame) -> bool:
    """Whether an id occurs more than once."""
    n, distinct = df.agg(F.count("id"), F.count_distinct("id")).first()
    return n != distinct


def derive_feed(spark: SparkSession, sf_dir: str, t: Tables | None = None) -> DataFrame:
    """FEED_COLUMNS + row_num + source_file, one row per line item (plus
    repeats), strings as a CSV export would hold them.

    Rows are numbered by (item id, copy) while they are narrow and still in
    the ranges that numbered the items; the lookups follow.  A lookup key that
    occurs twice makes two rows of one, so these are then numbered last."""
    from tillpoint.operators.ranking import dense_ids
    items = bind_order_items(spark, sf_dir, ranged=True) if t is None else t.order_items
    ranged, t = t is None, t or bind(spark, sf_dir)
    i = items.select(F.col("id").alias("k"), "order_id", "product_id",
                     F.col("quantity").alias("qty"), F.col("unit_price").alias("price"))
    copies = F.when(F.col("k") % DEFECT_MOD == DUPLICATE_RESIDUE, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    i = i.withColumn("copy", F.explode(copies))
    first = not any(_repeats(df) for df in (t.orders, t.customers, t.products))
    if first:
        i = dense_ids(i, ["k", "copy"], "row_num", start=2, ranged=ranged)
    o = t.orders.select(F.col("id").alias("order_id"), F.col("customer_id"), "status", "placed_at")
    c = t.customers.select(F.col("id").alias("customer_id"), "email")
    p = t.products.select(F.col("id").alias("product_id"), "sku")
    o = o.join(c, "customer_id", "left").drop("customer_id")
    # The order's columns, which are the wide ones, come last.
    j = i.join(p, "product_id", "left").join(o, "order_id", "left")
    m = F.col("k") % DEFECT_MOD
    k = F.col("k").cast("string")
    number = ["row_num"] if first else ["k", "copy"]
    feed = j.select(
        *number,
        F.when(m == 0, "").when(m == 1, "   ")
         .otherwise(F.concat(F.lit("EXT-"), F.col("order_id").cast("string"))).alias("order_id"),
        F.when(m == 2, "").when(m == 13, F.concat(F.lit(" "), F.upper("email"), F.lit(" ")))
         .when(m == 15, F.concat(F.lit("nobody"), k, F.lit("@example.com")))
         .otherwise(F.col("email")).alias("customer_email"),
        F.when(m == 3, "").when(m == 14, F.lower("sku"))
         .when(m == 16, F.concat(F.lit("SKU-X"), k)).otherwise(F.col("sku")).alias("product_sku"),
        F.when(m == 4, "abc").when(m == 5, "0").when(m == 6, "-5")
         .otherwise(F.col("qty").cast("string")).alias("quantity"),
        F.when(m == 7, "-0.01").when(m == 8, "0")
         .otherwise(F.format_string("%.2f", F.col("price").cast("double"))).alias("unit_price"),
        F.when(m == 9, "not-a-date").when(m == 10, "2024-02-30")
         .when(m == 17, F.date_format("placed_at", "MM/dd/yyyy"))
         .when(m == 18, F.date_format("placed_at", "yyyy-MM-dd HH:mm:ss"))
         .otherwise(F.date_format("placed_at", "yyyy-MM-dd")).alias("order_date"),
        F.when(m == 11, "lost").when(m == 12, F.concat(F.lit(" "), _cap(F.col("status")), F.lit(" ")))
         .otherwise(F.col("status")).alias("status"),
    )
    numbered = feed if first else dense_ids(feed, ["k", "copy"], "row_num", start=2)
    return numbered.select("order_id", "customer_email", "product_sku", "quantity", "unit_price",
                           "order_date", "status", F.lit("derived:lineitem").alias("source_file"),
                           "row_num")
