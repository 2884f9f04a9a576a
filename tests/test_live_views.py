"""Live reporting views over a run store, against the plain queries."""

import os

import pytest
from pyspark.sql import functions as F

from tillpoint.plans import analytics as A
from tillpoint.plans import feed_load as L
from tillpoint.plans import live_views as V
from tillpoint.sources.store import RunStore

HEADER = "order_id,customer_email,product_sku,quantity,unit_price,order_date,status\n"


def feed(path, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.write(HEADER + "\n".join(rows) + "\n")
    return path


def check(spark, t, prefix):
    plain = {"monthly_revenue_summary": A.monthly_revenue_summary(t), "product_sales_ranking": A.product_sales_ranking(t),
             "customer_lifetime_value": A.customer_lifetime_value(t), "category_performance": A.category_performance(t)}
    for name in V.NAMES:
        live = spark.table(prefix + name)
        assert live.columns == plain[name].columns
        assert [tuple(r) for r in live.collect()] == [tuple(r) for r in plain[name].collect()], name


def test_views_show_runs_committed_after_registration(spark, seed, scratch):
    store = RunStore(spark, os.path.join(scratch, "store"))
    V.register_live_views(seed, store, "lv_")
    check(spark, seed, "lv_")
    for n, rows in enumerate((
            ["N1,ana.silva@email.com,ELEC-001,2,10.00,2024-03-01,delivered", "N2,ana.silva@email.com,ELEC-001,1,7.55,2024-04-01,cancelled"],
            ["N1,ana.silva@email.com,ELEC-001,2,10.00,2024-03-01,delivered", "N3,ana.silva@email.com,ELEC-002,3,1.99,2025-01-31,shipped"])):
        res = L.load_feed(seed, feed(os.path.join(scratch, f"f{n}.csv"), rows), store)
        assert res.records_loaded >= 1
    now = store.current(seed)
    assert spark.table("lv_orders").count() == seed.orders.count() + 3 == now.orders.count()
    check(spark, now, "lv_")
    # Nothing uncommitted shows.
    now.orders.limit(1).write.parquet(f"{store.root}/orders/run_id=x/attempt=y")
    assert spark.table("lv_orders").count() == now.orders.count()
    # The reports read no published items.
    files = "\n".join(f for name in V.NAMES for f in spark.table("lv_" + name).inputFiles())
    assert "/product_delta/" in files and "/store/order_items" not in files and "/store/orders" not in files


def test_ranks_of_many_values(spark, seed, scratch):
    n = 3000
    # Ties, products never sold, values over many powers of two.
    products = spark.range(1, n + 1).select(
        "id", (F.col("id") % 3 + 1).alias("category_id"), F.concat(F.lit("S"), "id").alias("sku"), F.lit("p").alias("name"),
        F.lit(None).cast("string").alias("description"), F.lit(1).cast("decimal(10,2)").alias("unit_price"), F.lit(1).alias("stock"),
        F.lit(True).alias("is_active"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    sold = products.filter(F.col("id") % 4 != 0)
    price = F.pow(F.lit(1.7), F.col("id") % 30).cast("decimal(10,2)")
    items = sold.select("id", (F.col("id") % 20 + 1).alias("order_id"), F.col("id").alias("product_id"), F.lit(1).alias("quantity"),
                        price.alias("unit_price"), price.cast("decimal(12,2)").alias("subtotal"))
    customers = spark.range(1, 1501).select(
        "id", F.concat(F.lit("e"), "id").alias("email"), F.lit("a").alias("first_name"), F.lit("b").alias("last_name"),
        F.lit("PT").alias("country"))
    orders = spark.range(1, 4001).select(
        "id", (F.col("id") * 7 % 900 + 1).alias("customer_id"), F.lit("delivered").alias("status"),
        F.pow(F.lit(1.3), F.col("id") % 37).cast("decimal(12,2)").alias("total_amount"), F.lit("USD").alias("currency"),
        F.lit("2024-02-01").cast("timestamp").alias("placed_at"), F.lit(None).cast("timestamp").alias("shipped_at"),
        F.lit(None).cast("timestamp").alias("delivered_at"))
    t = seed.with_(products=products, order_items=items, customers=customers, orders=orders)
    V.register_live_views(t, RunStore(spark, os.path.join(scratch, "store")), "rk_")
    check(spark, t, "rk_")


@pytest.mark.parametrize("top", [40, 2000, 10 ** 6, 2 ** 63 - 1])
def test_buckets_keep_the_order(spark, top):
    xs = sorted({x for k in range(400) for x in (top * k // 400, -(top * k // 400))} | {top, 1023, 1024, 1025, 2047, 2048})
    rows = spark.createDataFrame([(x,) for x in xs], "x long").selectExpr("x", V._bucket("x") + " AS b").orderBy("x").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)
    assert max(abs(r.b) for r in rows) < 28160


def test_a_store_without_deltas_is_refused(spark, seed, scratch):
    store = RunStore(spark, os.path.join(scratch, "store"))
    store.publish("old", {"orders": seed.orders, "order_items": seed.order_items})
    with pytest.raises(ValueError):
        V.register_live_views(seed, store, "old_")
