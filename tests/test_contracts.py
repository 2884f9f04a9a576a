"""Table contract job and write-side helpers."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from seed import ORDER_ITEMS, ORDERS, seed_tables
from tillpoint.operators import contracts as K


def violations(df):
    return {(r.table, r.rule, r.column): r.violations for r in df.collect()}


def test_seed_is_clean(seed):
    v = violations(K.validate_contract(seed))
    assert v and all(n == 0 for n in v.values())
    assert ("orders", "domain", "status") in v and ("order_items", "foreign_key", "order_id->orders.id") in v


def test_violations_found(spark):
    orders = ORDERS + [(21, 99, "lost", "-1.00", "2024-03-20 10:00:00", None, None),
                       (21, 1, "pending", "5.00", "2024-03-21 10:00:00", None, None)]
    items = ORDER_ITEMS + [(77, 1, 0, "5.00"), (1, 999, 1, "5.00")]
    t = seed_tables(spark, orders=orders, items=items)
    bad_sub = t.order_items.withColumn(
        "subtotal", F.when(F.col("id") == 1, F.lit(D("1.00"))).otherwise(F.col("subtotal")))
    t = t.with_(order_items=bad_sub)
    v = violations(K.validate_contract(t))
    assert v[("orders", "domain", "status")] == 1
    assert v[("orders", "range>=0", "total_amount")] == 1
    assert v[("orders", "unique", "id")] == 1
    assert v[("orders", "foreign_key", "customer_id->customers.id")] == 1
    assert v[("order_items", "range>0", "quantity")] == 1
    assert v[("order_items", "foreign_key", "order_id->orders.id")] == 1
    assert v[("order_items", "foreign_key", "product_id->products.id")] == 1
    assert v[("order_items", "generated", "subtotal")] == 1
    rows = K.violating_rows(t, "orders").collect()
    assert sorted(r.violated for r in rows)[0] == ["range>=0:total_amount", "domain:status"] or len(rows) == 1


def test_insert_if_absent_is_idempotent(seed, spark):
    target = seed.categories.filter(F.col("id") <= 3)
    incoming = seed.categories.unionByName(seed.categories)
    once = K.insert_if_absent(target, incoming, ["name"], prefer="id")
    assert sorted(r.id for r in once.collect()) == [1, 2, 3, 4, 5]
    twice = K.insert_if_absent(once, incoming, ["name"], prefer="id")
    assert sorted(r.id for r in twice.collect()) == [1, 2, 3, 4, 5]


def test_defaults_and_cascade(seed, spark):
    raw = spark.createDataFrame([(30, 1, D("5.00"))], "id long, customer_id long, total_amount decimal(12,2)")
    o = K.apply_defaults(raw, "orders").first()
    assert (o.status, o.currency) == ("pending", "USD") and o.placed_at is not None
    kept = K.delete_cascade(seed, seed.orders.filter(F.col("id") != 1))
    assert kept.order_items.filter(F.col("order_id") == 1).count() == 0
    assert kept.order_items.count() == 28
    ids = K.assign_ids(spark.createDataFrame([(3,), (1,), (2,)], "seq long"), seed.orders, ["seq"])
    assert sorted((r.seq, r.id) for r in ids.collect()) == [(1, 21), (2, 22), (3, 23)]
