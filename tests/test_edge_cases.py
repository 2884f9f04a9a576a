"""Edge-case frames (FIXTURES.md section 3)."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from seed import CATEGORIES, CUSTOMERS, ORDER_ITEMS, ORDERS, PRODUCTS, seed_tables
from tillpoint.functions import expr as E
from tillpoint.operators import contracts as K
from tillpoint.plans import analytics as A
from tillpoint.plans import catalog as C

AS_OF = dt.datetime(2024, 4, 1)


@pytest.fixture(scope="module")
def edge(spark):
    """Seed plus: a never-sold product (18), a customer without orders (16),
    a cancelled-only customer (17) whose order has items, a category with no
    products (6)."""
    products = PRODUCTS + [(18, 1, "ELEC-006", "Never Sold Gadget", "10.00", 5)]
    customers = CUSTOMERS + [(16, "no.orders@email.com", "No", "Orders", "Portugal", "Faro", "2023-10-01 00:00:00"),
                             (17, "cancel@email.com", "Can", "Celled", "Spain", "Sevilla", "2023-10-01 00:00:00")]
    orders = ORDERS + [(21, 17, "cancelled", "100.00", "2024-03-20 10:00:00", None, None)]
    items = ORDER_ITEMS + [(21, 9, 1, "100.00")]
    categories = CATEGORIES + [(6, "Garden", "Outdoor")]
    return seed_tables(spark, orders=orders, items=items, customers=customers, products=products,
                       categories=categories)


@pytest.mark.parametrize("force", ["window", "distributed"])
def test_never_sold_product_ranks_first(edge, force):
    r = {x.product_id: x for x in A.product_sales_ranking(edge, force=force).collect()}
    assert (r[18].times_ordered, r[18].units_sold, r[18].total_revenue) == (0, None, None)
    assert (r[18].revenue_rank, r[18].rank_in_category) == (1, 1)
    assert r[4].revenue_rank == 2 and r[4].rank_in_category == 2


def test_top_products_puts_never_sold_first(edge):
    assert [r.product_id for r in A.top_products(edge, 2).collect()] == [18, 4]


@pytest.mark.parametrize("force", ["window", "distributed"])
def test_customer_without_orders(edge, force):
    got = A.customer_lifetime_value(edge, as_of=AS_OF, force=force).collect()
    by = {r.customer_id: r for r in got}
    for c in (16, 17):
        assert (by[c].total_orders, by[c].lifetime_value, by[c].days_since_last_order) == (0, None, None)
        assert by[c].ltv_quartile == 1
    assert [r.customer_id for r in got][-2:] == [16, 17]       # NULLS LAST in the view order
    top = A.top_customers(edge, 20)
    assert 17 not in [r.customer_id for r in top.collect()]


def test_customer_stats_with_null_rows(edge):
    full = [tuple(r) for r in A.customer_lifetime_value(edge, as_of=AS_OF).collect()]
    assert [tuple(r) for r in A.customer_stats(edge, 17, as_of=AS_OF).collect()] == full


def test_cancelled_items_count_in_revenue_not_orders(edge, seed):
    base = {r.category_id: r for r in A.category_performance(seed).collect()}
    got = {r.category_id: r for r in A.category_performance(edge).collect()}
    assert got[3].total_revenue == base[3].total_revenue + D("100.00")
    assert got[3].order_count == base[3].order_count
    assert got[6].total_revenue is None and got[6].order_count == 0
    api = [r.category_id for r in A.category_performance(edge, api_form=True).collect()]
    assert 6 not in api
    excl = {r.category_id: r for r in A.category_performance(edge, exclude_cancelled=True).collect()}
    assert excl[3].total_revenue == base[3].total_revenue
    q2 = {r.product_id: r for r in A.product_sales_ranking(edge).collect()}
    assert q2[9].total_revenue == D("229.99")
    months = {r.month: r for r in A.monthly_revenue_summary(edge).collect()}
    assert months[dt.datetime(2024, 3, 1)].order_count == 4


def test_zero_previous_month_gives_null_growth(spark):
    orders = [(1, 1, "delivered", "0.00", "2024-01-05 00:00:00", None, None),
              (2, 1, "delivered", "10.00", "2024-02-05 00:00:00", None, None)]
    t = seed_tables(spark, orders=orders, items=[(1, 1, 1, "1.00")])
    got = A.monthly_revenue_summary(t).collect()
    assert got[1].prev_month_revenue == D("0.00") and got[1].mom_growth_pct is None


def test_equal_revenues_share_rank(spark):
    items = [(1, 1, 1, "10.00"), (2, 2, 1, "10.00"), (3, 3, 1, "5.00")]
    t = seed_tables(spark, items=items, orders=ORDERS[:3])
    r = {x.product_id: x.revenue_rank for x in A.product_sales_ranking(t, force="distributed").collect()}
    never_sold = [p for p in r if p not in (1, 2, 3)]
    assert r[1] == r[2] == len(never_sold) + 1 and r[3] == len(never_sold) + 3


def test_empty_tables(spark, seed):
    empty = seed.with_(orders=seed.orders.limit(0), order_items=seed.order_items.limit(0))
    assert A.monthly_revenue_summary(empty).count() == 0
    assert A.top_customers(empty, 5).count() == 0
    assert A.sales_by_period(empty, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)).count() == 0
    assert C.order_detail(empty, 1).count() == 0


def test_order_without_items(spark):
    t = seed_tables(spark, items=[(1, 1, 1, "89.99")])
    assert C.order_detail(t, 2).count() == 0
    one = C.order_detail(t, 1).collect()
    assert len(one) == 1 and one[0].customer.email == "ana.silva@email.com"
    assert one[0]["items"][0].product.sku == "ELEC-001"


@pytest.mark.parametrize("call", [
    lambda t: A.top_products(t, 0), lambda t: A.top_products(t, 101), lambda t: A.customer_stats(t, 201),
    lambda t: C.orders_page(t, 0, 20), lambda t: C.orders_page(t, 1, 101),
    lambda t: C.orders_page(t, 1, 20, "lost"),
    lambda t: A.sales_by_period(t, dt.datetime(2024, 2, 1), dt.datetime(2024, 1, 1)),
    lambda t: A.sales_by_period(t, dt.datetime(2023, 1, 1), dt.datetime(2024, 1, 2)),
])
def test_argument_errors(seed, call):
    with pytest.raises(ValueError):
        call(seed)


def test_status_filter_case_insensitive(seed):
    a = C.orders_page(seed, 1, 20, "SHIPPED")
    assert a.total_count == 1 and [r.id for r in a.items.collect()] == [18]


def test_page_beyond_end(seed):
    p = C.orders_page(seed, 5, 10)
    assert p.items.count() == 0 and p.total_pages == 2 and not p.has_next_page and p.has_prev_page


def test_pages_concatenate_to_full_sort(seed):
    full = [r.id for r in seed.orders.orderBy(seed.orders.placed_at.desc(), seed.orders.id.desc()).collect()]
    pages = []
    for n in range(1, 5):
        pages += [r.id for r in C.orders_page(seed, n, 6).items.collect()]
    assert pages == full
    keyset, after = [], None
    while True:
        chunk = C.orders_page_after(seed, 7, after).collect()
        if not chunk:
            break
        keyset += [r.id for r in chunk]
        after = (chunk[-1].placed_at, chunk[-1].id)
    assert keyset == full


def test_catalog_lookups(seed, spark):
    assert C.customer_by_id(seed, 6).first().last_name == "Müller"
    assert C.customer_by_id(seed, 99).count() == 0
    p = C.product_by_id(seed, 4).first()
    assert p.category.name == "Electronics" and p.unit_price == D("329.00")
    assert [r.name for r in C.products_by_category(seed, 4).collect()] == [
        "Clean Code", "Designing Data-Intensive Applications", "The Pragmatic Programmer"]
    assert [r.id for r in C.orders_by_customer(seed, 1).collect()] == [16, 6, 1]
    ids = spark.createDataFrame([(1,), (3,)], "id long")
    assert sorted(r.id for r in C.order_detail_lines(seed, order_ids=ids).collect()) == [1, 1, 3]
    assert C.customers_page(seed, 1, 5).total_count == 15
    assert C.products_page(seed, 4, 5).items.count() == 2
    first = C.customers_page(seed, 1, 2).items.collect()
    assert [r.id for r in first] == [15, 14]
    full = C.order_detail(seed, 12).first()
    assert [i.id for i in full["items"]] == [16, 17, 18]


def test_q1_total_equals_q7_over_full_range(seed):
    q1 = sum(r.revenue for r in A.monthly_revenue_summary(seed).collect())
    q7a = A.sales_by_period(seed, dt.datetime(2023, 10, 1), dt.datetime(2024, 3, 31)).collect()
    assert q1 == sum(r.revenue for r in q7a)


def test_exclude_cancelled_variant_for_products(edge, seed):
    base = {r.product_id: r.total_revenue for r in A.product_sales_ranking(seed).collect()}
    excl = {r.product_id: r.total_revenue for r in A.product_sales_ranking(edge, exclude_cancelled=True).collect()}
    assert excl[9] == base[9] and excl[18] is None
    assert [r.product_id for r in A.top_products(edge, 1, exclude_cancelled=True).collect()] == [18]


def test_pages_put_together_are_the_whole(seed):
    o = seed.orders
    full = [r.id for r in o.orderBy(o.placed_at.desc(), o.id.desc()).collect()]
    got = []
    for n in range(1, 5):
        got += [r.id for r in C.orders_page(seed, n, 6).items.collect()]
    assert got == full
    c = seed.customers
    fullc = [r.id for r in c.orderBy(c.created_at.desc(), c.id.desc()).collect()]
    gotc = []
    for n in range(1, 4):
        gotc += [r.id for r in C.customers_page(seed, n, 6).items.collect()]
    assert gotc == fullc
    p = seed.products
    fullp = [r.id for r in p.orderBy(p.name, p.id).collect()]
    gotp = []
    for n in range(1, 4):
        gotp += [r.id for r in C.products_page(seed, n, 7).items.collect()]
    assert gotp == fullp


def test_orders_page_with_orphan_order(spark):
    orders = ORDERS + [(21, 99, "pending", "1.00", "2024-04-01 00:00:00", None, None)]
    t = seed_tables(spark, orders=orders)
    page = C.orders_page(t, 1, 3)
    assert page.total_count == 21                    # the count query does not join
    assert [r.id for r in page.items.collect()] == [20, 19, 18]   # join-then-page drops order 21
    assert [r.id for r in C.orders_page_after(t, 2).collect()] == [20, 19]


def test_top_customers_with_orphan_top_spender(spark):
    orders = ORDERS + [(21, 99, "delivered", "9999.00", "2024-04-01 00:00:00", None, None)]
    t = seed_tables(spark, orders=orders)
    assert [r.customer_id for r in A.top_customers(t, 2).collect()] == [6, 1]


def test_keyset_pages_for_customers_and_products(seed):
    c = seed.customers
    full = [r.id for r in c.orderBy(c.created_at.desc(), c.id.desc()).collect()]
    got, after = [], None
    while True:
        chunk = C.customers_page_after(seed, 4, after).collect()
        if not chunk:
            break
        got += [r.id for r in chunk]
        after = (chunk[-1].created_at, chunk[-1].id)
    assert got == full
    p = seed.products
    fullp = [r.id for r in p.orderBy(p.name, p.id).collect()]
    gotp, after = [], None
    while True:
        chunk = C.products_page_after(seed, 5, after).collect()
        if not chunk:
            break
        gotp += [r.id for r in chunk]
        after = (chunk[-1].name, chunk[-1].id)
    assert gotp == fullp


def test_percentage_is_rounded_once(spark):
    """12.344996 % is 12.34, whatever the money columns' types."""
    row = spark.sql("SELECT CAST(12344996 AS DECIMAL(38,2)) AS part, CAST(100000000 AS DECIMAL(38,2)) AS whole, "
                    "CAST(0 AS DECIMAL(38,2)) AS none")
    got = row.select(E.pct_of(F.col("part"), F.col("whole")), E.pct_of(F.col("part"), F.col("none"))).first()
    assert float(got[0]) == 12.34 and got[1] is None
    half = spark.sql("SELECT CAST(12345 AS DECIMAL(38,2)) AS part, CAST(100000 AS DECIMAL(38,2)) AS whole")
    assert float(half.select(E.pct_of(F.col("part"), F.col("whole"))).first()[0]) == 12.35


def test_insert_if_absent_with_null_keys_and_several_keys(spark):
    schema = "id long, email string, sku string"
    target = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], schema)
    incoming = spark.createDataFrame([(3, "a", "p"), (4, None, "q"), (5, None, "q"), (6, "b", "x"), (8, "c", "r"), (7, "c", "s")], schema)
    got = K.insert_if_absent(target, incoming, ["email"], prefer="id")
    assert sorted(r.id for r in got.collect()) == [1, 2, 4, 5, 6, 7]
    both = K.insert_if_absent(target, incoming, [["email"], ["sku"]], prefer="id")
    assert sorted(r.id for r in both.collect()) == [1, 2, 4, 7]


def test_json_documents_rename_nested_fields_and_keep_nulls(spark):
    import json
    from tillpoint.sources.sinks import to_json_documents
    df = spark.sql("SELECT 1 AS order_id, CAST(NULL AS STRING) AS shipped_at, named_struct('first_name', 'A', 'last_name', NULL) AS the_customer, "
                   "array(named_struct('unit_price', 2)) AS order_items")
    assert json.loads(to_json_documents(df).first()[0]) == {
        "orderId": 1, "shippedAt": None, "theCustomer": {"firstName": "A", "lastName": None}, "orderItems": [{"unitPrice": 2}]}
