"""The four reporting views, live over a run store.

Every run writes what it adds to the reports beside its rows: sums per product,
category, customer and month.  Orders and items are only ever added, and no two runs
share an order id (ids are reserved), so these sums, distinct order counts
included, add up over runs exactly.  The views sum the base tables' aggregates,
written once at registration, and the committed runs' small delta rows; they read
no old items.

The views are SQL text over the store's folders, which Spark resolves anew on
every use, so a run shows as soon as it is committed.  Ranks are planned inside the
view, without a window over the whole table: values fall into buckets that keep their
order (at most 28,160 on each side of zero, whatever the data), the rows before a bucket are
a running sum over the buckets, those before a value within its bucket one over
that bucket's distinct values.  Ties are numbered by id in the same way.

Order counts per category use the categories that products had when a run was
loaded, and the base tables' rows are those of the registration."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.expr import revenue_status
from tillpoint.session import checkpoint_dir
from tillpoint.sources.store import DELTA_SCHEMAS, RunStore
from tillpoint.sources.tables import Tables

NAMES = ("monthly_revenue_summary", "product_sales_ranking", "customer_lifetime_value", "category_performance")


def sales_deltas(orders: DataFrame, items: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """What these orders and their items add to the reports, by delta table."""
    counted = orders.filter(revenue_status("status"))
    ok = counted.select(F.col("id").alias("order_id"))
    of_product = items.groupBy("product_id").agg(
        F.countDistinct("order_id").alias("orders"), F.sum("quantity").alias("units"), F.sum("subtotal").alias("revenue"),
        F.sum("unit_price").alias("price_sum"), F.count("unit_price").alias("price_n"))
    of_category = (items.join(ok, "order_id", "left_semi")
                   .join(products.select(F.col("id").alias("product_id"), "category_id"), "product_id")
                   .groupBy("category_id").agg(F.countDistinct("order_id").alias("orders")))
    of_customer = counted.groupBy("customer_id").agg(
        F.count("id").alias("orders"), F.sum("total_amount").alias("revenue"),
        F.min("placed_at").alias("first_order_at"), F.max("placed_at").alias("last_order_at"))
    of_month = counted.groupBy(F.date_trunc("month", "placed_at").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total_amount").alias("revenue"))
    found = {"product_delta": of_product, "category_delta": of_category, "customer_delta": of_customer, "month_delta": of_month}
    return {name: df.select(*[F.col(c).cast(kind).alias(c) for c, kind in DELTA_SCHEMAS[name].items()]) for name, df in found.items()}


def _bucket(x: str) -> str:
    """SQL: a bucket number that never falls as the whole number ``x`` grows:
    the first ten binary digits and how many follow."""
    size = f"abs({x})"
    rest = f"greatest(length(bin({size})) - 10, 0)"
    plain = f"CAST({rest} * 512 + shiftright({size}, CAST({rest} AS INT)) AS BIGINT)"
    return f"(CASE WHEN {x} < 0 THEN -{plain} ELSE {plain} END)"


def _rank(rows: str, value: str, groups: str = "") -> str:
    """SQL: RANK() by ``value`` descending for each distinct value that is not
    NULL (NULLs, which rank first, come before all of them), within ``groups``."""
    by = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups}" if groups else ""
    return f"""
      SELECT {by}v, 1 + nulls + bucket_before + value_before AS place FROM (
        SELECT {by}v, b, coalesce(sum(n) OVER (PARTITION BY {by}b ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS value_before
        FROM (SELECT {by}{value} AS v, {_bucket(f'CAST({value} * 100 AS BIGINT)')} AS b, count(*) AS n
              FROM {rows} WHERE {value} IS NOT NULL GROUP BY ALL))
      JOIN (
        SELECT {by}b, coalesce(sum(n) OVER ({part} ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bucket_before,
               sum(nulls_here) OVER ({part}) AS nulls
        FROM (SELECT {by}{_bucket(f'CAST({value} * 100 AS BIGINT)')} AS b, count({value}) AS n, count_if({value} IS NULL) AS nulls_here
              FROM {rows} GROUP BY ALL)) USING ({by}b)"""


def _avg(total: str, n: str) -> str:
    return f"round({total} / nullif(CAST({n} AS DECIMAL(20,0)), CAST(0 AS DECIMAL(20,0))), 2)"


def _pct(part: str, whole: str) -> str:
    return f"round(CAST({part} * 100 AS DECIMAL(24,2)) / CAST(nullif({whole}, 0) AS DECIMAL(22,2)), 2)"


def register_live_views(t: Tables, store: RunStore, prefix: str = "") -> None:
    """Register ``t``'s customers, categories and products, the store's orders
    and items added to ``t``'s, and the four reporting views, all of them
    live for later commits of ``store``.  Money is DECIMAL as in the plain views.

    Raises ValueError if the store holds runs with orders but no deltas."""
    spark = t.spark
    has = lambda name: F.array_contains("tables", name)
    if store.markers().filter(has("orders") & ~has("product_delta")).limit(1).count():
        raise ValueError("the store holds runs that were written without deltas")
    store.prepare("orders", "order_items", *DELTA_SCHEMAS)
    p = prefix
    view = lambda name, text: spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {p}{name} AS {text}")
    for name in ("customers", "categories", "products"):
        t.get(name).createOrReplaceTempView(p + name)
    base = f"{checkpoint_dir(spark)}/tillpoint/views/{uuid.uuid4().hex}"
    for name, df in sales_deltas(t.orders, t.order_items, t.products).items():
        df.write.parquet(f"{base}/{name}")
    view("_commits", f"""SELECT e.run_id, e.attempt FROM (
        SELECT from_json(value, 'kind STRING, run_id STRING, attempt STRING') AS e FROM text.`{store.root}/_log`) WHERE e.kind = 'commit'""")
    committed = f"LEFT SEMI JOIN {p}_commits AS c ON d.run_id = c.run_id AND d.attempt = c.attempt"
    for name in ("orders", "order_items"):
        t.get(name).createOrReplaceTempView(f"{p}_base_{name}")
        cols = ", ".join(t.get(name).columns)
        view(name, f"SELECT {cols} FROM {p}_base_{name} UNION ALL SELECT {cols} FROM parquet.`{store.root}/{name}` AS d {committed}")
    for name, fields in DELTA_SCHEMAS.items():
        key, *sums = fields
        sums = [f"{ {'first_order_at': 'min', 'last_order_at': 'max'}.get(c, 'sum')}({c}) AS {c}" for c in sums]
        cols = ", ".join(fields)
        view(f"_{name}", f"""SELECT {key}, {', '.join(sums)} FROM (
            SELECT {cols} FROM parquet.`{base}/{name}`
            UNION ALL SELECT {cols} FROM parquet.`{store.root}/{name}` AS d {committed}) GROUP BY {key}""")

    view("monthly_revenue_summary", f"""
      SELECT month, orders AS order_count, round(revenue, 2) AS revenue, {_avg('revenue', 'orders')} AS avg_order_value,
             before AS prev_month_revenue, {_pct('(revenue - before)', 'before')} AS mom_growth_pct
      FROM (SELECT *, lag(revenue) OVER (ORDER BY month) AS before FROM {p}_month_delta) ORDER BY month""")

    view("_product_sales", f"""
      SELECT p.id AS product_id, p.sku, p.name AS product_name, p.category_id, c.name AS category,
             coalesce(d.orders, 0) AS times_ordered, d.units AS units_sold, d.revenue AS rev
      FROM {p}products AS p JOIN {p}categories AS c ON c.id = p.category_id LEFT JOIN {p}_product_delta AS d ON d.product_id = p.id""")
    view("product_sales_ranking", f"""
      SELECT s.product_id, s.sku, s.product_name, s.category, s.times_ordered, s.units_sold, round(s.rev, 2) AS total_revenue,
             coalesce(a.place, 1) AS revenue_rank, coalesce(g.place, 1) AS rank_in_category
      FROM {p}_product_sales AS s
      LEFT JOIN ({_rank(f'{p}_product_sales', 'rev')}) AS a ON a.v = s.rev
      LEFT JOIN ({_rank(f'{p}_product_sales', 'rev', 'category_id')}) AS g ON g.category_id = s.category_id AND g.v = s.rev
      ORDER BY revenue_rank, product_id""")

    view("category_performance", f"""
      SELECT category_id, category, order_count, units_sold, round(rev, 2) AS total_revenue, {_avg('price_sum', 'price_n')} AS avg_unit_price,
             {_pct('rev', 'all_rev')} AS revenue_share_pct
      FROM (SELECT c.id AS category_id, c.name AS category, coalesce(o.orders, 0) AS order_count, s.units_sold, s.rev, s.price_sum, s.price_n,
                   sum(s.rev) OVER () AS all_rev
            FROM {p}categories AS c
            LEFT JOIN (SELECT p.category_id, sum(units) AS units_sold, sum(revenue) AS rev, sum(price_sum) AS price_sum, sum(price_n) AS price_n
                       FROM {p}_product_delta AS d JOIN {p}products AS p ON p.id = d.product_id GROUP BY p.category_id) AS s ON s.category_id = c.id
            LEFT JOIN {p}_category_delta AS o ON o.category_id = c.id)
      ORDER BY total_revenue DESC NULLS LAST, category_id""")

    # NTILE needs a place for every row: rows of one value are numbered by id,
    # within buckets of ids.  NULL values come first, in a bucket of their own.
    cents = _bucket("CAST(spent * 100 AS BIGINT)")
    view("_customer_value", f"""
      SELECT c.id AS customer_id, c.email, concat(c.first_name, ' ', c.last_name) AS full_name, c.country,
             coalesce(d.orders, 0) AS total_orders, d.revenue AS spent, d.first_order_at, d.last_order_at
      FROM {p}customers AS c LEFT JOIN {p}_customer_delta AS d ON d.customer_id = c.id""")
    view("_value_cells", f"""
      SELECT {cents} AS b, spent, {_bucket('customer_id')} AS ids, count(*) AS n FROM {p}_customer_value GROUP BY ALL""")
    view("_value_places", f"""
      SELECT spent, ids, earlier + before AS before, total FROM (
        SELECT b, spent, ids, coalesce(sum(n) OVER (PARTITION BY b ORDER BY spent DESC, ids ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM {p}_value_cells) AS cell
      JOIN (SELECT b, coalesce(sum(n) OVER (ORDER BY b DESC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
                   sum(n) OVER () AS total
            FROM (SELECT b, sum(n) AS n FROM {p}_value_cells GROUP BY b)) AS bucket ON cell.b <=> bucket.b""")
    view("customer_lifetime_value", f"""
      SELECT customer_id, email, full_name, country, total_orders, round(spent, 2) AS lifetime_value,
             {_avg('spent', 'total_orders')} AS avg_order_value, first_order_at, last_order_at,
             CAST((unix_micros(current_timestamp()) - unix_micros(last_order_at)) DIV 86400000000 AS INT) AS days_since_last_order,
             CAST(CASE WHEN place <= (total % 4) * (total DIV 4 + 1) THEN (place - 1) DIV (total DIV 4 + 1) + 1
                       ELSE total % 4 + (place - 1 - (total % 4) * (total DIV 4 + 1)) DIV greatest(total DIV 4, 1) + 1 END AS INT) AS ltv_quartile
      FROM (SELECT v.*, w.total, w.before + row_number() OVER (PARTITION BY v.spent, v.ids ORDER BY v.customer_id) AS place
            FROM (SELECT *, {_bucket('customer_id')} AS ids FROM {p}_customer_value) AS v
            JOIN {p}_value_places AS w ON v.spent <=> w.spent AND v.ids = w.ids)
      ORDER BY lifetime_value DESC NULLS LAST, customer_id""")
