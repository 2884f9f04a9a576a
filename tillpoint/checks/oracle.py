"""Independent DuckDB SQL for each gated query.

The model tables are re-derived from the supplied tables by the CTE
``PREFIX`` (same binding as ``tillpoint.sources.testdata``).  Money is
computed in integer cents and rounded half-up with integer arithmetic;
results are cast to BIGINT / DOUBLE at the very end.
"""

from __future__ import annotations

PREFIX = """
WITH
cust AS (
  SELECT c.c_custkey AS id,
         lower(replace(c.c_name, '#', '.')) || '@example.com' AS email,
         substr(c.c_name, 1, 8) AS first_name,
         substr(c.c_name, 10) AS last_name,
         n.n_name AS country,
         c.c_mktsegment AS city,
         TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST(c.c_custkey % 365 AS INTEGER)) AS created_at,
         (c.c_custkey % 10 <> 0) AS is_active
  FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey),
cat AS (
  SELECT * FROM (VALUES (1, 'ECONOMY'), (2, 'LARGE'), (3, 'MEDIUM'), (4, 'PROMO'),
                        (5, 'SMALL'), (6, 'STANDARD')) v(id, name)),
prod AS (
  SELECT p_partkey AS id,
         CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
                     WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END AS category_id,
         printf('SKU-%06d', p_partkey) AS sku,
         p_name AS name, p_brand AS description,
         CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price,
         CAST(round(p_retailprice * 100) AS BIGINT) AS price_c,
         p_size AS stock, (p_partkey % 10 <> 0) AS is_active,
         TIMESTAMP '1995-01-01 00:00:00' AS created_at
  FROM part),
ord AS (
  SELECT o_orderkey AS id, o_custkey AS customer_id,
         CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority = '5-LOW' THEN 'refunded' ELSE 'delivered' END
              WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderpriority = '5-LOW' THEN 'cancelled'
                                                 WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'shipped'
                                                 ELSE 'confirmed' END
              WHEN o_orderstatus = 'P' THEN 'pending' END AS status,
         CAST(round(o_totalprice * 100) AS BIGINT) AS total_c,
         'USD' AS currency,
         o_orderdate AS placed_at
  FROM orders),
item AS (
  SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
             l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS id,
         l_orderkey AS order_id, l_partkey AS product_id,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS price_c,
         CAST(l_quantity AS INTEGER) * CAST(round(l_extendedprice * 100) AS BIGINT) AS sub_c
  FROM lineitem),
ok AS (SELECT * FROM ord WHERE status NOT IN ('cancelled', 'refunded'))
"""


def _half_up(num: str, den: str) -> str:
    """round(num/den) half away from zero for num >= 0, den > 0 (integers)."""
    return f"((2 * ({num}) + ({den})) // (2 * ({den})))"


def _signed_pct(cur: str, prev: str) -> str:
    """ROUND((cur - prev) / prev * 100, 2) as a double, cents in, prev > 0."""
    mag = _half_up(f"abs(({cur}) - ({prev})) * 10000", prev)
    return (f"CASE WHEN ({prev}) IS NULL OR ({prev}) = 0 THEN NULL "
            f"WHEN ({cur}) >= ({prev}) THEN {mag} / 100.0 ELSE -({mag}) / 100.0 END")


Q = {}

Q["monthly_revenue_summary"] = PREFIX + f"""
, m AS (SELECT date_trunc('month', placed_at) AS month, count(*) AS n, sum(total_c) AS c
        FROM ok GROUP BY 1),
w AS (SELECT *, lag(c) OVER (ORDER BY month) AS p FROM m)
SELECT CAST(month AS TIMESTAMP) AS month, CAST(n AS BIGINT) AS order_count,
       CAST(c AS DOUBLE) / 100.0 AS revenue,
       CAST({_half_up('c', 'n')} AS DOUBLE) / 100.0 AS avg_order_value,
       CAST(p AS DOUBLE) / 100.0 AS prev_month_revenue,
       {_signed_pct('c', 'p')} AS mom_growth_pct
FROM w"""

_PRODUCT_BASE = """
, ia AS (SELECT product_id, count(DISTINCT order_id) AS times, sum(quantity) AS units, sum(sub_c) AS rev
         FROM item GROUP BY product_id),
pb AS (SELECT p.id AS product_id, p.sku, p.name AS product_name, c.id AS category_id, c.name AS category,
              coalesce(ia.times, 0) AS times, ia.units, ia.rev
       FROM prod p JOIN cat c ON c.id = p.category_id LEFT JOIN ia ON ia.product_id = p.id)
"""

Q["product_sales_ranking"] = PREFIX + _PRODUCT_BASE + """
SELECT product_id, sku, product_name, category, CAST(times AS BIGINT) AS times_ordered,
       CAST(units AS BIGINT) AS units_sold, CAST(rev AS DOUBLE) / 100.0 AS total_revenue,
       CAST(rank() OVER (ORDER BY rev DESC NULLS FIRST) AS BIGINT) AS revenue_rank,
       CAST(rank() OVER (PARTITION BY category_id ORDER BY rev DESC NULLS FIRST) AS BIGINT) AS rank_in_category
FROM pb"""

Q["top_products"] = PREFIX + _PRODUCT_BASE + """
, r AS (SELECT *, rank() OVER (ORDER BY rev DESC NULLS FIRST) AS rk,
               row_number() OVER (ORDER BY rev DESC NULLS FIRST, product_id) AS rn FROM pb)
SELECT product_id, sku, product_name, category, CAST(times AS BIGINT) AS times_ordered,
       CAST(units AS BIGINT) AS units_sold, CAST(rev AS DOUBLE) / 100.0 AS total_revenue,
       CAST(rk AS BIGINT) AS revenue_rank
FROM r WHERE rn <= 10"""

AS_OF = "TIMESTAMP '2001-09-01 00:00:00'"

_CLV_BASE = f"""
, oa AS (SELECT customer_id, count(id) AS n, sum(total_c) AS s, min(placed_at) AS first_at,
                max(placed_at) AS last_at FROM ok GROUP BY customer_id),
cb AS (SELECT c.id AS customer_id, c.email, c.first_name || ' ' || c.last_name AS full_name, c.country,
              coalesce(oa.n, 0) AS n, oa.s, oa.first_at, oa.last_at,
              ntile(4) OVER (ORDER BY oa.s DESC NULLS FIRST, c.id) AS q
       FROM cust c LEFT JOIN oa ON oa.customer_id = c.id)
"""
_CLV_SELECT = f"""
SELECT customer_id, email, full_name, country, CAST(n AS BIGINT) AS total_orders,
       CAST(s AS DOUBLE) / 100.0 AS lifetime_value,
       CASE WHEN n = 0 THEN NULL ELSE CAST({_half_up('s', 'n')} AS DOUBLE) / 100.0 END AS avg_order_value,
       CAST(first_at AS TIMESTAMP) AS first_order_at, CAST(last_at AS TIMESTAMP) AS last_order_at,
       CAST((epoch_us({AS_OF}) - epoch_us(last_at)) // 86400000000 AS BIGINT) AS days_since_last_order,
       CAST(q AS BIGINT) AS ltv_quartile
"""

Q["customer_lifetime_value"] = PREFIX + _CLV_BASE + _CLV_SELECT + " FROM cb"

Q["customer_stats"] = PREFIX + _CLV_BASE + """
, r AS (SELECT *, row_number() OVER (ORDER BY s DESC NULLS LAST, customer_id) AS rn FROM cb)
""" + _CLV_SELECT + " FROM r WHERE rn <= 20"

Q["category_performance"] = PREFIX + f"""
, pc AS (SELECT i.product_id, p.category_id, i.quantity, i.price_c, i.sub_c, i.order_id
         FROM item i JOIN prod p ON p.id = i.product_id),
ca AS (SELECT category_id, sum(quantity) AS units, sum(sub_c) AS rev, sum(price_c) AS price_sum,
              count(price_c) AS price_n FROM pc GROUP BY category_id),
co AS (SELECT category_id, count(DISTINCT pc.order_id) AS n_orders FROM pc
       WHERE pc.order_id IN (SELECT id FROM ok) GROUP BY category_id),
j AS (SELECT c.id AS category_id, c.name AS category, coalesce(co.n_orders, 0) AS n_orders,
             ca.units, ca.rev, ca.price_sum, ca.price_n, sum(ca.rev) OVER () AS total
      FROM cat c LEFT JOIN ca ON ca.category_id = c.id LEFT JOIN co ON co.category_id = c.id)
SELECT CAST(category_id AS BIGINT) AS category_id, category, CAST(n_orders AS BIGINT) AS order_count,
       CAST(units AS BIGINT) AS units_sold, CAST(rev AS DOUBLE) / 100.0 AS total_revenue,
       CASE WHEN price_n IS NULL OR price_n = 0 THEN NULL
            ELSE CAST({_half_up('price_sum', 'price_n')} AS DOUBLE) / 100.0 END AS avg_unit_price,
       CASE WHEN rev IS NULL OR total IS NULL OR total = 0 THEN NULL
            ELSE CAST({_half_up('rev * 10000', 'total')} AS DOUBLE) / 100.0 END AS revenue_share_pct
FROM j"""

PERIOD = ("TIMESTAMP '1997-01-01 00:00:00'", "TIMESTAMP '1997-12-31 00:00:00'")

Q["sales_by_period"] = PREFIX + f"""
, d AS (SELECT CAST(placed_at AS DATE) AS sale_date, count(*) AS n, sum(total_c) AS c
        FROM ok WHERE placed_at BETWEEN {PERIOD[0]} AND {PERIOD[1]} GROUP BY 1)
SELECT sale_date, CAST(n AS BIGINT) AS order_count, CAST(c AS DOUBLE) / 100.0 AS revenue,
       CAST({_half_up('c', 'n')} AS DOUBLE) / 100.0 AS avg_order_value
FROM d"""


def _top_customers(limit: int, country: str | None) -> str:
    where = f"WHERE c.country = '{country}'" if country else ""
    return PREFIX + f"""
, g AS (SELECT c.id AS customer_id, c.first_name || ' ' || c.last_name AS full_name, c.email, c.country,
               count(o.id) AS n, sum(o.total_c) AS s
        FROM cust c JOIN ok o ON o.customer_id = c.id {where}
        GROUP BY c.id, c.first_name, c.last_name, c.email, c.country),
r AS (SELECT *, row_number() OVER (ORDER BY s DESC, customer_id) AS rn FROM g)
SELECT customer_id, full_name, email, country, CAST(n AS BIGINT) AS total_orders,
       CAST(s AS DOUBLE) / 100.0 AS total_spent
FROM r WHERE rn <= {limit}"""


TOP_COUNTRY = "NATION_7"
Q["top_customers"] = _top_customers(10, None)
Q["top_customers_country"] = _top_customers(5, TOP_COUNTRY)


# Placement: every order is a request of its lines, placed one by one in key
# order by a recursive query that carries the stock of all products.
_PLACE = """
, line AS (SELECT l_orderkey AS rid, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS q,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INTEGER)) AS pos
           FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
act AS MATERIALIZED (SELECT id, price_c, stock, row_number() OVER (ORDER BY id) AS i FROM prod WHERE is_active),
flag AS (SELECT rid, bool_or(q IS NULL OR q <= 0) AS bad_q, bool_or(act.id IS NULL) AS bad_p
         FROM line LEFT JOIN act ON act.id = line.product_id GROUP BY rid),
chk AS MATERIALIZED (
  SELECT o_orderkey AS rid, o_custkey AS customer_id,
         CASE WHEN bad_q THEN 'bad_quantity' WHEN bad_p THEN 'unknown_product'
              WHEN o_custkey IS NULL OR o_custkey NOT IN (SELECT id FROM cust) THEN 'unknown_customer' END AS reason
  FROM orders LEFT JOIN flag ON flag.rid = o_orderkey),
need AS (SELECT rid, act.i, sum(q) AS d FROM line JOIN act ON act.id = line.product_id
         WHERE rid IN (SELECT rid FROM chk WHERE reason IS NULL) GROUP BY rid, act.i),
want AS MATERIALIZED (
  SELECT chk.rid, row_number() OVER (ORDER BY chk.rid) AS k, list(struct_pack(i := need.i, d := need.d)) FILTER (WHERE need.i IS NOT NULL) AS w
  FROM chk LEFT JOIN need ON need.rid = chk.rid WHERE reason IS NULL GROUP BY chk.rid),
step(k, rid, fits, left_over) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, (SELECT list(CAST(stock AS BIGINT) ORDER BY i) FROM act)
  UNION ALL
  SELECT k, rid, fits, CASE WHEN fits AND w IS NOT NULL
      THEN list_transform(old, lambda x, n: x - coalesce(list_sum(list_transform(list_filter(w, lambda e: e.i = n), lambda e: e.d)), 0)::BIGINT)
      ELSE old END
  FROM (SELECT want.k, want.rid, want.w, step.left_over AS old,
               coalesce(list_aggregate(list_transform(want.w, lambda e: step.left_over[e.i] >= e.d), 'bool_and'), true) AS fits
        FROM step JOIN want ON want.k = step.k + 1)),
dec AS MATERIALIZED (
  SELECT chk.rid, chk.customer_id, coalesce(chk.reason, CASE WHEN NOT step.fits THEN 'insufficient_stock' END) AS reason
  FROM chk LEFT JOIN step ON step.rid = chk.rid),
acc AS (SELECT rid, customer_id, (SELECT max(id) FROM ord) + row_number() OVER (ORDER BY rid) AS order_id FROM dec WHERE reason IS NULL),
bought AS (SELECT order_id, product_id, q, act.price_c,
                  (SELECT max(id) FROM item) + row_number() OVER (ORDER BY order_id, pos) AS id
           FROM acc JOIN line ON line.rid = acc.rid JOIN act ON act.id = line.product_id)
"""
_PLACE_PREFIX = PREFIX.replace("WITH", "WITH RECURSIVE", 1) + _PLACE

Q["place_orders_accepted"] = _PLACE_PREFIX + """
SELECT acc.order_id AS id, customer_id, 'pending' AS status,
       CAST(coalesce((SELECT sum(q * price_c) FROM bought WHERE bought.order_id = acc.order_id), 0) AS DOUBLE) / 100.0 AS total_amount,
       'USD' AS currency, TIMESTAMP '2001-09-01 00:00:00' AS placed_at, CAST(NULL AS TIMESTAMP) AS shipped_at,
       CAST(NULL AS TIMESTAMP) AS delivered_at
FROM acc"""
Q["place_orders_items"] = _PLACE_PREFIX + """
SELECT id, order_id, product_id, CAST(q AS BIGINT) AS quantity, CAST(price_c AS DOUBLE) / 100.0 AS unit_price,
       CAST(q * price_c AS DOUBLE) / 100.0 AS subtotal
FROM bought"""
Q["place_orders_rejects"] = _PLACE_PREFIX + """
SELECT rid AS request_id, rid AS seq, customer_id, reason FROM dec WHERE reason IS NOT NULL"""
Q["place_orders_stock"] = _PLACE_PREFIX + """
SELECT prod.id, sku, CAST(stock - coalesce((SELECT sum(q) FROM bought WHERE bought.product_id = prod.id), 0) AS BIGINT) AS stock
FROM prod"""


def oracle_sql() -> dict[str, str]:
    return dict(Q)

# ---------------------------------------------------------------------------
# Catalog lookups and pages
# ---------------------------------------------------------------------------
_ORDER_SUMMARY = """
SELECT o.id, o.customer_id, c.first_name || ' ' || c.last_name AS customer_name, o.status,
       CAST(o.total_c AS DOUBLE) / 100.0 AS total_amount, o.currency, CAST(o.placed_at AS TIMESTAMP) AS placed_at
FROM ord o JOIN cust c ON c.id = o.customer_id"""

_PAGE_COLS = """, CAST({total} AS BIGINT) AS total_count, CAST({page} AS BIGINT) AS page,
       CAST({size} AS BIGINT) AS page_size, CAST(ceil({total} / {size}) AS BIGINT) AS total_pages,
       ({page} < ceil({total} / {size})) AS has_next_page, ({page} > 1) AS has_prev_page"""


def _paged(base: str, order: str, total_sql: str, page: int, size: int) -> str:
    cols = _PAGE_COLS.format(total=f"(SELECT count(*) FROM ({total_sql}))", page=page, size=size)
    return PREFIX + f"""
, b AS ({base}),
pg AS (SELECT * FROM b ORDER BY {order} LIMIT {size} OFFSET {(page - 1) * size})
SELECT pg.*{cols} FROM pg"""


ORDERS_PAGE = (3, 20)
ORDERS_STATUS_PAGE = (2, 20, "SHIPPED")
CUSTOMERS_PAGE = (2, 20)
PRODUCTS_PAGE = (2, 20)
PRODUCTS_ALL_PAGE = (5, 25)

DEEP_SIZE = 25


def _deep(base: str, order: str, total_sql: str) -> str:
    """The page that holds the row at nine tenths of the listing."""
    size = DEEP_SIZE
    return PREFIX + f"""
, b AS ({base}),
tot AS (SELECT count(*) AS n, count(*) * 9 // 10 // {size} + 1 AS page FROM ({total_sql})),
num AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM b)
SELECT num.* EXCLUDE (rn), CAST(n AS BIGINT) AS total_count, CAST(page AS BIGINT) AS page, CAST({size} AS BIGINT) AS page_size,
       CAST(ceil(n / {size}) AS BIGINT) AS total_pages, page < ceil(n / {size}) AS has_next_page, page > 1 AS has_prev_page
FROM num, tot WHERE rn > (page - 1) * {size} AND rn <= page * {size}"""


Q["orders_page"] = _paged(_ORDER_SUMMARY, "placed_at DESC, id DESC", "SELECT * FROM ord",
                          *ORDERS_PAGE)
Q["orders_page_status"] = _paged(_ORDER_SUMMARY + " WHERE o.status = 'shipped'", "placed_at DESC, id DESC",
                                 "SELECT * FROM ord WHERE status = 'shipped'", *ORDERS_STATUS_PAGE[:2])
Q["orders_deep_page"] = _deep(_ORDER_SUMMARY, "placed_at DESC, id DESC", "SELECT * FROM ord")
Q["orders_deep_page_status"] = _deep(_ORDER_SUMMARY + " WHERE o.status = 'shipped'", "placed_at DESC, id DESC",
                                     "SELECT * FROM ord WHERE status = 'shipped'")
Q["orders_by_customer"] = PREFIX + _ORDER_SUMMARY
Q["orders_keyset_page"] = PREFIX + f"""
SELECT * FROM ({_ORDER_SUMMARY}) ORDER BY placed_at DESC, id DESC
LIMIT {ORDERS_PAGE[1]} OFFSET {(ORDERS_PAGE[0] - 1) * ORDERS_PAGE[1]}"""

Q["order_detail"] = PREFIX + """
SELECT o.id, o.customer_id, o.status, CAST(o.total_c AS DOUBLE) / 100.0 AS total_amount, o.currency,
       CAST(o.placed_at AS TIMESTAMP) AS placed_at, CAST(NULL AS TIMESTAMP) AS shipped_at,
       CAST(NULL AS TIMESTAMP) AS delivered_at,
       c.email AS customer_email, c.first_name AS customer_first_name, c.last_name AS customer_last_name,
       c.country AS customer_country,
       i.id AS item_id, i.product_id, CAST(i.quantity AS BIGINT) AS quantity,
       CAST(i.price_c AS DOUBLE) / 100.0 AS unit_price, CAST(i.sub_c AS DOUBLE) / 100.0 AS subtotal,
       p.sku AS product_sku, p.name AS product_name
FROM ord o JOIN cust c ON c.id = o.customer_id JOIN item i ON i.order_id = o.id
JOIN prod p ON p.id = i.product_id"""

_CUSTOMER_COLS = "id, email, first_name, last_name, country, city, CAST(created_at AS TIMESTAMP) AS created_at, is_active"
Q["customer_by_id"] = PREFIX + f"SELECT {_CUSTOMER_COLS} FROM cust"
Q["customers_page"] = _paged(f"SELECT {_CUSTOMER_COLS} FROM cust WHERE is_active", "created_at DESC, id DESC",
                             "SELECT * FROM cust WHERE is_active", *CUSTOMERS_PAGE)
Q["customers_deep_page"] = _deep(f"SELECT {_CUSTOMER_COLS} FROM cust WHERE is_active", "created_at DESC, id DESC",
                                 "SELECT * FROM cust WHERE is_active")

_PRODUCT_COLS = """p.id, CAST(p.category_id AS BIGINT) AS category_id, p.sku, p.name, p.description,
       CAST(p.price_c AS DOUBLE) / 100.0 AS unit_price, CAST(p.stock AS BIGINT) AS stock, p.is_active,
       CAST(p.created_at AS TIMESTAMP) AS created_at"""
Q["product_by_id"] = PREFIX + f"""
SELECT {_PRODUCT_COLS}, c.name AS category_name, 'Parts of type ' || c.name AS category_description
FROM prod p JOIN cat c ON c.id = p.category_id"""
Q["products_by_category"] = PREFIX + f"""
SELECT {_PRODUCT_COLS} FROM prod p WHERE p.is_active AND p.category_id IN (SELECT id FROM cat)"""
Q["products_page"] = _paged(f"SELECT {_PRODUCT_COLS} FROM prod p WHERE p.is_active", "name, id",
                            "SELECT * FROM prod WHERE is_active", *PRODUCTS_PAGE)
Q["products_deep_page"] = _deep(f"SELECT {_PRODUCT_COLS} FROM prod p WHERE p.is_active", "name, id",
                                "SELECT * FROM prod WHERE is_active")
Q["products_page_all"] = _paged(f"SELECT {_PRODUCT_COLS} FROM prod p", "name, id",
                                "SELECT * FROM prod", *PRODUCTS_ALL_PAGE)

# ---------------------------------------------------------------------------
# Table contract: rendered from the declared rules into DuckDB SQL over the
# bound tables (money columns are held in cents there, same signs).
# ---------------------------------------------------------------------------
_CONTRACT_SOURCES = {
    "customers": "cust", "categories": "catx", "products": "prod", "orders": "ord", "order_items": "item",
}
_COLUMN_SQL = {
    ("orders", "total_amount"): "total_c", ("order_items", "unit_price"): "price_c",
    ("order_items", "subtotal"): "sub_c", ("products", "unit_price"): "price_c",
}


def _contract_sql() -> str:
    from tillpoint.schema import CONTRACTS
    parts = []

    def col(table, c):
        return _COLUMN_SQL.get((table, c), c)

    for table, k in CONTRACTS.items():
        if table not in _CONTRACT_SOURCES:
            continue
        src = _CONTRACT_SOURCES[table]
        sel = []
        for c in k.not_null:
            sel.append(("not_null", c, f"count_if({col(table, c)} IS NULL)"))
        for c, op, bound in k.ranges:
            sel.append((f"range{op}{bound:g}", c, f"count_if(NOT ({col(table, c)} {op} {bound:g}))"))
        for c, values in k.domains:
            vals = ", ".join(f"'{v}'" for v in values)
            sel.append(("domain", c, f"count_if({col(table, c)} NOT IN ({vals}))"))
        for c, n in k.max_length:
            sel.append((f"max_length_{n}", c, f"count_if(length({col(table, c)}) > {n})"))
        for c, _rule in k.generated:
            sel.append(("generated", c, "count_if(sub_c IS DISTINCT FROM quantity * price_c)"))
        for key in k.unique:
            kc = key[0]
            sel.append(("unique", ",".join(key), f"count({kc}) - count(DISTINCT {kc})"))
        for rule, c, expr in sel:
            parts.append(f"SELECT '{table}' AS \"table\", '{rule}' AS rule, '{c}' AS \"column\", "
                         f"CAST({expr} AS BIGINT) AS violations FROM {src}")
        for c, parent, pcol in k.foreign_keys:
            psrc = _CONTRACT_SOURCES[parent]
            parts.append(f"SELECT '{table}' AS \"table\", 'foreign_key' AS rule, '{c}->{parent}.{pcol}' AS \"column\", "
                         f"CAST(count(*) AS BIGINT) AS violations FROM {src} x "
                         f"WHERE x.{c} IS NOT NULL AND x.{c} NOT IN (SELECT {pcol} FROM {psrc})")
    catx = ", catx AS (SELECT id, name, 'Parts of type ' || name AS description, " \
           "TIMESTAMP '1995-01-01 00:00:00' AS created_at FROM cat)\n"
    return PREFIX + catx + "\nUNION ALL\n".join(parts)


Q["contract_violations"] = _contract_sql()

# insert_if_absent: customers created in the first half of 1995 are the
# target; every customer arrives as incoming; duplicates keep the lowest id.
Q["insert_if_absent"] = PREFIX + f"""
, tgt AS (SELECT {_CUSTOMER_COLS} FROM cust WHERE created_at < TIMESTAMP '1995-07-01 00:00:00'),
inc AS (SELECT {_CUSTOMER_COLS} FROM cust)
SELECT * FROM tgt
UNION ALL
SELECT * FROM inc WHERE email NOT IN (SELECT email FROM tgt)
  AND id = (SELECT min(i2.id) FROM inc i2 WHERE i2.email = inc.email)"""

# ---------------------------------------------------------------------------
# Feed load: the derived feed, its tagging, lookups, first-wins dedupe and
# id assignment, all in SQL.
# ---------------------------------------------------------------------------

_FEED = """
, fb AS (SELECT i.id AS k, i.order_id, i.product_id, i.quantity AS qty, i.price_c,
                o.status, o.placed_at, c.email, p.sku
         FROM item i LEFT JOIN ord o ON o.id = i.order_id LEFT JOIN cust c ON c.id = o.customer_id
         LEFT JOIN prod p ON p.id = i.product_id),
fr AS (SELECT k,
         CASE WHEN k % 101 = 0 THEN '' WHEN k % 101 = 1 THEN '   ' ELSE 'EXT-' || CAST(order_id AS VARCHAR) END AS order_id,
         CASE WHEN k % 101 = 2 THEN '' WHEN k % 101 = 13 THEN ' ' || upper(email) || ' '
              WHEN k % 101 = 15 THEN 'nobody' || CAST(k AS VARCHAR) || '@example.com' ELSE email END AS customer_email,
         CASE WHEN k % 101 = 3 THEN '' WHEN k % 101 = 14 THEN lower(sku)
              WHEN k % 101 = 16 THEN 'SKU-X' || CAST(k AS VARCHAR) ELSE sku END AS product_sku,
         CASE WHEN k % 101 = 4 THEN 'abc' WHEN k % 101 = 5 THEN '0' WHEN k % 101 = 6 THEN '-5'
              ELSE CAST(qty AS VARCHAR) END AS quantity,
         CASE WHEN k % 101 = 7 THEN '-0.01' WHEN k % 101 = 8 THEN '0'
              ELSE CAST(CAST(price_c AS DECIMAL(18,0)) / 100 AS DECIMAL(10,2))::VARCHAR END AS unit_price,
         CASE WHEN k % 101 = 9 THEN 'not-a-date' WHEN k % 101 = 10 THEN '2024-02-30'
              WHEN k % 101 = 17 THEN strftime(placed_at, '%m/%d/%Y')
              WHEN k % 101 = 18 THEN strftime(placed_at, '%Y-%m-%d %H:%M:%S')
              ELSE strftime(placed_at, '%Y-%m-%d') END AS order_date,
         CASE WHEN k % 101 = 11 THEN 'lost'
              WHEN k % 101 = 12 THEN ' ' || upper(substr(status, 1, 1)) || substr(status, 2) || ' '
              ELSE status END AS status,
         0 AS copy
       FROM fb),
fc AS (SELECT * FROM fr UNION ALL SELECT k, order_id, customer_email, product_sku, quantity, unit_price,
                                        order_date, status, 1 AS copy FROM fr WHERE k % 101 = 19),
feed AS (SELECT *, row_number() OVER (ORDER BY k, copy) + 1 AS row_num FROM fc),
tg AS (SELECT row_num, order_id AS raw_id, quantity AS raw_q, unit_price AS raw_p, order_date AS raw_d,
              status AS raw_s, trim(order_id) AS external_order_id, lower(trim(customer_email)) AS customer_email,
              upper(trim(product_sku)) AS product_sku,
              TRY_CAST(trim(quantity) AS INTEGER) AS q, TRY_CAST(trim(unit_price) AS DECIMAL(18,4)) AS p,
              coalesce(TRY_CAST(trim(order_date) AS TIMESTAMP),
                       try_strptime(trim(order_date), '%m/%d/%Y')) AS d,
              lower(trim(status)) AS s,
              (customer_email IS NULL OR trim(customer_email) = '') AS blank_e,
              (product_sku IS NULL OR trim(product_sku) = '') AS blank_s,
              (order_id IS NULL OR trim(order_id) = '') AS blank_o
       FROM feed),
tc AS (SELECT *, CASE WHEN blank_o THEN 'missing_order_id' WHEN blank_e THEN 'missing_customer_email'
                      WHEN blank_s THEN 'missing_product_sku' WHEN q IS NULL OR p IS NULL THEN 'bad_number'
                      WHEN q <= 0 THEN 'bad_quantity' WHEN p < 0 THEN 'negative_price'
                      WHEN d IS NULL THEN 'bad_date'
                      WHEN s IS NULL OR s NOT IN ('pending','confirmed','shipped','delivered','cancelled','refunded')
                           THEN 'bad_status' END AS code1
       FROM tg),
lc AS (SELECT email, min(id) AS customer_id FROM cust WHERE is_active GROUP BY email),
lp AS (SELECT sku, min(id) AS product_id FROM prod WHERE is_active GROUP BY sku),
rs AS (SELECT tc.*, lc.customer_id, lp.product_id,
              coalesce(code1, CASE WHEN lc.customer_id IS NULL THEN 'unknown_customer'
                                   WHEN lp.product_id IS NULL THEN 'unknown_product' END) AS code
       FROM tc LEFT JOIN lc ON lc.email = tc.customer_email LEFT JOIN lp ON lp.sku = tc.product_sku),
msg AS (SELECT *, CASE WHEN code1 IS NOT NULL THEN 1 WHEN code IS NOT NULL THEN 2 END AS stage,
          CASE code
            WHEN 'missing_order_id' THEN '[Row ' || row_num || '] Missing order_id'
            WHEN 'missing_customer_email' THEN '[Row ' || row_num || '] Missing customer_email'
            WHEN 'missing_product_sku' THEN '[Row ' || row_num || '] Missing product_sku'
            WHEN 'bad_number' THEN '[Row ' || row_num || '] Invalid number: quantity ''' || coalesce(raw_q, '')
                                   || ''', unit_price ''' || coalesce(raw_p, '') || ''''
            WHEN 'bad_quantity' THEN '[Row ' || row_num || '] Quantity must be > 0 (got ' || q || ')'
            WHEN 'negative_price' THEN '[Row ' || row_num || '] Unit price cannot be negative'
            WHEN 'bad_date' THEN '[Row ' || row_num || '] Invalid date format: ''' || coalesce(raw_d, '') || ''''
            WHEN 'bad_status' THEN '[Row ' || row_num || '] Invalid status ''' || coalesce(raw_s, '')
                                   || '''. Allowed: pending, confirmed, shipped, delivered, cancelled, refunded'
            WHEN 'unknown_customer' THEN 'Order ' || external_order_id || ': Customer ''' || customer_email || ''' not found'
            WHEN 'unknown_product' THEN 'Order ' || external_order_id || ': Product (SKU) ''' || product_sku || ''' not found'
          END AS message
        FROM rs),
fw AS (SELECT external_order_id, product_sku, min(row_num) AS row_num FROM msg WHERE code IS NULL
       GROUP BY external_order_id, product_sku),
cl AS (SELECT msg.*, CASE WHEN code IS NOT NULL THEN 'rejected'
                          WHEN row_num IN (SELECT row_num FROM fw) THEN 'loaded' ELSE 'skipped' END AS outcome
       FROM msg),
ld AS (SELECT cl.*, row_number() OVER (ORDER BY row_num) AS seq FROM cl WHERE outcome = 'loaded')
"""

Q["feed_clean"] = PREFIX + _FEED + """
SELECT row_num, external_order_id, customer_email, product_sku, CAST(q AS BIGINT) AS quantity,
       CAST(p AS DOUBLE) AS unit_price, CAST(d AS TIMESTAMP) AS order_date, s AS status,
       CAST(q * p AS DOUBLE) AS subtotal
FROM tc WHERE code1 IS NULL"""

Q["feed_rejects"] = PREFIX + _FEED + """
SELECT row_num, CAST(stage AS BIGINT) AS stage, code, message FROM cl WHERE outcome = 'rejected'"""

Q["feed_load_orders"] = PREFIX + _FEED + """
SELECT (SELECT max(id) FROM ord) + seq AS id, customer_id, s AS status,
       CAST(CAST(q * p AS DECIMAL(12,2)) AS DOUBLE) AS total_amount, 'USD' AS currency,
       CAST(d AS TIMESTAMP) AS placed_at, CAST(NULL AS TIMESTAMP) AS shipped_at,
       CAST(NULL AS TIMESTAMP) AS delivered_at
FROM ld"""

Q["feed_load_items"] = PREFIX + _FEED + """
SELECT (SELECT max(id) FROM item) + seq AS id, (SELECT max(id) FROM ord) + seq AS order_id, product_id,
       CAST(q AS BIGINT) AS quantity, CAST(CAST(p AS DECIMAL(10,2)) AS DOUBLE) AS unit_price,
       CAST(q * CAST(p AS DECIMAL(10,2)) AS DOUBLE) AS subtotal
FROM ld"""

Q["feed_rerun_skips"] = PREFIX + _FEED + """
SELECT row_num, CASE WHEN outcome = 'rejected' THEN 'rejected' ELSE 'skipped' END AS outcome FROM cl"""

Q["feed_run_log"] = PREFIX + _FEED + """
, tot AS (SELECT count(*) AS r, count_if(outcome = 'loaded') AS l, count_if(outcome = 'rejected') AS f FROM cl),
em AS (SELECT string_agg(message, '; ' ORDER BY stage, row_num) AS m FROM
        (SELECT * FROM cl WHERE outcome = 'rejected' ORDER BY stage, row_num LIMIT 10))
SELECT CAST(1 AS BIGINT) AS id, 'derived:lineitem' AS source_file, CAST(r AS BIGINT) AS records_read,
       CAST(l AS BIGINT) AS records_loaded, CAST(f AS BIGINT) AS records_failed, 'completed' AS status,
       m AS error_message
FROM tot, em"""

# ---------------------------------------------------------------------------
# The feed through files and store: chunks of rows are files, files of the
# first column order come before those of the other.
# ---------------------------------------------------------------------------
_FILES = _FEED.replace("feed AS (SELECT *, row_number() OVER (ORDER BY k, copy) + 1 AS row_num FROM fc)",
                       """fn AS (SELECT *, row_number() OVER (ORDER BY k, copy) - 1 AS nth FROM fc),
feed AS (SELECT *, nth // 5000 AS chunk, nth % 5000 + 2 AS line,
                row_number() OVER (ORDER BY (nth // 5000) % 2, nth) AS row_num FROM fn)""")
_FILES = _FILES.replace("tg AS (SELECT row_num, ", "tg AS (SELECT row_num, chunk, line, ").replace("[Row ' || row_num ||", "[Row ' || line ||")
Q["feed_csv_rejects"] = PREFIX + _FILES + """
SELECT CAST(chunk AS BIGINT) AS chunk, CAST(line AS BIGINT) AS row_num, CAST(stage AS BIGINT) AS stage, code, message
FROM cl WHERE outcome = 'rejected'"""
Q["feed_published_twice"] = PREFIX + _FILES + """
SELECT (SELECT max(id) FROM ord) + seq AS id, customer_id, s AS status,
       CAST(CAST(q * p AS DECIMAL(12,2)) AS DOUBLE) AS total_amount, CAST(d AS TIMESTAMP) AS placed_at,
       (SELECT max(id) FROM item) + seq AS item_id, product_id, CAST(q AS BIGINT) AS quantity
FROM ld"""
Q["feed_published_ledger"] = PREFIX + _FILES + """
SELECT external_order_id, product_sku, CAST(line AS BIGINT) AS row_num, (SELECT max(id) FROM ord) + seq AS order_id FROM ld"""
Q["feed_csv_line_breaks"] = PREFIX + _FILES + """
SELECT replace(external_order_id, 'EXT-', 'EXT"' || chr(10)) AS external_order_id, product_sku, CAST(line AS BIGINT) AS row_num FROM ld"""
Q["feed_two_writers"] = PREFIX + _FILES + """
SELECT external_order_id, product_sku, CAST(1 AS BIGINT) AS loads, CAST(1 AS BIGINT) AS orders, CAST(1 AS BIGINT) AS items FROM ld"""
Q["feed_published_log"] = PREFIX + _FILES + """
, tot AS (SELECT count(*) AS r, count_if(outcome = 'loaded') AS l, count_if(outcome = 'rejected') AS f FROM cl)
SELECT CAST(id AS BIGINT) AS id, source_file, status, CAST(CASE WHEN id < 3 THEN r ELSE 0 END AS BIGINT) AS records_read,
       CAST(CASE id WHEN 1 THEN l ELSE 0 END AS BIGINT) AS records_loaded, CAST(CASE WHEN id < 3 THEN f ELSE 0 END AS BIGINT) AS records_failed
FROM tot, (VALUES (1, 'derived:csv', 'completed'), (2, 'derived:csv', 'completed'), (3, 'derived:absent', 'failed')) v(id, source_file, status)"""

# ---------------------------------------------------------------------------
# Breaches of every rule, written out by hand: (table, rule, column, count).
# ---------------------------------------------------------------------------
_HURT = PREFIX + """
, hc AS (SELECT id, CASE WHEN id % 50 = 1 THEN NULL WHEN id % 50 = 2 THEN 'same@example.com' ELSE email END AS email,
                CASE WHEN id % 50 = 3 THEN repeat('x', 101) ELSE country END AS country,
                CASE WHEN id % 50 = 4 THEN NULL ELSE is_active END AS is_active,
                CASE WHEN id % 50 = 5 THEN repeat('n', 101) ELSE first_name END AS first_name,
                last_name, city, CASE WHEN id % 50 = 6 THEN NULL ELSE created_at END AS created_at FROM cust),
hk AS (SELECT id, CASE WHEN id <= 2 THEN 'TWICE' ELSE name END AS name, 'x' AS created_at FROM cat),
hp AS (SELECT id, CASE WHEN id % 40 = 1 THEN -100 ELSE price_c END AS unit_price, CASE WHEN id % 40 = 2 THEN -1 ELSE stock END AS stock,
              CASE WHEN id % 40 = 3 THEN 99 ELSE category_id END AS category_id,
              CASE WHEN id % 40 = 4 THEN repeat('S', 51) WHEN id % 40 = 5 THEN 'SAME' ELSE sku END AS sku,
              CASE WHEN id % 40 = 6 THEN NULL ELSE name END AS name, is_active, created_at FROM prod),
ho AS (SELECT id, CASE WHEN id % 60 = 1 THEN 'lost' WHEN id % 60 = 6 THEN NULL ELSE status END AS status,
              CASE WHEN id % 60 = 2 THEN -100 ELSE total_c END AS total_amount,
              CASE WHEN id % 60 = 3 THEN 1000000000 WHEN id % 60 = 7 THEN NULL ELSE customer_id END AS customer_id,
              CASE WHEN id % 60 = 4 THEN 'EURO' ELSE currency END AS currency, CASE WHEN id % 60 = 5 THEN NULL ELSE placed_at END AS placed_at
       FROM ord),
hi AS (SELECT CASE WHEN id % 70 = 7 THEN 7 ELSE id END AS id, CASE WHEN id % 70 = 1 THEN 0 ELSE quantity END AS quantity,
              CASE WHEN id % 70 = 2 THEN -100 ELSE price_c END AS unit_price, CASE WHEN id % 70 = 3 THEN 1000000000 ELSE order_id END AS order_id,
              CASE WHEN id % 70 = 4 THEN NULL ELSE product_id END AS product_id,
              CASE WHEN id % 70 = 5 THEN sub_c + 100 WHEN id % 70 = 6 THEN NULL ELSE sub_c END AS subtotal FROM item),
hl AS (SELECT id, CASE id % 80 WHEN 1 THEN 'unknown' WHEN 2 THEN repeat('s', 21) WHEN 3 THEN NULL ELSE 'completed' END AS status,
              CASE WHEN id % 80 = 4 THEN repeat('f', 501) ELSE 'feed.csv' END AS source_file,
              CASE WHEN id % 80 = 5 THEN NULL ELSE 5 END AS records_read, 5 AS records_loaded, 0 AS records_failed,
              CASE WHEN id % 80 = 6 THEN NULL ELSE placed_at END AS run_at FROM ord)
"""
_NULLS = [("hc", "customers", "id email first_name last_name created_at is_active"), ("hk", "categories", "id name created_at"),
          ("hp", "products", "id category_id sku name unit_price stock is_active created_at"),
          ("ho", "orders", "id customer_id status total_amount currency placed_at"),
          ("hi", "order_items", "id order_id product_id quantity unit_price"),
          ("hl", "etl_run_log", "id run_at records_read records_loaded records_failed status")]
_RULES = [
    ("hc", "customers", "max_length_255", "email", "length(email) > 255"), ("hc", "customers", "max_length_100", "first_name", "length(first_name) > 100"),
    ("hc", "customers", "max_length_100", "last_name", "length(last_name) > 100"), ("hc", "customers", "max_length_100", "country", "length(country) > 100"),
    ("hc", "customers", "max_length_100", "city", "length(city) > 100"), ("hk", "categories", "max_length_100", "name", "length(name) > 100"),
    ("hp", "products", "range>=0", "unit_price", "unit_price < 0"), ("hp", "products", "range>=0", "stock", "stock < 0"),
    ("hp", "products", "max_length_50", "sku", "length(sku) > 50"), ("hp", "products", "max_length_255", "name", "length(name) > 255"),
    ("ho", "orders", "range>=0", "total_amount", "total_amount < 0"),
    ("ho", "orders", "domain", "status", "status NOT IN ('pending', 'confirmed', 'shipped', 'delivered', 'cancelled', 'refunded')"),
    ("ho", "orders", "max_length_50", "status", "length(status) > 50"), ("ho", "orders", "max_length_3", "currency", "length(currency) > 3"),
    ("hi", "order_items", "range>0", "quantity", "quantity <= 0"), ("hi", "order_items", "range>=0", "unit_price", "unit_price < 0"),
    ("hi", "order_items", "generated", "subtotal", "subtotal IS DISTINCT FROM quantity * unit_price"),
    ("hl", "etl_run_log", "domain", "status", "status NOT IN ('started', 'completed', 'failed')"),
    ("hl", "etl_run_log", "max_length_500", "source_file", "length(source_file) > 500"), ("hl", "etl_run_log", "max_length_20", "status", "length(status) > 20"),
]
_KEYS = [("hc", "customers", "id"), ("hc", "customers", "email"), ("hk", "categories", "id"), ("hk", "categories", "name"), ("hp", "products", "id"),
         ("hp", "products", "sku"), ("ho", "orders", "id"), ("hi", "order_items", "id"), ("hl", "etl_run_log", "id")]
_REFERENCES = [("hp", "products", "category_id", "hk", "categories"), ("ho", "orders", "customer_id", "hc", "customers"),
               ("hi", "order_items", "order_id", "ho", "orders"), ("hi", "order_items", "product_id", "hp", "products")]
_LINES = [(src, t, "not_null", c, f"count_if({c} IS NULL)") for src, t, cols in _NULLS for c in cols.split()]
_LINES += [(src, t, rule, c, f"count_if({cond})") for src, t, rule, c, cond in _RULES]
_LINES += [(src, t, "unique", c, f"count({c}) - count(DISTINCT {c})") for src, t, c in _KEYS]
_LINES += [(f"(SELECT * FROM {src} c ANTI JOIN {parent} p ON c.{c} = p.id)", t, "foreign_key", f"{c}->{of}.id", f"count({c})")
           for src, t, c, parent, of in _REFERENCES]
Q["contract_breaches"] = _HURT + "\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", '{rule}' AS rule, '{c}' AS \"column\", CAST({n} AS BIGINT) AS violations FROM {src}"
    for src, t, rule, c, n in _LINES)

Q["insert_if_absent_nulls"] = PREFIX + """
, e AS (SELECT id, CASE WHEN id % 4 <> 0 THEN email END AS email, created_at FROM cust),
tgt AS (SELECT id, email FROM e WHERE created_at < TIMESTAMP '1995-07-01 00:00:00')
SELECT id, email FROM tgt
UNION ALL
SELECT id, email FROM e WHERE email IS NULL
   OR (email NOT IN (SELECT email FROM tgt WHERE email IS NOT NULL) AND id = (SELECT min(x.id) FROM e x WHERE x.email = e.email))"""
Q["apply_defaults"] = PREFIX + """
SELECT id, customer_id, 'pending' AS status, 'USD' AS currency, CAST(total_c AS DOUBLE) / 100.0 AS total_amount FROM ord"""
Q["apply_generated"] = PREFIX + "SELECT id, CAST(sub_c AS DOUBLE) / 100.0 AS subtotal FROM item"
Q["delete_cascade"] = PREFIX + """
SELECT id, order_id, product_id, CAST(quantity AS BIGINT) AS quantity, CAST(price_c AS DOUBLE) / 100.0 AS unit_price,
       CAST(sub_c AS DOUBLE) / 100.0 AS subtotal
FROM item WHERE order_id IN (SELECT id FROM ord WHERE status <> 'cancelled')"""


def _cents(c: str) -> str:
    """Cents as the text of a decimal with two places (not negative)."""
    return f"(({c}) // 100) || '.' || lpad(CAST(({c}) % 100 AS VARCHAR), 2, '0')"


Q["order_documents"] = PREFIX + f"""
, li AS (SELECT i.order_id, i.id, '{{"id":' || i.id || ',"orderId":' || i.order_id || ',"productId":' || i.product_id || ',"quantity":' || i.quantity
                || ',"unitPrice":' || {_cents('i.price_c')} || ',"subtotal":' || {_cents('i.sub_c')} || ',"product":{{"id":' || p.id
                || ',"sku":"' || p.sku || '","name":"' || p.name || '"}}}}' AS doc
         FROM item i JOIN prod p ON p.id = i.product_id),
ls AS (SELECT order_id, string_agg(doc, ',' ORDER BY id) AS docs FROM li GROUP BY order_id)
SELECT '{{"id":' || o.id || ',"customerId":' || o.customer_id || ',"status":"' || o.status || '","totalAmount":' || {_cents('o.total_c')}
       || ',"currency":"USD","placedAt":"' || strftime(o.placed_at, '%Y-%m-%dT%H:%M:%S.000Z') || '","shippedAt":null,"deliveredAt":null,"customer":{{"id":'
       || c.id || ',"email":"' || c.email || '","firstName":"' || c.first_name || '","lastName":"' || c.last_name || '","country":"' || c.country
       || '"}},"items":[' || ls.docs || ']}}' AS value
FROM ord o JOIN cust c ON c.id = o.customer_id JOIN ls ON ls.order_id = o.id"""
_LAST = "(SELECT max(id) FROM ord)"
Q["order_lookup"] = Q["order_detail"] + f" WHERE o.id = {_LAST}"
Q["customer_lookup"] = Q["customer_by_id"] + f" WHERE id = (SELECT customer_id FROM ord WHERE id = {_LAST})"
Q["customer_orders_lookup"] = PREFIX + _ORDER_SUMMARY + f" WHERE o.customer_id = (SELECT customer_id FROM ord WHERE id = {_LAST})"
Q["product_lookup"] = Q["product_by_id"] + " WHERE p.id = 1"
Q["category_lookup"] = PREFIX + f"SELECT {_PRODUCT_COLS} FROM prod p WHERE p.is_active AND p.category_id = 1"
Q["category_performance_api"] = Q["category_performance"] + " WHERE rev IS NOT NULL"
Q["category_shares"] = (Q["category_performance"].replace("p.category_id, i.quantity", "p.id AS category_id, i.quantity")
                        .replace("c.id AS category_id, c.name AS category", "c.id AS category_id, c.sku AS category").replace("FROM cat c LEFT JOIN ca", "FROM prod c LEFT JOIN ca"))
Q["sql_sales_by_period"] = Q["sales_by_period"]
Q["sql_top_customers"] = Q["top_customers_country"]
# Live views: the same reports, the rows committed in several runs.
Q |= {f"live_{name}": Q[name] for name in ("monthly_revenue_summary", "product_sales_ranking", "category_performance")}
Q["live_customer_lifetime_value"] = f"SELECT * EXCLUDE (days_since_last_order) FROM ({Q['customer_lifetime_value']})"
Q["place_orders_published"] = Q["place_orders_stock"]
Q["feed_summary"] = PREFIX + _FEED + """
, tot AS (SELECT count(*) AS r, count_if(outcome = 'loaded') AS l, count_if(outcome = 'skipped') AS s, count_if(outcome = 'rejected') AS f FROM cl)
SELECT CAST(run AS BIGINT) AS run, CAST(r AS BIGINT) AS records_read, CAST(l AS BIGINT) AS records_loaded, CAST(s AS BIGINT) AS records_skipped,
       CAST(f AS BIGINT) AS records_failed, l * CAST(100 AS DOUBLE) / r AS success_pct,
       CASE WHEN run = 0 THEN 'threshold_exceeded' ELSE 'errors' END AS outcome
FROM tot, (VALUES (0), (1)) v(run)"""
Q["saved_tables"] = Q["orders_by_customer"]
Q["ad_hoc_sql"] = PREFIX + """
, many AS (SELECT customer_id FROM ord WHERE status NOT IN ('cancelled', 'refunded') GROUP BY customer_id HAVING count(*) > 5)
SELECT status, count(*) AS orders, CAST(sum(total_c) AS DOUBLE) / 100.0 AS total_amount, count(m.customer_id) AS with_value
FROM ord o LEFT JOIN many m ON m.customer_id = o.customer_id
WHERE placed_at >= TIMESTAMP '1997-01-01 00:00:00' GROUP BY status"""
Q["normalized_status"] = PREFIX + "SELECT id, CASE WHEN id % 4 < 2 THEN status END AS status FROM ord"
