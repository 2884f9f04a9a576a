"""Entity lookups and paging over customers, products and orders.

Point lookups filter on the id column (pushed to the Parquet scan as a
predicate, row groups skipped by min/max).  Each lookup also has a batch
form taking a DataFrame of ids (a semi join), the natural way to look up
many entities in one job.  Paging sorts by the documented key plus the id
as tie-breaker, then OFFSET/LIMIT (TakeOrderedAndProject keeps only
offset+size rows per task); ``*_after`` gives the keyset form for deep
pages, which needs no offset at all; ``*_pages`` builds a directory from which
any page number is read at the cost of one range of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.args import check_page, normalize_status_arg
from tillpoint.functions.expr import full_name, ts_lit
from tillpoint.operators.page_directory import PageDirectory, build_directory
from tillpoint.operators.ranking import SortKey
from tillpoint.plans.head_join import join_head
from tillpoint.session import scratch_path
from tillpoint.sources.tables import Tables


@dataclass
class PagedResult:
    items: DataFrame
    total_count: int
    page: int
    page_size: int

    @property
    def total_pages(self) -> int:
        return math.ceil(self.total_count / self.page_size) if self.page_size else 0

    @property
    def has_next_page(self) -> bool:
        return self.page < self.total_pages

    @property
    def has_prev_page(self) -> bool:
        return self.page > 1

    def as_frame(self) -> DataFrame:
        """Items with the page metadata as literal columns."""
        return self.items.select(
            "*", F.lit(self.total_count).cast("long").alias("total_count"),
            F.lit(self.page).cast("long").alias("page"),
            F.lit(self.page_size).cast("long").alias("page_size"),
            F.lit(self.total_pages).cast("long").alias("total_pages"),
            F.lit(self.has_next_page).alias("has_next_page"),
            F.lit(self.has_prev_page).alias("has_prev_page"))


def _page(df: DataFrame, keys: list[SortKey], tie: list[str], page: int, size: int) -> DataFrame:
    """Rows (page-1)*size+1 .. page*size in (keys, tie) order: a top-k of
    offset+size rows per task.  Deep reading belongs to the keyset form."""
    offset = (page - 1) * size
    order = [k.expr() for k in keys] + [F.col(c).desc() if tie_desc(keys) else F.col(c).asc() for c in tie]
    return df.orderBy(*order).offset(offset).limit(size)


def tie_desc(keys: list[SortKey]) -> bool:
    """Tie-break direction follows the first key (newest first -> id DESC)."""
    return keys[0].descending


# ---------------------------------------------------------------------------
# Orders
# ---------------------------------------------------------------------------
ORDER_SUMMARY = ["id", "customer_id", "customer_name", "status", "total_amount", "currency", "placed_at"]


def _customer_names(t: Tables) -> DataFrame:
    return t.customers.select(F.col("id").alias("customer_id"), full_name().alias("customer_name"))


def _order_summaries(t: Tables, orders: DataFrame) -> DataFrame:
    return orders.join(_customer_names(t), "customer_id").select(*ORDER_SUMMARY)


def orders_page(t: Tables, page: int = 1, size: int = 20, status: str | None = None) -> PagedResult:
    """Orders newest first (placed_at DESC, id DESC), optional status
    (case-insensitive).  The total counts orders only, as the original
    count query does."""
    check_page(page, size)
    status = normalize_status_arg(status)
    o = t.orders
    if status is not None:
        o = o.filter(F.col("status") == F.lit(status))
    total = o.count()
    return PagedResult(_orders_page_items(t, o, page, size), total, page, size)


NEWEST_FIRST = [SortKey("placed_at", descending=True)]


def _orders_page_items(t: Tables, o: DataFrame, page: int, size: int) -> DataFrame:
    """A page of order summaries without joining every order.

    The inner join with customers cannot take a limit, so a direct plan
    would shuffle all orders for 20 rows.  Instead the first page*size
    orders are taken (top-k per task) and written, only they are joined
    with customers, and the page is cut from that.  It equals join-then-
    page whenever each of those orders has exactly one customer; otherwise
    (broken foreign key, duplicate customer id) the join-first plan runs."""
    k = page * size
    order = [F.col("placed_at").desc(), F.col("id").desc()]
    joined = join_head(o.orderBy(*order).limit(k), _customer_names(t), "customer_id")
    if joined is None:
        return _page(_order_summaries(t, o), NEWEST_FIRST, ["id"], page, size)
    return joined.select(*ORDER_SUMMARY).orderBy(*order).offset((page - 1) * size).limit(size)


def orders_page_after(t: Tables, size: int = 20, after: tuple | None = None,
                      status: str | None = None) -> DataFrame:
    """Keyset page: the ``size`` orders following (placed_at, id) = ``after``
    in newest-first order.  A range filter + top-k, cost independent of
    page depth."""
    status = normalize_status_arg(status)
    o = t.orders
    if status is not None:
        o = o.filter(F.col("status") == F.lit(status))
    if after is not None:
        ts, oid = after
        o = o.filter((F.col("placed_at") < ts_lit(ts)) |
                     ((F.col("placed_at") == ts_lit(ts)) & (F.col("id") < F.lit(oid))))
    order = [F.col("placed_at").desc(), F.col("id").desc()]
    joined = join_head(o.orderBy(*order).limit(size), _customer_names(t), "customer_id")
    if joined is not None:
        return joined.select(*ORDER_SUMMARY).orderBy(*order)
    return _order_summaries(t, o).orderBy(*order).limit(size)


def orders_by_customer(t: Tables, customer_id=None, customer_ids: DataFrame | None = None) -> DataFrame:
    """Orders of one customer (or of every customer in ``customer_ids``),
    newest first."""
    o = t.orders
    if customer_ids is not None:
        o = o.join(customer_ids.select(F.col(customer_ids.columns[0]).alias("customer_id")),
                   "customer_id", "left_semi")
    else:
        o = o.filter(F.col("customer_id") == F.lit(customer_id))
    return _order_summaries(t, o).orderBy("customer_id", F.col("placed_at").desc(), F.col("id").desc())


ORDER_DETAIL_LINE = [
    "id", "customer_id", "status", "total_amount", "currency", "placed_at", "shipped_at", "delivered_at",
    "customer_email", "customer_first_name", "customer_last_name", "customer_country",
    "item_id", "product_id", "quantity", "unit_price", "subtotal", "product_sku", "product_name",
]


def _order_heads(t: Tables, order_id=None, order_ids: DataFrame | None = None) -> DataFrame:
    """The chosen orders with their customers (inner join)."""
    o = t.orders
    if order_ids is not None:
        o = o.join(order_ids.select(F.col(order_ids.columns[0]).alias("id")), "id", "left_semi")
    else:
        o = o.filter(F.col("id") == F.lit(order_id))
    c = t.customers.select(F.col("id").alias("customer_id"), F.col("email").alias("customer_email"),
                           F.col("first_name").alias("customer_first_name"),
                           F.col("last_name").alias("customer_last_name"),
                           F.col("country").alias("customer_country"))
    return o.join(c, "customer_id")


def _detail_items(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Items (``id``: their order) and products as the order detail shows them."""
    i = t.order_items.select(F.col("id").alias("item_id"), F.col("order_id").alias("id"),
                             "product_id", "quantity", "unit_price", "subtotal")
    p = t.products.select(F.col("id").alias("product_id"), F.col("sku").alias("product_sku"),
                          F.col("name").alias("product_name"))
    return i, p


def order_detail_lines(t: Tables, order_id=None, order_ids: DataFrame | None = None) -> DataFrame:
    """Flat form of the order detail: one row per item with its order,
    customer and product (four inner joins; an order with no items yields
    nothing).  The id filter is applied to orders and items before the
    joins (Catalyst infers it for items through the join key)."""
    i, p = _detail_items(t)
    return _order_heads(t, order_id, order_ids).join(i, "id").join(p, "product_id").select(*ORDER_DETAIL_LINE)


def order_detail(t: Tables, order_id=None, order_ids: DataFrame | None = None) -> DataFrame:
    """Nested order: order columns, a ``customer`` struct and an ``items``
    array of structs (each with a ``product`` struct), sorted by item id.
    Grouping is by order id: one order's items go to one task, which is the
    unit of the result (an order row).

    Items are gathered before they meet their order, so no item carries the order and customer
    columns.  Equal order rows make one row that holds their items that many times."""
    item = F.struct(F.col("item_id").alias("id"), F.col("id").alias("order_id"), "product_id", "quantity",
                    "unit_price", "subtotal",
                    F.struct(F.col("product_id").alias("id"), F.col("product_sku").alias("sku"),
                             F.col("product_name").alias("name")).alias("product"))
    i, p = _detail_items(t)
    items = i.join(p, "product_id").groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    # Dealt by id once, for the grouping and the join.
    heads = _order_heads(t, order_id, order_ids).repartition("id").groupBy(
        "id", "customer_id", "status", "total_amount", "currency", "placed_at",
        "shipped_at", "delivered_at", "customer_email", "customer_first_name",
        "customer_last_name", "customer_country").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    several = F.array_sort(F.flatten(F.array_repeat(F.col("_items"), F.col("_n"))))
    g = heads.join(items, "id").withColumn("items", F.when(F.col("_n") == 1, F.col("_items")).otherwise(several))
    return g.select("id", "customer_id", "status", "total_amount", "currency", "placed_at",
                    "shipped_at", "delivered_at",
                    F.struct(F.col("customer_id").alias("id"), F.col("customer_email").alias("email"),
                             F.col("customer_first_name").alias("first_name"),
                             F.col("customer_last_name").alias("last_name"),
                             F.col("customer_country").alias("country")).alias("customer"),
                    "items")


# ---------------------------------------------------------------------------
# Customers
# ---------------------------------------------------------------------------
CUSTOMER_COLS = ["id", "email", "first_name", "last_name", "country", "city", "created_at", "is_active"]


def customer_by_id(t: Tables, customer_id=None, customer_ids: DataFrame | None = None) -> DataFrame:
    """Customer row(s) by id, active or not."""
    c = t.customers
    if customer_ids is not None:
        c = c.join(customer_ids.select(F.col(customer_ids.columns[0]).alias("id")), "id", "left_semi")
    else:
        c = c.filter(F.col("id") == F.lit(customer_id))
    return c.select(*CUSTOMER_COLS)


def customers_page(t: Tables, page: int = 1, size: int = 20) -> PagedResult:
    """Active customers, newest first (created_at DESC, id DESC)."""
    check_page(page, size)
    c = t.customers.filter(F.col("is_active"))
    total = c.count()
    items = _page(c.select(*CUSTOMER_COLS), [SortKey("created_at", descending=True)], ["id"], page, size)
    return PagedResult(items, total, page, size)


# ---------------------------------------------------------------------------
# Products
# ---------------------------------------------------------------------------
PRODUCT_COLS = ["id", "category_id", "sku", "name", "description", "unit_price", "stock",
                "is_active", "created_at"]


def product_by_id(t: Tables, product_id=None, product_ids: DataFrame | None = None,
                  nested: bool = True) -> DataFrame:
    """Product(s) with their category (inner join): nested as a
    ``category`` struct, or flat with category_name/category_description."""
    p = t.products
    if product_ids is not None:
        p = p.join(product_ids.select(F.col(product_ids.columns[0]).alias("id")), "id", "left_semi")
    else:
        p = p.filter(F.col("id") == F.lit(product_id))
    c = t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"),
                            F.col("description").alias("category_description"))
    j = p.join(c, "category_id")
    if not nested:
        return j.select(*PRODUCT_COLS, "category_name", "category_description")
    return j.select(*PRODUCT_COLS, F.struct(F.col("category_id").alias("id"),
                                             F.col("category_name").alias("name"),
                                             F.col("category_description").alias("description"))
                    .alias("category"))


def products_by_category(t: Tables, category_id=None, category_ids: DataFrame | None = None) -> DataFrame:
    """Active products of a category (or of several), by name then id."""
    p = t.products.filter(F.col("is_active"))
    if category_ids is not None:
        p = p.join(category_ids.select(F.col(category_ids.columns[0]).alias("category_id")),
                   "category_id", "left_semi")
    else:
        p = p.filter(F.col("category_id") == F.lit(category_id))
    return p.select(*PRODUCT_COLS).orderBy("category_id", "name", "id")


def products_page(t: Tables, page: int = 1, size: int = 20, active_only: bool = True) -> PagedResult:
    """Products by name (then id); inactive ones only on request."""
    check_page(page, size)
    p = t.products
    if active_only:
        p = p.filter(F.col("is_active"))
    total = p.count()
    items = _page(p.select(*PRODUCT_COLS), [SortKey("name")], ["id"], page, size)
    return PagedResult(items, total, page, size)


def customers_page_after(t: Tables, size: int = 20, after: tuple | None = None) -> DataFrame:
    """Keyset page of active customers after (created_at, id), newest first."""
    c = t.customers.filter(F.col("is_active"))
    if after is not None:
        ts, cid = after
        c = c.filter((F.col("created_at") < F.lit(ts)) |
                     ((F.col("created_at") == F.lit(ts)) & (F.col("id") < F.lit(cid))))
    return c.select(*CUSTOMER_COLS).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(size)


def products_page_after(t: Tables, size: int = 20, after: tuple | None = None,
                        active_only: bool = True) -> DataFrame:
    """Keyset page of products after (name, id), by name."""
    p = t.products
    if active_only:
        p = p.filter(F.col("is_active"))
    if after is not None:
        name, pid = after
        p = p.filter((F.col("name") > F.lit(name)) |
                     ((F.col("name") == F.lit(name)) & (F.col("id") > F.lit(pid))))
    return p.select(*PRODUCT_COLS).orderBy("name", "id").limit(size)


# ---------------------------------------------------------------------------
# Pages at any depth
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Pages:
    """Pages of one listing, as it was when its directory was built."""
    directory: PageDirectory
    # Filter value -> rows that the page metadata counts; None: all rows.
    totals: dict

    def page(self, page: int = 1, size: int = 20, value=None) -> PagedResult:
        check_page(page, size)
        items = self.directory.slice((page - 1) * size, size, value)
        return PagedResult(items, self.totals.get(value, 0), page, size)


def _totals(df: DataFrame, column: str) -> dict:
    """Rows per value of a column with few values, and of all."""
    found = {r[0]: r[1] for r in df.groupBy(column).count().collect()}
    return {k: n for k, n in found.items() if k is not None} | {None: sum(found.values())}


def orders_pages(t: Tables, path: str | None = None, ranges: int | None = None) -> Pages:
    """The listing of ``orders_page``: ``page(n, size, status)``, ``status`` in
    lower case.  Orders and customers are joined once, when it is built.  ``path``: a
    folder to keep it in (default: a scratch folder)."""
    keys = [SortKey("placed_at", descending=True), SortKey("id", descending=True)]
    rows = _order_summaries(t, t.orders)
    return Pages(build_directory(rows, keys, path or scratch_path(t.spark, "orders_pages"), "status", ranges),
                 _totals(t.orders, "status"))


def customers_pages(t: Tables, path: str | None = None, ranges: int | None = None) -> Pages:
    """The listing of ``customers_page`` (active customers, newest first)."""
    keys = [SortKey("created_at", descending=True), SortKey("id", descending=True)]
    rows = t.customers.filter(F.col("is_active")).select(*CUSTOMER_COLS)
    found = build_directory(rows, keys, path or scratch_path(t.spark, "customers_pages"), None, ranges)
    return Pages(found, {None: found.total()})


def products_pages(t: Tables, path: str | None = None, ranges: int | None = None) -> Pages:
    """The listing of ``products_page``: ``page(n, size, True)`` has the active
    products, ``page(n, size)`` all of them."""
    keys = [SortKey("name"), SortKey("id")]
    rows = t.products.select(*PRODUCT_COLS)
    return Pages(build_directory(rows, keys, path or scratch_path(t.spark, "products_pages"), "is_active", ranges),
                 _totals(t.products, "is_active"))
