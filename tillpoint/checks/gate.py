"""Registered queries: each takes (spark, sf_dir), binds the supplied tables
and returns the query's DataFrame with oracle-aligned output types
(integers BIGINT, money DOUBLE, timestamps without zone)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.checks import oracle
from tillpoint.functions.expr import normalize_status, ts_lit
from tillpoint.plans import analytics as A
from tillpoint.plans import catalog as C
from tillpoint.operators import contracts as K
from tillpoint.session import ensure_defaults, materialize, release_scratch, scratch_mark, scratch_path
from tillpoint.sources import tables
from tillpoint.sources.feed import write_feed_files
from tillpoint.sources.sinks import to_json_documents
from tillpoint.sources.store import RunStore
from tillpoint.sources.testdata import bind, derive_feed
from tillpoint.plans import feed_load as L
from tillpoint.plans import live_views as V
from tillpoint.plans import placement as P

AS_OF = dt.datetime(2001, 9, 1)
PERIOD = (dt.datetime(1997, 1, 1), dt.datetime(1997, 12, 31))


def for_oracle(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        dt_ = f.dataType
        if isinstance(dt_, T.DecimalType):
            c = c.cast("double")
        elif isinstance(dt_, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(dt_, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _q(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_defaults(spark)
        return for_oracle(fn(bind(spark, sf_dir)))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _feed(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    """Dry-run feed load over the feed derived from the supplied tables."""
    ensure_defaults(spark)
    t = bind(spark, sf_dir)
    feed = derive_feed(spark, sf_dir)
    if part == "rerun":
        feed = materialize(feed, "feed")           # both loads read it
    if part == "clean":
        return for_oracle(L.clean_rows(L.tag_rows(feed)))
    res = L.load_feed(t, feed, dry_run=True, source_name="derived:lineitem")
    if part == "rejects":
        return for_oracle(res.rejects())
    if part == "orders":
        return for_oracle(res.orders)
    if part == "items":
        return for_oracle(res.items)
    if part == "log":
        return for_oracle(res.run_log.drop("run_at", "duration_ms"))
    rerun = L.load_feed(t, feed, dry_run=True, ledger=res.ledger, source_name="derived:lineitem")
    return for_oracle(rerun.classified.select("row_num", "outcome"))


def _nth_order_key(t, n: int):
    """(placed_at, id) of the n-th order in newest-first order: the keyset
    cursor a client holds after reading n rows."""
    r = t.orders.orderBy(F.col("placed_at").desc(), F.col("id").desc()).offset(n - 1).limit(1).first()
    return (r["placed_at"], r["id"])


PLACED_AT = dt.datetime(2001, 9, 1)


def _place(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    """Placement of the requests derived from all orders."""
    ensure_defaults(spark)
    t = bind(spark, sf_dir)
    raw_o = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    raw_l = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    res = P.place_orders(P.requests_from_orders(t, raw_o, raw_l), t, placed_at=PLACED_AT)
    frame = {"orders": res.orders, "items": res.order_items, "rejects": res.rejects,
             "stock": res.products.select("id", "sku", "stock")}[part]
    return for_oracle(frame)


def _placement_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock as readers of the store see it after the placement is published."""
    ensure_defaults(spark)
    base = bind(spark, sf_dir)
    store = RunStore(spark, scratch_path(spark, "store"))
    t = store.current(base)
    raw = [spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet") for name in ("orders", "lineitem")]
    res = P.place_orders(P.requests_from_orders(t, *raw), t, placed_at=PLACED_AT)
    P.publish_placement(res, t, store, "placement")
    return for_oracle(store.current(base).products.select("id", "sku", "stock"))


def _feed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's figures and its outcome below and at an error threshold."""
    ensure_defaults(spark)
    t = bind(spark, sf_dir)
    feed = materialize(derive_feed(spark, sf_dir), "feed")
    mark = scratch_mark()

    def run(**how):
        """A whole load, of which only the figures are kept: its rows leave the disk before the next one begins."""
        r = L.load_feed(t, feed, dry_run=True, **how)
        release_scratch(spark, mark)
        return r
    failed = run().records_failed
    runs = [run(max_errors=n) for n in (failed - 1, failed)]
    return spark.createDataFrame(
        [(k, r.records_read, r.records_loaded, r.records_skipped, r.records_failed, r.success_pct, r.outcome) for k, r in enumerate(runs)],
        "run long, records_read long, records_loaded long, records_skipped long, records_failed long, success_pct double, outcome string")


def _reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order summaries from the tables as saved and loaded again."""
    ensure_defaults(spark)
    root = scratch_path(spark, "saved")
    tables.save(bind(spark, sf_dir), root)
    t = tables.load(spark, root)
    return for_oracle(C.orders_by_customer(t, customer_ids=t.customers.select("id")))


def _ad_hoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL with a parameter over a registered table and a registered view."""
    ensure_defaults(spark)
    tables.register_views(bind(spark, sf_dir), "adhoc_")
    return for_oracle(tables.sql(spark, """
        SELECT o.status, count(*) AS orders, sum(o.total_amount) AS total_amount, count(v.customer_id) AS with_value
        FROM adhoc_orders o LEFT JOIN adhoc_customer_lifetime_value v ON v.customer_id = o.customer_id AND v.total_orders > 5
        WHERE o.placed_at >= :since GROUP BY o.status""", {"since": PERIOD[0]}))


def _statuses(t):
    """Statuses in four spellings: as they are, upper case, padded, unknown."""
    c = F.col("status")
    raw = F.when(F.col("id") % 4 == 0, c).when(F.col("id") % 4 == 1, F.upper(c)).when(F.col("id") % 4 == 2, F.concat(c, F.lit(" "))).otherwise("lost")
    return t.orders.select("id", normalize_status(raw).alias("status"))


FEED_FILE_ROWS = 5_000


def _published(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    """The derived feed through CSV files and the store: a load, a replay of
    it, a load of the same files as a new run, and a load of a missing file."""
    ensure_defaults(spark)
    t = bind(spark, sf_dir)
    folder = scratch_path(spark, "feed_csv")
    write_feed_files(derive_feed(spark, sf_dir), folder, FEED_FILE_ROWS)
    if part == "csv_rejects":
        res = L.load_feed(t, folder, dry_run=True)
        chunk = F.regexp_extract("source_file", r"chunk=(\d+)", 1).cast("long").alias("chunk")
        return for_oracle(res.classified.filter("outcome = 'rejected'").select(chunk, "row_num", "stage", "code", "message"))
    store = RunStore(spark, scratch_path(spark, "store"))
    mark = scratch_mark()
    for run_id in ("1", "1", "2"):
        L.load_feed(t, folder, store, run_id=run_id, source_name="derived:csv")
        release_scratch(spark, mark)               # what is read from here on is in the store
    try:
        L.load_feed(t, folder + "/absent", store, run_id="3", source_name="derived:absent")
    except FileNotFoundError:
        pass
    if part == "log":
        return for_oracle(store.table("etl_run_log").select("id", "source_file", "status", "records_read", "records_loaded", "records_failed"))
    if part == "ledger":
        return for_oracle(store.table("load_ledger"))
    return for_oracle(store.table("orders").join(
        store.table("order_items").select(F.col("id").alias("item_id"), F.col("order_id").alias("id"), "product_id", "quantity"), "id")
        .select("id", "customer_id", "status", "total_amount", "placed_at", "item_id", "product_id", "quantity"))


class _Overtaken(RunStore):
    """A store in which another writer publishes between a run's reading and
    its publication."""

    def __init__(self, spark, root, other):
        super().__init__(spark, root)
        self.other = other

    def publish(self, run_id, frames, counts=None):
        other, self.other = self.other, None
        if other is not None:
            other(RunStore(self.spark, self.root))
        return super().publish(run_id, frames, counts)


def _two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two interleaved loads of the derived feed: how often each row was
    loaded, and how many orders and items carry its order's id."""
    ensure_defaults(spark)
    t = bind(spark, sf_dir)
    feed = materialize(derive_feed(spark, sf_dir), "feed")
    store = _Overtaken(spark, scratch_path(spark, "store"), lambda s: L.load_feed(t, feed.filter("row_num % 3 = 0"), s, run_id="early"))
    mark = scratch_mark()
    L.load_feed(t, feed, store, run_id="late")
    release_scratch(spark, mark)                   # what is read from here on is in the store
    ledger = store.table("load_ledger")
    of = lambda name, key: store.table(name).groupBy(F.col(key).alias("order_id")).agg(F.count(F.lit(1)).alias(name))
    found = ledger.join(of("orders", "id"), "order_id", "left").join(of("order_items", "order_id"), "order_id", "left")
    return for_oracle(found.groupBy("external_order_id", "product_sku").agg(
        F.count(F.lit(1)).alias("loads"), F.sum("orders").alias("orders"), F.sum("order_items").alias("items")))


def _line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the derived feed, read from CSV files whose order ids hold
    line breaks."""
    ensure_defaults(spark)
    t = bind(spark, sf_dir)
    feed = derive_feed(spark, sf_dir).withColumn("order_id", F.replace("order_id", F.lit("EXT-"), F.lit('EXT"\n')))
    folder = scratch_path(spark, "feed_csv")
    write_feed_files(feed, folder, FEED_FILE_ROWS)
    res = L.load_feed(t, folder, dry_run=True, multiline=True)
    return for_oracle(res.ledger.select("external_order_id", "product_sku", "row_num"))


def _hurt(t):
    """The tables with breaches of every rule, chosen by id."""
    def put(df, mod, **changes):
        for k, (name, value) in enumerate(changes.items(), start=1):
            column = name.split("__")[0]
            df = df.withColumn(column, F.when(F.col("id") % mod == k, value).otherwise(F.col(column)).cast(df.schema[column].dataType))
        return df
    null = F.lit(None)
    log = t.orders.select(
        "id", F.col("placed_at").alias("run_at"), F.lit("feed.csv").alias("source_file"), F.lit(5).cast("long").alias("records_read"),
        F.lit(5).cast("long").alias("records_loaded"), F.lit(0).cast("long").alias("records_failed"), F.lit("completed").alias("status"),
        null.cast("string").alias("error_message"), F.lit(1).cast("long").alias("duration_ms"))
    return t.with_(
        customers=put(t.customers, 50, email=null, email__2=F.lit("same@example.com"), country=F.repeat(F.lit("x"), F.lit(101)),
                      is_active=null, first_name=F.repeat(F.lit("n"), F.lit(101)), created_at=null),
        categories=t.categories.withColumn("name", F.when(F.col("id") <= 2, "TWICE").otherwise(F.col("name"))),
        products=put(t.products, 40, unit_price=F.lit(-1), stock=F.lit(-1), category_id=F.lit(99), sku=F.repeat(F.lit("S"), F.lit(51)),
                     sku__2=F.lit("SAME"), name=null),
        orders=put(t.orders, 60, status=F.lit("lost"), total_amount=F.lit(-1), customer_id=F.lit(10 ** 9), currency=F.lit("EURO"),
                   placed_at=null, status__2=null, customer_id__2=null),
        order_items=put(t.order_items, 70, quantity=F.lit(0), unit_price=F.lit(-1), order_id=F.lit(10 ** 9), product_id=null,
                        subtotal=F.col("subtotal") + 1, subtotal__2=null, id__2=F.lit(7)),
        etl_run_log=put(log, 80, status=F.lit("unknown"), status__2=F.repeat(F.lit("s"), F.lit(21)), status__3=null,
                        source_file=F.repeat(F.lit("f"), F.lit(501)), records_read=null, run_at=null))


def _one(fn: Callable) -> Callable:
    """A single-id lookup: ``fn(t, id)`` for the largest id of the orders."""
    def run(t):
        r = t.orders.orderBy(F.col("id").desc()).select("id", "customer_id").first()
        return fn(t, r["id"], r["customer_id"])
    return _q(run)


def _live(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A live view registered over half of the orders; the others are committed
    afterwards, in two runs."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_defaults(spark)
        t = bind(spark, sf_dir)
        part = lambda *rest: t.with_(orders=t.orders.filter((F.col("id") % 4).isin(*rest)),
                                     order_items=t.order_items.filter((F.col("order_id") % 4).isin(*rest)))
        store = RunStore(spark, scratch_path(spark, "store"))
        V.register_live_views(part(0, 1), store, f"gate_live_{name}_")
        for k in (2, 3):
            new = part(k)
            store.publish(f"run{k}", {"orders": new.orders, "order_items": new.order_items}
                          | V.sales_deltas(new.orders, new.order_items, t.products))
        view = spark.sql(f"SELECT * FROM gate_live_{name}_{name}")
        return for_oracle(view.drop("days_since_last_order"))
    return run


def _deep(pages: C.Pages, size: int, value=None) -> DataFrame:
    """The page that holds the row at nine tenths of a listing."""
    return pages.page(pages.totals[value] * 9 // 10 // size + 1, size, value).as_frame()


def _sql(name: str, call: str) -> Callable[[SparkSession, str], DataFrame]:
    """A SQL table function over views of the bound tables."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_defaults(spark)
        A.register_table_functions(bind(spark, sf_dir), "gate_")
        return for_oracle(spark.sql(f"SELECT * FROM gate_{name}({call})"))
    return run


def _null_emails(df):
    return df.withColumn("email", F.when(F.col("id") % 4 != 0, F.col("email")))


def _product_categories(t):
    """Every product a category of its own: many shares of all sizes."""
    cats = t.products.select("id", F.col("sku").alias("name"), "description", "created_at")
    return A.category_performance(t.with_(categories=cats, products=t.products.withColumn("category_id", F.col("id"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "monthly_revenue_summary": _q(A.monthly_revenue_summary),
    "product_sales_ranking": _q(A.product_sales_ranking),
    "top_products": _q(lambda t: A.top_products(t, 10)),
    "customer_lifetime_value": _q(lambda t: A.customer_lifetime_value(t, as_of=AS_OF)),
    "customer_stats": _q(lambda t: A.customer_stats(t, 20, as_of=AS_OF)),
    "category_performance": _q(A.category_performance),
    "sales_by_period": _q(lambda t: A.sales_by_period(t, *PERIOD)),
    "top_customers": _q(lambda t: A.top_customers(t, 10)),
    "top_customers_country": _q(lambda t: A.top_customers(t, 5, oracle.TOP_COUNTRY)),
    "orders_page": _q(lambda t: C.orders_page(t, *oracle.ORDERS_PAGE).as_frame()),
    "orders_page_status": _q(lambda t: C.orders_page(t, *oracle.ORDERS_STATUS_PAGE).as_frame()),
    "orders_keyset_page": _q(lambda t: C.orders_page_after(
        t, oracle.ORDERS_PAGE[1], after=_nth_order_key(t, (oracle.ORDERS_PAGE[0] - 1) * oracle.ORDERS_PAGE[1]))),
    "orders_by_customer": _q(lambda t: C.orders_by_customer(t, customer_ids=t.customers.select("id"))),
    "order_detail": _q(lambda t: C.order_detail_lines(t, order_ids=t.orders.select("id"))),
    "customer_by_id": _q(lambda t: C.customer_by_id(t, customer_ids=t.customers.select("id"))),
    "customers_page": _q(lambda t: C.customers_page(t, *oracle.CUSTOMERS_PAGE).as_frame()),
    "product_by_id": _q(lambda t: C.product_by_id(t, product_ids=t.products.select("id"), nested=False)),
    "products_by_category": _q(lambda t: C.products_by_category(t, category_ids=t.categories.select("id"))),
    "products_page": _q(lambda t: C.products_page(t, *oracle.PRODUCTS_PAGE).as_frame()),
    "products_page_all": _q(lambda t: C.products_page(t, *oracle.PRODUCTS_ALL_PAGE,
                                                      active_only=False).as_frame()),
    "orders_deep_page": _q(lambda t: _deep(C.orders_pages(t), oracle.DEEP_SIZE)),
    "orders_deep_page_status": _q(lambda t: _deep(C.orders_pages(t), oracle.DEEP_SIZE, "shipped")),
    "customers_deep_page": _q(lambda t: _deep(C.customers_pages(t), oracle.DEEP_SIZE)),
    "products_deep_page": _q(lambda t: _deep(C.products_pages(t), oracle.DEEP_SIZE, True)),
    **{f"live_{name}": _live(name) for name in V.NAMES},
    "contract_violations": _q(K.validate_contract),
    "insert_if_absent": _q(lambda t: K.insert_if_absent(
        t.customers.filter(F.col("created_at") < ts_lit(dt.datetime(1995, 7, 1))),
        t.customers, ["email"], prefer="id")),
    "feed_clean": lambda spark, d: _feed(spark, d, "clean"),
    "feed_rejects": lambda spark, d: _feed(spark, d, "rejects"),
    "feed_load_orders": lambda spark, d: _feed(spark, d, "orders"),
    "feed_load_items": lambda spark, d: _feed(spark, d, "items"),
    "feed_rerun_skips": lambda spark, d: _feed(spark, d, "rerun"),
    "feed_run_log": lambda spark, d: _feed(spark, d, "log"),
    "feed_csv_rejects": lambda spark, d: _published(spark, d, "csv_rejects"),
    "feed_published_twice": lambda spark, d: _published(spark, d, "orders"),
    "feed_published_ledger": lambda spark, d: _published(spark, d, "ledger"),
    "feed_published_log": lambda spark, d: _published(spark, d, "log"),
    "feed_two_writers": _two_writers,
    "feed_csv_line_breaks": _line_breaks,
    "contract_breaches": _q(lambda t: K.validate_contract(_hurt(t))),
    "insert_if_absent_nulls": _q(lambda t: K.insert_if_absent(
        _null_emails(t.customers.filter(F.col("created_at") < ts_lit(dt.datetime(1995, 7, 1)))),
        _null_emails(t.customers), ["email"], prefer="id").select("id", "email")),
    "apply_defaults": _q(lambda t: K.apply_defaults(t.orders.drop("status", "currency"), "orders")
                         .select("id", "customer_id", "status", "currency", "total_amount")),
    "apply_generated": _q(lambda t: K.apply_defaults(t.order_items.drop("subtotal"), "order_items").select("id", "subtotal")),
    "delete_cascade": _q(lambda t: K.delete_cascade(t, t.orders.filter("status <> 'cancelled'")).order_items),
    "order_documents": _q(lambda t: to_json_documents(C.order_detail(t, order_ids=t.orders.select("id")))),
    "order_lookup": _one(lambda t, oid, cid: C.order_detail_lines(t, order_id=oid)),
    "customer_lookup": _one(lambda t, oid, cid: C.customer_by_id(t, cid)),
    "customer_orders_lookup": _one(lambda t, oid, cid: C.orders_by_customer(t, cid)),
    "product_lookup": _one(lambda t, oid, cid: C.product_by_id(t, 1, nested=False)),
    "category_lookup": _one(lambda t, oid, cid: C.products_by_category(t, 1)),
    "category_performance_api": _q(lambda t: A.category_performance(t, api_form=True)),
    "category_shares": _q(_product_categories),
    "sql_sales_by_period": _sql("get_sales_by_period", "TIMESTAMP '1997-01-01 00:00:00', TIMESTAMP '1997-12-31 00:00:00'"),
    "sql_top_customers": _sql("get_top_customers", f"5, '{oracle.TOP_COUNTRY}'"),
    "place_orders_accepted": lambda spark, d: _place(spark, d, "orders"),
    "place_orders_items": lambda spark, d: _place(spark, d, "items"),
    "place_orders_rejects": lambda spark, d: _place(spark, d, "rejects"),
    "place_orders_stock": lambda spark, d: _place(spark, d, "stock"),
    "place_orders_published": _placement_published,
    "feed_summary": _feed_summary,
    "saved_tables": _reloaded,
    "ad_hoc_sql": _ad_hoc,
    "normalized_status": _q(_statuses),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.oracle_sql().items() if k in QUERIES}
