"""Table schemas, fixed value sets and the declared table contract."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the modelled system's values)
# ---------------------------------------------------------------------------
# Order statuses, in declaration order (also the order used in messages).
ORDER_STATUSES = ("pending", "confirmed", "shipped", "delivered", "cancelled", "refunded")
# Statuses that do not count as revenue.
NON_REVENUE_STATUSES = ("cancelled", "refunded")
# Audit-run statuses allowed by the run-log table.
RUN_STATUSES = ("started", "completed", "failed")
DEFAULT_CURRENCY = "USD"
DEFAULT_ORDER_STATUS = "pending"
# ---------------------------------------------------------------------------

MONEY10 = T.DecimalType(10, 2)
MONEY12 = T.DecimalType(12, 2)


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


CUSTOMERS = T.StructType([
    _f("id", T.LongType(), False), _f("email", T.StringType(), False),
    _f("first_name", T.StringType(), False), _f("last_name", T.StringType(), False),
    _f("country", T.StringType()), _f("city", T.StringType()),
    _f("created_at", T.TimestampType(), False), _f("is_active", T.BooleanType(), False),
])
CATEGORIES = T.StructType([
    _f("id", T.LongType(), False), _f("name", T.StringType(), False),
    _f("description", T.StringType()), _f("created_at", T.TimestampType(), False),
])
PRODUCTS = T.StructType([
    _f("id", T.LongType(), False), _f("category_id", T.LongType(), False),
    _f("sku", T.StringType(), False), _f("name", T.StringType(), False),
    _f("description", T.StringType()), _f("unit_price", MONEY10, False),
    _f("stock", T.IntegerType(), False), _f("is_active", T.BooleanType(), False),
    _f("created_at", T.TimestampType(), False),
])
ORDERS = T.StructType([
    _f("id", T.LongType(), False), _f("customer_id", T.LongType(), False),
    _f("status", T.StringType(), False), _f("total_amount", MONEY12, False),
    _f("currency", T.StringType(), False), _f("placed_at", T.TimestampType(), False),
    _f("shipped_at", T.TimestampType()), _f("delivered_at", T.TimestampType()),
])
ORDER_ITEMS = T.StructType([
    _f("id", T.LongType(), False), _f("order_id", T.LongType(), False),
    _f("product_id", T.LongType(), False), _f("quantity", T.IntegerType(), False),
    _f("unit_price", MONEY10, False), _f("subtotal", MONEY12),
])
ETL_RUN_LOG = T.StructType([
    _f("id", T.LongType(), False), _f("run_at", T.TimestampType(), False),
    _f("source_file", T.StringType()), _f("records_read", T.LongType(), False),
    _f("records_loaded", T.LongType(), False), _f("records_failed", T.LongType(), False),
    _f("status", T.StringType(), False), _f("error_message", T.StringType()),
    _f("duration_ms", T.LongType()),
])

SCHEMAS = {
    "customers": CUSTOMERS, "categories": CATEGORIES, "products": PRODUCTS,
    "orders": ORDERS, "order_items": ORDER_ITEMS, "etl_run_log": ETL_RUN_LOG,
}

# Raw order feed: every column read as text and bound by header name.
FEED_COLUMNS = ("order_id", "customer_email", "product_sku", "quantity",
                "unit_price", "order_date", "status")


# ---------------------------------------------------------------------------
# Table contract (not-null, unique, foreign key, range, domain, length,
# generated column).  NULL passes a range/domain check; only FALSE violates.
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class TableContract:
    table: str
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = ()   # (column, parent table, parent column)
    ranges: tuple[tuple[str, str, float], ...] = ()        # (column, op, bound) op in >=, >
    domains: tuple[tuple[str, tuple[str, ...]], ...] = ()
    max_length: tuple[tuple[str, int], ...] = ()
    generated: tuple[tuple[str, str], ...] = field(default=())  # (column, rule name)


CONTRACTS = {
    "customers": TableContract(
        "customers",
        not_null=("id", "email", "first_name", "last_name", "created_at", "is_active"),
        unique=(("id",), ("email",)),
        max_length=(("email", 255), ("first_name", 100), ("last_name", 100),
                    ("country", 100), ("city", 100)),
    ),
    "categories": TableContract(
        "categories",
        not_null=("id", "name", "created_at"),
        unique=(("id",), ("name",)),
        max_length=(("name", 100),),
    ),
    "products": TableContract(
        "products",
        not_null=("id", "category_id", "sku", "name", "unit_price", "stock", "is_active", "created_at"),
        unique=(("id",), ("sku",)),
        foreign_keys=(("category_id", "categories", "id"),),
        ranges=(("unit_price", ">=", 0), ("stock", ">=", 0)),
        max_length=(("sku", 50), ("name", 255)),
    ),
    "orders": TableContract(
        "orders",
        not_null=("id", "customer_id", "status", "total_amount", "currency", "placed_at"),
        unique=(("id",),),
        foreign_keys=(("customer_id", "customers", "id"),),
        ranges=(("total_amount", ">=", 0),),
        domains=(("status", ORDER_STATUSES),),
        max_length=(("status", 50), ("currency", 3)),
    ),
    "order_items": TableContract(
        "order_items",
        not_null=("id", "order_id", "product_id", "quantity", "unit_price"),
        unique=(("id",),),
        foreign_keys=(("order_id", "orders", "id"), ("product_id", "products", "id")),
        ranges=(("quantity", ">", 0), ("unit_price", ">=", 0)),
        generated=(("subtotal", "quantity_times_unit_price"),),
    ),
    "etl_run_log": TableContract(
        "etl_run_log",
        not_null=("id", "run_at", "records_read", "records_loaded", "records_failed", "status"),
        unique=(("id",),),
        domains=(("status", RUN_STATUSES),),
        max_length=(("source_file", 500), ("status", 20)),
    ),
}
