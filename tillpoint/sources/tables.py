"""The five business tables as one bundle, loading, views and ad-hoc SQL."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.schema import SCHEMAS
from tillpoint.session import checkpoint_dir

TABLE_NAMES = ("customers", "categories", "products", "orders", "order_items")


@dataclass(frozen=True)
class Tables:
    customers: DataFrame
    categories: DataFrame
    products: DataFrame
    orders: DataFrame
    order_items: DataFrame
    # The audit log, where a caller wants it checked with the others.
    etl_run_log: DataFrame | None = None
    # The version of the run store whose commits are applied (``RunStore.current``).
    version: int | None = None
    # Rows with a column id that holds the highest item id, where that is cheaper to find than
    # in ``order_items``; it belongs to these items alone.
    last_item_ids: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.orders.sparkSession

    def get(self, name: str) -> DataFrame:
        return getattr(self, name)

    def with_(self, **frames: DataFrame) -> "Tables":
        if "order_items" in frames:
            frames = {"last_item_ids": None} | frames
        return replace(self, **frames)

    def id_tables(self) -> tuple[DataFrame, DataFrame]:
        """Frames whose highest ids are those of the orders and of the items."""
        return self.orders, self.order_items if self.last_item_ids is None else self.last_item_ids

    def items(self):
        return [(n, self.get(n)) for n in TABLE_NAMES]


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project and cast to the declared schema (column order included)."""
    schema = SCHEMAS[table]
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def load(spark: SparkSession, root: str) -> Tables:
    """Scan the model tables stored as Parquet under ``root/<table>``.

    Only the scan is declared; Catalyst prunes columns and pushes filters
    down to each query's scan."""
    frames = {n: spark.read.parquet(f"{root.rstrip('/')}/{n}") for n in TABLE_NAMES}
    return Tables(**frames)


def save(t: Tables, root: str, mode: str = "overwrite") -> None:
    """Write the tables; orders are clustered by placement month so that
    period queries skip row groups via min/max statistics."""
    for name, df in t.items():
        w = df
        if name == "orders":
            w = df.repartitionByRange("placed_at").sortWithinPartitions("placed_at")
        elif name == "order_items":
            w = df.repartition("order_id").sortWithinPartitions("order_id")
        w.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


# Bucketing keys of the catalog layout: orders and their items share the
# order id, so order/item joins read co-located buckets without a shuffle.
BUCKET_KEYS = {"orders": "id", "order_items": "order_id", "customers": "id", "products": "id"}


def save_bucketed(t: Tables, database: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Write the tables as catalog tables bucketed (and sorted) on their join
    keys.  Joins of orders and order_items on the order id then need no
    Exchange on either side (same bucket count, same key)."""
    spark = t.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in t.items():
        w = df.write.mode(mode).format("parquet")
        key = BUCKET_KEYS.get(name)
        if key:
            w = w.bucketBy(buckets, key).sortBy(key)
        w.saveAsTable(f"{database}.{name}")


def load_catalog(spark: SparkSession, database: str) -> Tables:
    return Tables(**{n: spark.table(f"{database}.{n}") for n in TABLE_NAMES})


def register_views(t: Tables, prefix: str = "") -> None:
    """Register the tables and the four reporting views as temp views.

    The two views that rank a whole table are snapshots, taken now and kept
    under the checkpoint folder outside the scratch folders; register again
    to refresh them.  The others are live."""
    from tillpoint.plans import analytics as A
    for name, df in t.items():
        df.createOrReplaceTempView(prefix + name)
    A.monthly_revenue_summary(t).createOrReplaceTempView(prefix + "monthly_revenue_summary")
    A.category_performance(t).createOrReplaceTempView(prefix + "category_performance")
    for name, df in (("product_sales_ranking", A.product_sales_ranking(t)),
                     ("customer_lifetime_value", A.customer_lifetime_value(t))):
        path = f"{checkpoint_dir(t.spark)}/tillpoint/views/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        t.spark.read.parquet(path).createOrReplaceTempView(prefix + name)


def sql(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """Ad-hoc SQL over registered tables and views, with named parameters."""
    return spark.sql(text, args=args) if args else spark.sql(text)
