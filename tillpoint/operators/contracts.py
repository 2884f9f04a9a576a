"""Table contracts as data-quality jobs, and the write-side helpers that
keep them (defaults, generated column, identities, insert-if-absent,
delete cascade).

``validate_contract`` returns one row per (table, rule, column) with the
number of violating rows, zero included, so a clean table still lists
every rule it was checked against.  Per table, every row-local rule
(not-null, range, domain, length, generated column) is one conditional
count in a single aggregate: one scan per table.  Unique keys use
count(key) - count(distinct key) (NULL keys never collide).  Foreign keys
count distinct child keys first (partial aggregation, so a hot key is one
row per task), anti-join those against the parent keys and sum the counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.expr import subtotal_of
from tillpoint.operators.ranking import dense_ids
from tillpoint.schema import CONTRACTS, DEFAULT_CURRENCY, DEFAULT_ORDER_STATUS
from tillpoint.sources.tables import Tables

RESULT_SCHEMA = "table string, rule string, column string, violations long"


def _row_rules(contract) -> list[tuple[str, str, Column]]:
    """(rule, column, violation predicate) for the row-local rules."""
    rules = []
    for c in contract.not_null:
        rules.append(("not_null", c, F.col(c).isNull()))
    for c, op, bound in contract.ranges:
        cond = F.col(c) >= F.lit(bound) if op == ">=" else F.col(c) > F.lit(bound)
        rules.append((f"range{op}{bound:g}", c, ~cond))          # NULL -> not a violation
    for c, values in contract.domains:
        rules.append(("domain", c, ~F.col(c).isin(*values)))
    for c, n in contract.max_length:
        rules.append((f"max_length_{n}", c, F.char_length(F.col(c)) > F.lit(n)))
    for c, rule in contract.generated:
        if rule == "quantity_times_unit_price":
            expected = subtotal_of(F.col("quantity"), F.col("unit_price"))
            rules.append(("generated", c, ~F.col(c).eqNullSafe(expected)))
    return rules


def validate_table(t: Tables, table: str) -> DataFrame:
    contract = CONTRACTS[table]
    df = t.get(table)
    spark = df.sparkSession
    parts = []
    row_rules = _row_rules(contract)
    aggs = [F.count_if(pred).alias(f"r{i}") for i, (_, _, pred) in enumerate(row_rules)]
    for j, key in enumerate(contract.unique):
        k = F.col(key[0]) if len(key) == 1 else F.struct(*[F.col(c) for c in key])
        nonnull = F.when(~F.array_contains(F.array(*[F.col(c).isNull() for c in key]), True), k)
        aggs.append((F.count(nonnull) - F.count_distinct(nonnull)).alias(f"u{j}"))
    labels = [(rule, col, f"r{i}") for i, (rule, col, _) in enumerate(row_rules)]
    labels += [("unique", ",".join(key), f"u{j}") for j, key in enumerate(contract.unique)]
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(col).alias("column"),
                              F.col(name).cast("long").alias("violations")) for rule, col, name in labels])
    parts.append(df.agg(*aggs).select(F.inline(rows))
                 .select(F.lit(table).alias("table"), "rule", "column", "violations"))
    for col, parent, pcol in contract.foreign_keys:
        child_keys = (df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_k"))
                      .agg(F.count(F.lit(1)).alias("_n")))
        parent_keys = t.get(parent).select(F.col(pcol).alias("_k"))
        missing = child_keys.join(parent_keys, "_k", "left_anti")
        parts.append(missing.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("violations"))
                     .select(F.lit(table).alias("table"), F.lit("foreign_key").alias("rule"),
                             F.lit(f"{col}->{parent}.{pcol}").alias("column"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_contract(t: Tables, tables: tuple[str, ...] | None = None) -> DataFrame:
    names = tables or tuple(n for n in CONTRACTS if t.get(n) is not None)
    out = None
    for name in names:
        v = validate_table(t, name)
        out = v if out is None else out.unionByName(v)
    return out


def violating_rows(t: Tables, table: str) -> DataFrame:
    """Rows of ``table`` that break a row-local rule, with the rule names."""
    rules = _row_rules(CONTRACTS[table])
    df = t.get(table)
    names = F.array_compact(F.array(*[F.when(pred, F.lit(f"{rule}:{col}")) for rule, col, pred in rules]))
    return df.withColumn("violated", names).filter(F.size("violated") > 0)


# ---------------------------------------------------------------------------
# Write-side helpers
# ---------------------------------------------------------------------------
def _defaults() -> dict[str, dict[str, Column]]:
    now = F.current_timestamp()
    return {
        "customers": {"is_active": F.lit(True), "created_at": now},
        "categories": {"created_at": now},
        "products": {"is_active": F.lit(True), "stock": F.lit(0), "created_at": now},
        "orders": {"status": F.lit(DEFAULT_ORDER_STATUS), "currency": F.lit(DEFAULT_CURRENCY),
                   "placed_at": now},
        "etl_run_log": {"run_at": now, "records_read": F.lit(0), "records_loaded": F.lit(0),
                        "records_failed": F.lit(0), "status": F.lit("started")},
    }


def apply_defaults(df: DataFrame, table: str) -> DataFrame:
    """Add defaulted columns that are absent.  A present column keeps its
    values: an explicit NULL is a not-null violation, not a default."""
    for col, expr in _defaults().get(table, {}).items():
        if col not in df.columns:
            df = df.withColumn(col, expr)
    if table == "order_items":
        df = with_generated(df)
    return df


def with_generated(items: DataFrame) -> DataFrame:
    """subtotal = quantity * unit_price, DECIMAL(12,2)."""
    return items.withColumn("subtotal", subtotal_of(F.col("quantity"), F.col("unit_price")))


def assign_ids(new_rows: DataFrame, existing: DataFrame, order_cols: list[str], id_col: str = "id") -> DataFrame:
    """Identity for new rows: max(existing id) + 1, 2, ... in ``order_cols``
    order (must be total), numbered in range partitions."""
    start = existing.agg(F.max(id_col)).first()[0] or 0
    return dense_ids(new_rows, order_cols, id_col, start=start + 1)


def insert_if_absent(target: DataFrame, incoming: DataFrame, key: list[str] | list[list[str]],
                     prefer: str | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING as a DataFrame: the target plus the
    incoming rows that conflict with nothing.  ``key`` is one unique key or a
    list of them (a row then conflicts if it matches on any).  As in SQL,
    NULLs differ: a row with a NULL in a key conflicts with no row on it.

    Among incoming rows of one key the smallest ``prefer`` wins (unique
    within a key, e.g. an id or a feed row number); without it an arbitrary
    one.  The choice is an aggregation (min of the preferred column, partial
    aggregation handles a hot key) and a semi join, not a window over a
    possibly huge group.  With several keys, they are applied in turn: each
    leaves the winners of the rows the one before it let through."""
    keys = [key] if isinstance(key[0], str) else key
    cols = target.columns
    new = incoming.select(*cols)
    for k in keys:
        has_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in k])
        free, bound = new.filter(has_null), new.filter(~has_null)
        bound = bound.join(target.select(*k), k, "left_anti")
        if prefer:
            winners = bound.groupBy(*k).agg(F.min(prefer).alias(prefer))
            bound = bound.join(winners, [*k, prefer], "left_semi")
        # One row per key in any case (rows equal on key and ``prefer``).
        new = bound.dropDuplicates(k).select(*cols).unionByName(free)
    return target.unionByName(new)


def delete_cascade(t: Tables, keep_orders: DataFrame) -> Tables:
    """Keep only ``keep_orders`` (rows of orders) and drop the items of
    removed orders (ON DELETE CASCADE), as a semi join on order id."""
    items = t.order_items.join(keep_orders.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    return t.with_(orders=keep_orders, order_items=items)
