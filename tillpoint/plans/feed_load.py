"""Feed load job: read -> validate/normalise -> resolve keys -> skip
already-loaded rows -> write orders and items together -> audit.

Plan:
* ``tag_rows`` is one projection: a single CASE chain gives each row its
  first failing rule (E1-E7 plus ``bad_number``) and message; no action.
* ``resolve_keys`` joins active customers by email and active products by
  sku (E9/E10).  Both lookups are aggregated (one id per key) before the
  join, so adaptive execution knows their exact size and broadcasts them
  when they are under the broadcast threshold, sort-merge (with skew
  splitting) when not.  An explicit row bound can force the broadcast
  decision instead.
  Rows that already failed a check carry keys that match nothing and differ
  from each other, so a blank email or sku is no hot key.
* Idempotency (E13): the first row (lowest row number) of each
  (external order id, sku) among the resolved rows is the load candidate
  (min aggregate, partial per task), then an anti join against the ledger
  of committed runs; the flags are bitmaps over the unique row number,
  written once and broadcast to the rows (joined, where row numbers lie too far apart).
* The resolved feed is written once to the checkpoint folder; the first-row choice,
  totals, the first ten messages, id assignment and the outputs all read that,
  and none of them moves its rows.
* Publication is all-or-nothing through ``RunStore`` (E14).  Loading a run
  id that is already committed returns the recorded result and writes
  nothing.  If another run loaded some of the same rows meanwhile, the
  resolved rows are classified again against the ledger as it is then.  Ids
  are reserved in the store before rows are written.  Every run leaves an
  audit row, whatever became of it (E16).
"""

from __future__ import annotations

import datetime as dt
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.functions.expr import parse_trimmed_timestamp, trim_ws
from tillpoint.operators.contracts import with_generated
from tillpoint.operators.ranking import bitmap_place, bitmap_slot, dense_ids_by_int_key, has_bit, key_bitmaps
from tillpoint.plans.live_views import sales_deltas
from tillpoint.schema import DEFAULT_CURRENCY, ORDER_STATUSES
from tillpoint.session import materialize
from tillpoint.sources.feed import number_files, number_rows, scan_order_feed
from tillpoint.sources.store import DELTA_SCHEMAS, RunCommittedError, RunConflictError, RunStore, max_ids
from tillpoint.sources.tables import Tables, conform

STAGE_VALIDATION = 1
STAGE_LOOKUP = 2
MAX_ERRORS_ALLOWED = 100
ERROR_TEXT_MESSAGES = 10
# Publications that other writers may overtake before the load gives up.
CONFLICT_RETRIES = 20
# A lookup row in memory, about, and the rows of a hashed lookup in one task.
LOOKUP_ROW_BYTES = 64
HASHED_ROWS = 250_000
PRICE_LIMIT = 10 ** 8          # unit_price is DECIMAL(10,2)
TOTAL_LIMIT = 10 ** 10         # total_amount is DECIMAL(12,2)

# ---------------------------------------------------------------------------
# Reject codes in rule order, and their message texts.
# {name} is replaced by a column value; validation messages are prefixed
# with "[Row {row_num}] ".  bad_number is ours (the original aborts the run).
# ---------------------------------------------------------------------------
ROW_PREFIX = "[Row {row_num}] "
MESSAGES = {
    "missing_order_id": "Missing order_id",
    "missing_customer_email": "Missing customer_email",
    "missing_product_sku": "Missing product_sku",
    "bad_number": "Invalid number: quantity '{quantity}', unit_price '{unit_price}'",
    "bad_quantity": "Quantity must be > 0 (got {quantity_n})",
    "negative_price": "Unit price cannot be negative",
    "bad_date": "Invalid date format: '{order_date}'",
    "bad_status": "Invalid status '{status}'. Allowed: pending, confirmed, shipped, delivered, cancelled, refunded",
    "unknown_customer": "Order {external_order_id}: Customer '{customer_email}' not found",
    "unknown_product": "Order {external_order_id}: Product (SKU) '{product_sku}' not found",
}
# ---------------------------------------------------------------------------
VALIDATION_CODES = tuple(MESSAGES)[:8]
LOOKUP_CODES = tuple(MESSAGES)[8:]


def render(template: str, columns: dict[str, Column] | None = None) -> Column:
    """A message template as a concat of literals and (NULL-safe) columns."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
        else:
            col = (columns or {}).get(piece, F.col(piece))
            parts.append(F.coalesce(col.cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def _messages(codes: tuple[str, ...], columns: dict[str, Column]) -> Column:
    """The message of a row by its ``code``, NULL without one.  What the templates begin with
    is looked up, so that the generated method stays small enough to be compiled."""
    heads, rest = [], None
    for name in codes:
        head, brace, tail = MESSAGES[name].partition("{")
        heads += [F.lit(name), F.lit(head)]
        if brace:
            text = render(brace + tail, columns)
            rest = (F.when if rest is None else rest.when)(F.col("code") == name, text)
    return F.concat(F.element_at(F.create_map(*heads), F.col("code")), rest.otherwise(F.lit("")))


CLEAN_COLUMNS = ["row_num", "external_order_id", "customer_email", "product_sku", "quantity",
                 "unit_price", "order_date", "status", "subtotal"]


def tag_rows(feed: DataFrame, row_prefix: bool = True) -> DataFrame:
    """E1-E8 on a feed with FEED_COLUMNS (+ row_num): normalised columns
    plus ``code`` / ``stage`` / ``message`` (NULL when the row is valid).
    With ``row_prefix=False`` the "[Row n] " prefix is left for
    ``add_row_prefix`` (row numbers computed later, see ``load_feed``)."""
    extra = [c for c in ("row_num", "feed_seq", "source_file", "_block", "_mid", "_file") if c in feed.columns]
    # Trimmed, then parsed, then checked: each in a projection of its own, so that
    # no row is trimmed or parsed again by every expression that needs the result.
    trimmed = feed.select(
        *extra, "quantity", "order_date", "status", F.col("unit_price").alias("unit_price_raw"),
        trim_ws(F.col("order_id")).alias("external_order_id"),
        F.lower(trim_ws(F.col("customer_email"))).alias("customer_email"),
        F.upper(trim_ws(F.col("product_sku"))).alias("product_sku"),
        trim_ws(F.col("quantity")).alias("_quantity"), trim_ws(F.col("unit_price")).alias("_price"),
        trim_ws(F.col("order_date")).alias("_date"), F.lower(trim_ws(F.col("status"))).alias("status_n"))
    parsed = trimmed.select(
        *extra, "quantity", "order_date", "status", "unit_price_raw", "external_order_id", "customer_email", "product_sku",
        "status_n", F.col("_quantity").try_cast("int").alias("quantity_n"),
        F.col("_price").try_cast("decimal(24,10)").alias("_exact"), parse_trimmed_timestamp(F.col("_date")).alias("order_date_n"))
    exact = F.col("_exact")
    # More than four decimals, or more than the price column holds: no number.
    fits = (exact == exact.cast("decimal(24,4)")) & (F.abs(F.round(exact, 2)) < F.lit(PRICE_LIMIT).cast("decimal(12,2)"))
    priced = parsed.withColumn("unit_price_n", F.when(fits, exact).cast("decimal(18,4)")).drop("_exact")
    qty, price, when_ts, status = (F.col(c) for c in ("quantity_n", "unit_price_n", "order_date_n", "status_n"))
    total = line_total(qty, price)
    # The order total and the item's generated subtotal (quantity times the stored price).
    too_large = (F.abs(F.round(total, 2)) >= F.lit(TOTAL_LIMIT).cast("decimal(12,0)")) | (
        F.abs(qty.cast("decimal(10,0)") * F.round(price, 2)) >= F.lit(TOTAL_LIMIT).cast("decimal(12,0)"))
    blank = lambda c: F.col(c).isNull() | (F.col(c) == F.lit(""))
    code = (F.when(blank("external_order_id"), "missing_order_id")
             .when(blank("customer_email"), "missing_customer_email")
             .when(blank("product_sku"), "missing_product_sku")
             .when(qty.isNull() | price.isNull(), "bad_number")
             .when(qty <= 0, "bad_quantity")
             .when(price < 0, "negative_price")
             .when(too_large, "bad_number")
             .when(when_ts.isNull(), "bad_date")
             .when(status.isNull() | ~status.isin(*ORDER_STATUSES), "bad_status"))
    raw = {"quantity": F.col("quantity"), "unit_price": F.col("unit_price_raw"),
           "order_date": F.col("order_date"), "status": F.col("status")}
    message = _messages(VALIDATION_CODES, raw)
    message = F.concat(render(ROW_PREFIX), message) if row_prefix else message
    return priced.withColumn("code", code).select(
        *extra, "external_order_id", "customer_email", "product_sku",
        F.col("quantity_n").alias("quantity"), F.col("unit_price_n").alias("unit_price"),
        F.col("order_date_n").alias("order_date"), F.col("status_n").alias("status"),
        line_total(F.col("quantity_n"), F.col("unit_price_n")).alias("subtotal"),
        "code",
        F.when(F.col("code").isNotNull(), F.lit(STAGE_VALIDATION)).alias("stage"),
        message.alias("message"))


def line_total(quantity: Column, unit_price: Column) -> Column:
    return quantity.cast("decimal(10,0)") * unit_price


def add_row_prefix(df: DataFrame) -> DataFrame:
    """Prefix validation messages with "[Row n] " once row_num is known."""
    prefix = F.concat(render(ROW_PREFIX), F.col("message"))
    return df.withColumn("message", F.when(F.col("stage") == STAGE_VALIDATION, prefix)
                         .otherwise(F.col("message")))


def clean_rows(tagged: DataFrame) -> DataFrame:
    """Rows passing validation (the transform's output)."""
    return tagged.filter(F.col("code").isNull()).select(*CLEAN_COLUMNS)


def _lookup(df: DataFrame, key: str, out_key: str, out_id: str, max_rows: int | None) -> DataFrame:
    """One id per key.  A lookup that is too large to broadcast, but small enough to lie in
    the tasks' memory in parts, is hashed there: then the feed's rows need no sort by a long text."""
    active = df.filter(F.col("is_active"))
    lk = active.groupBy(F.col(key).alias(out_key)).agg(F.min("id").alias(out_id))
    if max_rows is not None and lk.count() <= max_rows:
        return F.broadcast(lk)
    conf = df.sparkSession.conf
    threshold = re.fullmatch(r"(-?\d+)b?", conf.get("spark.sql.autoBroadcastJoinThreshold"))
    rows = active.count() if threshold else 0
    if threshold and rows * LOOKUP_ROW_BYTES > int(threshold[1]) and rows <= HASHED_ROWS * int(conf.get("spark.sql.shuffle.partitions")):
        return lk.hint("shuffle_hash")
    return lk


def resolve_keys(tagged: DataFrame, t: Tables, broadcast_max_rows: int | None = None) -> DataFrame:
    """E9/E10: customer id by email, product id by sku (active rows, exact
    match on the normalised feed value)."""
    cust = _lookup(t.customers, "email", "customer_email", "customer_id", broadcast_max_rows)
    prod = _lookup(t.products, "sku", "product_sku", "product_id", broadcast_max_rows)
    valid = F.col("code").isNull()
    # No email or sku holds a NUL character, so these keys match nothing.
    place = F.col("row_num" if "row_num" in tagged.columns else "_mid").cast("string")
    nowhere = F.concat(F.lit("\u0000"), F.coalesce(place, F.lit("")))
    # A row crosses the network once per lookup: with either text once, in its key if
    # that is the text itself, and without what follows from other columns.
    keyed = tagged.drop("subtotal", "stage")
    for name, key in (("customer_email", "_email"), ("product_sku", "_sku")):
        keyed = keyed.withColumn(key, F.when(valid, F.col(name)).otherwise(nowhere)).withColumn(name, F.when(~valid, F.col(name)))
    j = (keyed.join(cust.withColumnRenamed("customer_email", "_email"), "_email", "left")
         .join(prod.withColumnRenamed("product_sku", "_sku"), "_sku", "left"))
    for name, key in (("customer_email", "_email"), ("product_sku", "_sku")):
        j = j.withColumn(name, F.when(valid, F.col(key)).otherwise(F.col(name)))
    j = j.withColumn("subtotal", line_total(F.col("quantity"), F.col("unit_price"))) \
         .withColumn("stage", F.when(~valid, F.lit(STAGE_VALIDATION)))
    j = j.select(*tagged.columns, "customer_id", "product_id")
    code2 = (F.when(valid & F.col("customer_id").isNull(), "unknown_customer")
              .when(valid & F.col("product_id").isNull(), "unknown_product"))
    msg2 = (F.when(code2 == "unknown_customer", render(MESSAGES["unknown_customer"]))
             .when(code2 == "unknown_product", render(MESSAGES["unknown_product"])))
    return (j.withColumn("message", F.coalesce(F.col("message"), msg2))
             .withColumn("stage", F.coalesce(F.col("stage"), F.when(code2.isNotNull(), F.lit(STAGE_LOOKUP))))
             .withColumn("code", F.coalesce(F.col("code"), code2)))


def mark_loads(resolved: DataFrame, ledger: DataFrame) -> DataFrame:
    """E13: outcome per row - rejected / loaded / skipped.  ``feed_seq`` is
    the run-wide row position (= row_num for a single file)."""
    return _marked(resolved, ledger)[0]


def _marked(resolved: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``mark_loads`` and the bitmaps of the positions to load, if there are any."""
    if "feed_seq" not in resolved.columns:
        resolved = resolved.withColumn("feed_seq", F.col("row_num"))
    ok = resolved.filter(F.col("code").isNull())
    first = ok.groupBy("external_order_id", "product_sku").agg(F.min("feed_seq").alias("feed_seq"))
    fresh = first.join(ledger.select("external_order_id", "product_sku"),
                       ["external_order_id", "product_sku"], "left_anti")
    lo, hi = resolved.agg(F.min("feed_seq"), F.max("feed_seq")).first()
    bitmaps = key_bitmaps(fresh, "feed_seq", lo, hi)
    if bitmaps is None:
        # Row positions too far apart for bitmaps: the rows go to the flags.
        flags = materialize(fresh.select("feed_seq", F.lit(True).alias("_load")), "feed_flags")
        marked = ok.join(flags, "feed_seq", "left").withColumn(
            "outcome", F.when(F.col("_load"), "loaded").otherwise("skipped")).drop("_load")
        rejected = resolved.filter(F.col("code").isNotNull()).withColumn("outcome", F.lit("rejected"))
        return marked.unionByName(rejected), None
    # The flags go to the rows, a bit for each.
    place = bitmap_place(F.col("feed_seq"))
    outcome = F.when(F.col("code").isNotNull(), "rejected").when(has_bit(F.col("_words"), place), "loaded").otherwise("skipped")
    return (resolved.withColumn("_slot", bitmap_slot(F.col("feed_seq"))).join(F.broadcast(bitmaps.select("_slot", "_words")), "_slot", "left")
            .withColumn("outcome", outcome).drop("_slot", "_words")), bitmaps


def first_messages(resolved: DataFrame, n: int = ERROR_TEXT_MESSAGES) -> list[str]:
    """Validation messages first, then lookup messages, each in row order."""
    rows = (resolved.filter(F.col("code").isNotNull())
            .orderBy("stage", "feed_seq" if "feed_seq" in resolved.columns else "row_num").limit(n).select("message").collect())
    return [r[0] for r in rows]


def build_outputs(classified: DataFrame, max_order_id: int, max_item_id: int,
                  known: tuple[DataFrame, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """E11/E12: new orders, their single items and the ledger rows, with
    ids max+1.. in feed row order.  ``known``: bitmaps of the loaded rows' positions, and how many there are."""
    loaded = classified.filter(F.col("outcome") == "loaded")
    numbered = dense_ids_by_int_key(loaded, "feed_seq", "_seq", start=1, known=known)     # no row moves, nothing is written
    numbered = numbered.withColumn("order_id", F.col("_seq") + F.lit(max_order_id)) \
                       .withColumn("item_id", F.col("_seq") + F.lit(max_item_id))
    orders = conform(numbered.select(
        F.col("order_id").alias("id"), "customer_id", "status",
        F.col("subtotal").cast("decimal(12,2)").alias("total_amount"),
        F.lit(DEFAULT_CURRENCY).alias("currency"), F.col("order_date").alias("placed_at")), "orders")
    items = conform(with_generated(numbered.select(
        F.col("item_id").alias("id"), "order_id", "product_id", "quantity",
        F.col("unit_price").cast("decimal(10,2)").alias("unit_price"))), "order_items")
    ledger = numbered.select("external_order_id", "product_sku", "row_num", "order_id")
    return orders, items, ledger


@dataclass
class FeedLoadResult:
    run_id: str
    source_file: str | None
    records_read: int = 0
    records_loaded: int = 0
    records_failed: int = 0
    records_skipped: int = 0
    errors: list[str] = field(default_factory=list)
    duration_ms: int = 0
    status: str = "started"
    outcome: str = "ok"
    dry_run: bool = False
    classified: DataFrame | None = None
    orders: DataFrame | None = None
    items: DataFrame | None = None
    ledger: DataFrame | None = None
    run_log: DataFrame | None = None
    log_id: int | None = None
    stopped: bool = False            # fail_fast found an invalid row
    replayed: bool = False           # the run id was committed before

    @property
    def error_message(self) -> str | None:
        return "; ".join(self.errors) if self.errors else None

    @property
    def success_pct(self) -> float:
        return self.records_loaded * 100.0 / self.records_read if self.records_read else 0.0

    @property
    def records_per_sec(self) -> float:
        secs = self.duration_ms / 1000.0
        return self.records_read / secs if self.records_read and secs > 0 else 0.0

    def rejects(self) -> DataFrame:
        return self.classified.filter(F.col("outcome") == "rejected") \
                              .select("row_num", "stage", "code", "message")


def run_log_frame(spark: SparkSession, res: FeedLoadResult, run_at: dt.datetime, log_id: int) -> DataFrame:
    row = [(log_id, run_at, res.source_file, res.records_read, res.records_loaded,
            max(res.records_failed, 0), res.status, res.error_message, res.duration_ms)]
    return spark.createDataFrame(row, "id long, run_at timestamp, source_file string, records_read long, "
                                      "records_loaded long, records_failed long, status string, "
                                      "error_message string, duration_ms long")


def load_feed(t: Tables, source: str | DataFrame, store: RunStore | None = None, *,
              dry_run: bool = False, fail_fast: bool = False, max_errors: int = MAX_ERRORS_ALLOWED,
              broadcast_max_rows: int | None = None, run_id: str | None = None,
              ledger: DataFrame | None = None, source_name: str | None = None,
              multiline: bool = False) -> FeedLoadResult:
    """Run E1-E19 on a CSV path or on a feed DataFrame (FEED_COLUMNS +
    row_num).  ``t`` holds the base tables; with a ``store`` the run is
    published there unless ``dry_run``, and a failed run leaves its audit
    row there before the error is raised.  Without a store the result holds
    the DataFrames only (nothing is written).

    ``multiline``: quoted fields may hold line breaks (one more pass over the
    feed).  A ``run_id`` that is already committed is not loaded again."""
    spark = t.spark
    started = time.time()
    run_at = dt.datetime.now(dt.timezone.utc)          # aware: stored as the same instant
    run_id = run_id or "r" + uuid.uuid4().hex[:16]
    name = source_name or (source if isinstance(source, str) else None)
    res = FeedLoadResult(run_id=run_id, source_file=name, dry_run=dry_run)
    publishing = store is not None and not dry_run
    if publishing:
        done = store.marker(run_id)
        if done is not None:
            return _recorded(res, done, store, max_errors)
    try:
        resolved = _resolved(t, source, broadcast_max_rows, multiline)
        for attempt in range(CONFLICT_RETRIES + 1):
            if publishing:
                store.begin(run_id)
            _decide(res, t, resolved, store, publishing, fail_fast, ledger)
            res.status = "completed"
            res.outcome = ("threshold_exceeded" if res.records_failed > max_errors
                           else "errors" if res.records_failed > 0 else "ok")
            res.duration_ms = int((time.time() - started) * 1000)
            res.run_log = run_log_frame(spark, res, run_at, res.log_id or _next_log_id(store))
            if not publishing:
                break
            frames = {"orders": res.orders, "order_items": res.items, "load_ledger": res.ledger}
            # From the written orders and items, so that the feed's rows are not numbered again for each.
            frames |= {name: lambda written, name=name: sales_deltas(written["orders"], written["order_items"], t.products)[name]
                       for name in DELTA_SCHEMAS}
            frames = {} if res.stopped else frames
            try:
                store.publish(run_id, frames | {"etl_run_log": res.run_log}, {
                    "read": res.records_read, "loaded": res.records_loaded, "failed": res.records_failed, "skipped": res.records_skipped})
                break
            except RunConflictError:
                if attempt == CONFLICT_RETRIES:
                    raise
    except Exception as e:
        # Nothing was committed: the audit row says so, then the error goes on.
        res.status, res.records_loaded = "failed", 0
        res.errors = (res.errors + [f"Pipeline error: {e}"])[:ERROR_TEXT_MESSAGES]
        res.duration_ms = int((time.time() - started) * 1000)
        if publishing and not isinstance(e, RunCommittedError):
            # The audit id of the run that was not committed, if it has one.
            failed = run_log_frame(spark, res, run_at, res.log_id or store.reserve(logs=1)[2] + 1)
            store.publish(f"{run_id}-failed-{uuid.uuid4().hex[:8]}", {"etl_run_log": failed})
        raise
    return res


def _next_log_id(store: RunStore | None) -> int:
    """The audit id that a run would get (it is not reserved)."""
    return 1 if store is None else (store.log().agg(F.max("last_log_id")).first()[0] or 0) + 1


def _recorded(res: FeedLoadResult, done, store: RunStore, max_errors: int) -> FeedLoadResult:
    """The result of a run that is already committed, from the store."""
    res.records_read, res.records_loaded = done["records_read"], done["records_loaded"]
    res.records_failed, res.records_skipped = done["records_failed"], done["records_skipped"]
    res.orders, res.items, res.ledger, res.run_log = (
        store.table(n, res.run_id) for n in ("orders", "order_items", "load_ledger", "etl_run_log"))
    log = res.run_log.first()
    res.source_file, res.status, res.duration_ms = log["source_file"], log["status"], log["duration_ms"]
    res.errors = log["error_message"].split("; ") if log["error_message"] else []
    res.outcome = ("threshold_exceeded" if res.records_failed > max_errors
                   else "errors" if res.records_failed > 0 else "ok")
    res.replayed = True
    return res


def _resolved(t: Tables, source: str | DataFrame, broadcast_max_rows: int | None, multiline: bool) -> DataFrame:
    """The feed with checks and lookups done, written once: the first-row
    choice reads it twice (aggregate and join-back), and again if another
    writer comes first.  A CSV source is numbered afterwards from the written
    rows' split tags, so the file is parsed a single time."""
    feed = scan_order_feed(t.spark, source, multiline) if isinstance(source, str) else source
    if "row_num" in feed.columns:
        return _written(resolve_keys(tag_rows(feed), t, broadcast_max_rows))
    feed, files = number_files(feed)
    pre = _written(resolve_keys(tag_rows(feed, row_prefix=False), t, broadcast_max_rows))
    return add_row_prefix(number_rows(pre, files))


def _written(resolved: DataFrame) -> DataFrame:
    """The resolved rows, written without the subtotal and read with it."""
    kept = materialize(resolved.drop("subtotal"), "feed_resolved", "zstd")
    return kept.withColumn("subtotal", line_total(F.col("quantity"), F.col("unit_price"))).select(*resolved.columns)


def _decide(res: FeedLoadResult, t: Tables, resolved: DataFrame, store: RunStore | None, publishing: bool,
            fail_fast: bool, ledger: DataFrame | None) -> None:
    """Everything from the resolved rows to the output frames, into ``res``."""
    if ledger is None:
        ledger = (store.ledger_for(resolved.filter(F.col("code").isNull())) if store is not None else
                  t.spark.createDataFrame([], "external_order_id string, product_sku string"))
    classified, bitmaps = _marked(resolved, ledger)
    totals = classified.agg(
        F.count(F.lit(1)).alias("read"),
        F.count_if(F.col("outcome") == "loaded").alias("loaded"),
        F.count_if(F.col("outcome") == "rejected").alias("failed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("stage") == STAGE_VALIDATION).alias("invalid")).first()
    res.records_read, res.records_loaded = totals["read"], totals["loaded"]
    res.records_failed, res.records_skipped = totals["failed"], totals["skipped"]
    res.errors = first_messages(resolved)
    res.stopped = fail_fast and totals["invalid"] > 0
    if res.stopped:
        res.records_loaded = 0
        classified = classified.withColumn(
            "outcome", F.when(F.col("outcome") == "loaded", "not_loaded").otherwise(F.col("outcome")))
    res.classified = classified
    if publishing:
        n = res.records_loaded
        max_o, max_i, last_log = store.reserve(n, n, 1 if res.log_id is None else 0, base=t.id_tables())
        res.log_id = res.log_id or last_log + 1
    else:
        max_o, max_i = max_ids(*t.id_tables()) if store is None else store.id_marks(*t.id_tables())
    res.orders, res.items, res.ledger = build_outputs(classified, max_o, max_i, None if bitmaps is None else (bitmaps, res.records_loaded))
