"""Batch order placement: the per-call placement procedure re-aimed as a
job over a DataFrame of requests (request_id, seq, customer_id,
items_json), with the result equal to placing them one by one in ``seq``
order.

Per request, all or nothing: every line must parse, have quantity > 0, name
an active product, the customer must exist, and for each product the
request's summed quantity must fit the stock left by the requests accepted
before it.  Accepted requests become ``pending`` orders whose total is
sum(price * quantity) at current prices, items snapshot the price, and the
stock is decremented.  A request id that comes again is rejected.

Sequential stock without a loop over requests:

1. A product whose whole demand fits its stock needs no order of requests;
   only the lines of scarce products go on.
2. For an undecided request r and product p let L = demand of accepted
   requests before r and U = L + demand of undecided requests before r:
   accept r if every line fits under stock - U, reject it if some line does
   not fit under stock - L.  Each round decides at least the first undecided
   request of every chain, typically nearly all, and keeps only the lines of
   undecided requests and the accepted lines of their products.  The running
   sums use ``operators.ranking`` (range partitions), so a product wanted by
   a third of all requests is not one task.
3. What a few rounds leave are chains of requests that wait for each other.
   Requests that share scarce products form connected groups, which do not
   influence each other; a group of bounded size is played through in one
   task, and larger ones get further rounds.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.functions.expr import subtotal_of, ts_lit
from tillpoint.operators.components import components
from tillpoint.operators.ranking import SortKey, dense_ids, window_positions
from tillpoint.plans.live_views import sales_deltas
from tillpoint.session import materialize
from tillpoint.sources.store import RunStore, max_ids
from tillpoint.sources.tables import Tables, conform

# Reject reasons in priority order (fixed).
REASONS = ("duplicate_request", "bad_json", "bad_quantity", "unknown_product", "unknown_customer", "insufficient_stock")
# Rounds before connected groups are formed, and lines of a group that one task plays through.
ROUNDS = 3
GROUP_LINES = 500_000


@dataclass
class PlacementResult:
    orders: DataFrame
    order_items: DataFrame
    products: DataFrame
    rejects: DataFrame
    decisions: DataFrame
    rounds: int
    stock_changes: DataFrame | None = None


def _lines(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R1: one row per JSON element, plus per-request parse status.  The
    parsed requests are written once; heads and lines both read them.

    The text must be one JSON array and nothing else: it must begin as an array, and
    parse as the first of two elements of a longer one."""
    text = F.col("items_json")
    strict = F.ltrim(text, F.lit(" \t\r\n")).startswith("[") & (
        F.json_array_length(F.concat(F.lit("["), text, F.lit(",0]"))) == 2)
    parsed = materialize(requests.select(
        "request_id", "seq", "customer_id", F.monotonically_increasing_id().alias("rid"),
        F.coalesce(strict, F.lit(False)).alias("_strict"), text.isNull().alias("_none"),
        F.from_json(text, "array<string>").alias("_items")), "placement_parsed")
    first = parsed.groupBy("request_id").agg(F.min(F.struct("seq", "rid")).alias("_first"))
    heads = parsed.select("rid", "request_id", "seq", "customer_id", (~F.col("_strict") & ~F.col("_none")).alias("bad_json"))
    heads = heads.join(first.select(F.col("_first.rid").alias("rid"), F.lit(True).alias("_once")), "rid", "left") \
                 .withColumn("again", F.col("_once").isNull()).drop("_once")
    lines = parsed.filter("_strict").select("rid", "seq", F.posexplode("_items").alias("pos", "it")).select(
        "rid", "seq", "pos",
        F.get_json_object("it", "$.product_id").try_cast("long").alias("product_id"),
        F.get_json_object("it", "$.quantity").try_cast("int").alias("quantity"))
    return heads, lines


def _round(state: DataFrame) -> DataFrame:
    """One round over (rid, seq, product_id, d, stock, st): a row (rid,
    accepted) for each request it decides."""
    live = state.withColumn("da", F.when(F.col("st") == "A", F.col("d")).otherwise(F.lit(0))) \
                .withColumn("du", F.when(F.col("st") == "U", F.col("d")).otherwise(F.lit(0)))
    run = window_positions(live, [SortKey("seq")], group_by=("product_id",), tie_break=("rid",),
                           running_sum={"ra": "da", "ru": "du"})
    lo = F.col("ra") - F.col("da")                       # accepted demand before this request
    hi = lo + F.col("ru") - F.col("du")                  # ... plus undecided demand before it
    verdict = run.filter(F.col("st") == "U").groupBy("rid").agg(
        F.min((F.col("d") <= F.col("stock") - hi).cast("int")).alias("acc"),
        F.max((F.col("d") > F.col("stock") - lo).cast("int")).alias("rej"))
    return verdict.filter("acc = 1 or rej = 1").select("rid", (F.col("rej") == 0).alias("accepted"))


def _apply(state: DataFrame, decided: DataFrame) -> DataFrame:
    """The lines that later rounds need: of undecided requests, and accepted
    ones of their products."""
    new = state.join(decided, "rid", "left").withColumn(
        "st", F.when(F.col("accepted"), "A").when(F.col("accepted").isNotNull(), "R").otherwise(F.col("st"))).drop("accepted")
    new = materialize(new.filter("st <> 'R'"), "placement_state")
    waiting = new.filter("st = 'U'").select("product_id").distinct()
    return materialize(new.join(waiting, "product_id", "left_semi"), "placement_state")


def _player():
    """The function that places the requests of connected groups one by one,
    from rows in the order of (root, seq, rid).  It keeps the stock of one group and the lines of
    one request.  A nested function reaches the workers by value, so executors need no
    copy of this package."""
    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: dict = {}
        at, undecided, wanted = None, False, []
        out: list = []

        def finish() -> None:
            fits = all(d <= left[p] for p, d in wanted)
            if fits or not undecided:
                for p, d in wanted:
                    left[p] -= d
            if undecided:
                out.append((at[1], fits))

        for rows in batches:
            for root, rid, product, d, stock, st in zip(*(rows[c].tolist() for c in ("root", "rid", "product_id", "d", "stock", "st"))):
                if at != (root, rid):
                    if wanted:
                        finish()
                    if at is None or at[0] != root:
                        left = {}
                    at, undecided, wanted = (root, rid), st == "U", []
                left.setdefault(product, stock)
                wanted.append((product, d))
            if out:
                yield pd.DataFrame(out, columns=["rid", "accepted"])
                out.clear()
        if wanted:
            finish()
        if out:
            yield pd.DataFrame(out, columns=["rid", "accepted"])
    return play


def _played(group: DataFrame) -> DataFrame:
    """A row (rid, accepted) for each undecided request of the groups.  The number of
    tasks is given: the rows are few bytes, but each of them is work."""
    tasks = int(group.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = group.repartition(tasks, "root").sortWithinPartitions("root", "seq", "rid")
    return rows.mapInPandas(_player(), "rid long, accepted boolean")


def _groups(state: DataFrame) -> DataFrame:
    """The lines of connected groups that one task can play through, with
    their group: products are linked by the undecided requests that want them."""
    least = F.min("product_id").over(Window.partitionBy("rid"))
    links = state.filter("st = 'U'").select(F.col("product_id").alias("a"), least.alias("b"))
    linked = components(links)
    tagged = state.join(linked.withColumnRenamed("id", "product_id"), "product_id", "left").withColumn(
        "root", F.coalesce("root", "product_id"))
    sizes = tagged.groupBy("root").agg(F.count(F.lit(1)).alias("_lines")).filter(F.col("_lines") <= GROUP_LINES)
    return materialize(tagged.join(sizes.select("root"), "root", "left_semi"), "placement_groups")


def decide_stock(demand: DataFrame) -> tuple[DataFrame, int]:
    """Demand (rid, seq, product_id, d, stock), one row per request and
    product -> (one row (rid, accepted) per request, number of rounds)."""
    whole = demand.groupBy("product_id").agg(F.sum("d").alias("_all"))
    scarce = demand.join(whole, "product_id").filter(F.col("_all") > F.col("stock")).drop("_all")
    state = materialize(scarce.withColumn("st", F.lit("U")), "placement_state")
    parts, rounds = [], 0
    while state.filter("st = 'U'").limit(1).count():
        rounds += 1
        if rounds > ROUNDS:
            group = _groups(state)
            played = materialize(_played(group), "placement_played")
            parts.append(played)
            state = _apply(state, played)
            if not state.filter("st = 'U'").limit(1).count():
                break
        decided = materialize(_round(state), "placement_decided")
        parts.append(decided)
        state = _apply(state, decided)
    everyone = demand.select("rid").distinct()
    if not parts:
        return everyone.withColumn("accepted", F.lit(True)), rounds
    known = reduce(DataFrame.unionByName, parts)
    # Requests without a scarce product always fit.
    return materialize(everyone.join(known, "rid", "left").withColumn("accepted", F.coalesce("accepted", F.lit(True))),
                       "placement_verdicts"), rounds


def place_orders(requests: DataFrame, t: Tables, placed_at: dt.datetime | None = None,
                 store: RunStore | None = None) -> PlacementResult:
    """Place ``requests`` against the tables ``t``.  With a ``store``, new ids
    are reserved there, after the highest that the base tables use; pass
    ``store.current(t)`` as ``t`` for the current stock, and publish the
    result with ``publish_placement``."""
    spark = t.spark
    heads, lines = _lines(requests)
    active = t.products.filter(F.col("is_active")).select(
        F.col("id").alias("product_id"), "unit_price", "stock")
    lines = materialize(lines.join(active, "product_id", "left"), "placement_lines")

    # Static checks (do not depend on other requests): R2, R8, bad JSON.
    line_flags = lines.groupBy("rid").agg(
        F.max((F.col("quantity").isNull() | (F.col("quantity") <= 0)).cast("int")).alias("_bq"),
        F.max((F.col("product_id").isNull() | F.col("unit_price").isNull()).cast("int")).alias("_up"))
    cust = t.customers.select(F.col("id").alias("customer_id"), F.lit(True).alias("_known"))
    checked = (heads.join(line_flags, "rid", "left").join(cust, "customer_id", "left")
               .withColumn("reason", F.when(F.col("again"), "duplicate_request")
                           .when(F.col("bad_json"), "bad_json")
                           .when(F.col("_bq") == 1, "bad_quantity")
                           .when(F.col("_up") == 1, "unknown_product")
                           .when(F.col("_known").isNull(), "unknown_customer")))
    checked = materialize(checked.select("rid", "request_id", "seq", "customer_id", "reason"), "placement_checked")

    # Demand per (request, product) for the requests still in play.
    open_req = checked.filter(F.col("reason").isNull()).select("rid")
    demand = (lines.join(open_req, "rid", "left_semi").groupBy("rid", "seq", "product_id")
              .agg(F.sum("quantity").alias("d"), F.first("stock").cast("long").alias("stock")))
    verdicts, rounds = decide_stock(materialize(demand, "placement_demand"))
    short = verdicts.filter("not accepted").select("rid", F.lit(True).alias("_short"))
    decisions = (checked.join(short, "rid", "left")
                 .withColumn("reason", F.coalesce(F.col("reason"), F.when(F.col("_short"), F.lit("insufficient_stock"))))
                 .withColumn("accepted", F.col("reason").isNull()).drop("_short"))
    decisions = materialize(decisions, "placement_decisions")

    accepted = decisions.filter("accepted").select("rid", "request_id", "seq", "customer_id")
    if store is None:
        max_o, max_i = max_ids(*t.id_tables())
    else:
        n_lines = lines.join(accepted.select("rid"), "rid", "left_semi").count()
        max_o, max_i, _ = store.reserve(accepted.count(), n_lines, base=t.id_tables())
    numbered = dense_ids(accepted, ["seq", "rid"], "order_id", start=max_o + 1)
    acc_lines = lines.join(numbered.select("rid", "order_id"), "rid")
    items = dense_ids(acc_lines, ["order_id", "pos"], "id", start=max_i + 1)
    items = conform(items.select("id", "order_id", "product_id", "quantity", "unit_price",
                                 subtotal_of(F.col("quantity"), F.col("unit_price")).alias("subtotal")),
                    "order_items")
    totals = items.groupBy("order_id").agg(F.sum("subtotal").alias("_total"))
    when = F.current_timestamp() if placed_at is None else ts_lit(placed_at)
    orders = conform(numbered.join(totals, "order_id", "left").select(
        F.col("order_id").alias("id"), "customer_id", F.lit("pending").alias("status"),
        F.coalesce(F.col("_total"), F.lit(0)).cast("decimal(12,2)").alias("total_amount"),
        F.lit("USD").alias("currency"), when.alias("placed_at")), "orders")
    used = items.groupBy("product_id").agg(F.sum("quantity").alias("_used"))
    products = conform(t.products.join(used.withColumnRenamed("product_id", "id"), "id", "left")
                       .withColumn("stock", (F.col("stock") - F.coalesce(F.col("_used"), F.lit(0))).cast("int")),
                       "products")
    rejects = decisions.filter(~F.col("accepted")).select("request_id", "seq", "customer_id", "reason")
    changes = used.select("product_id", (-F.col("_used")).cast("long").alias("change"))
    return PlacementResult(orders, items, products, rejects, decisions, rounds, changes)


def publish_placement(result: PlacementResult, t: Tables, store: RunStore, run_id: str) -> None:
    """Publish the new orders, their items and the stock changes as one run:
    all become visible together, and never twice for one run id.  ``t``: the tables that were placed against;
    if another run changed stock since ``store.current`` gave them, ``RunConflictError`` is raised:
    place the requests again."""
    store.begin(run_id, t.version)
    frames = {"orders": result.orders, "order_items": result.order_items, "stock_changes": result.stock_changes}
    store.publish(run_id, frames | sales_deltas(result.orders, result.order_items, t.products))


def requests_from_orders(t: Tables, raw_orders: DataFrame, raw_lines: DataFrame) -> DataFrame:
    """Placement requests derived from the supplied tables: every order
    becomes a request of its lines (product, quantity), seq and id = order
    key.  Grouping is per order (one request's own item list)."""
    pend = raw_orders.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("customer_id"))
    items = (raw_lines.join(pend.select(F.col("request_id").alias("l_orderkey")), "l_orderkey", "left_semi")
             .groupBy(F.col("l_orderkey").alias("request_id"))
             .agg(F.to_json(F.sort_array(F.collect_list(F.struct(
                 F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("product_id"),
                 F.col("l_quantity").cast("int").alias("quantity"))))
                 .cast("array<struct<ln:int,product_id:long,quantity:int>>")).alias("_j")))
    items = items.select("request_id", F.regexp_replace("_j", r'"ln":\d+,', "").alias("items_json"))
    return pend.join(items, "request_id", "left")
