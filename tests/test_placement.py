"""Batch order placement versus one-by-one processing."""

import datetime as dt
import json
import random
from decimal import Decimal as D

import pytest

from pyspark.sql import functions as F

from seed import seed_tables
from tillpoint.plans import placement
from tillpoint.plans.placement import place_orders, publish_placement
from tillpoint.sources.store import RunCommittedError, RunConflictError, RunStore

REQ_SCHEMA = "request_id long, seq long, customer_id long, items_json string"


def one_by_one(t, reqs):
    prods = {r.id: [r.unit_price, r.stock, r.is_active] for r in t.products.collect()}
    custs = {r.id for r in t.customers.select("id").collect()}
    accepted = {}
    for rid, seq, cust, items_json in sorted(reqs, key=lambda r: r[1]):
        try:
            items = json.loads(items_json) if items_json is not None else []
            ok = isinstance(items, list)
        except ValueError:
            ok, items = False, []
        need = {}
        for it in items if ok else []:
            pid, q = it.get("product_id"), it.get("quantity")
            p = prods.get(pid)
            if p is None or not p[2] or q is None or q <= 0:
                ok = False
                break
            need[pid] = need.get(pid, 0) + q
        ok = ok and cust in custs and all(q <= prods[p][1] for p, q in need.items())
        if ok:
            for p, q in need.items():
                prods[p][1] -= q
        accepted[rid] = ok
    return accepted, {p: v[1] for p, v in prods.items()}


def check(spark, t, reqs):
    res = place_orders(spark.createDataFrame(reqs, REQ_SCHEMA), t, placed_at=dt.datetime(2024, 5, 1))
    got = {r.request_id: r.accepted for r in res.decisions.collect()}
    want, stock = one_by_one(t, reqs)
    assert got == want
    assert {r.id: r.stock for r in res.products.collect()} == stock
    assert min(stock.values()) >= 0
    return res


def test_fixture_cases(spark, seed):
    reqs = [
        (1, 1, 1, '[{"product_id": 1, "quantity": 2}, {"product_id": 2, "quantity": 1}]'),   # ok
        (2, 2, 1, '[{"product_id": 99, "quantity": 1}]'),                                     # missing product
        (3, 3, 2, '[{"product_id": 4, "quantity": 48}]'),                                     # above stock 47
        (4, 4, 2, '[{"product_id": 4, "quantity": 30}, {"product_id": 4, "quantity": 30}]'),  # summed above
        (5, 5, 2, '[{"product_id": 5, "quantity": 0}]'),                                      # quantity 0
        (6, 6, 2, '[{"product_id": 5}]'),                                                     # missing quantity
        (7, 7, 99, '[{"product_id": 5, "quantity": 1}]'),                                     # unknown customer
        (8, 8, 3, '[]'),                                                                      # empty list
        (9, 9, 3, None),                                                                      # NULL list
        (10, 10, 3, '{not json'),                                                             # malformed
        (11, 11, 4, '[{"product_id": 4, "quantity": 47}]'),                                   # exactly the stock
    ]
    res = check(spark, seed, reqs)
    dec = {r.request_id: r.reason for r in res.decisions.collect()}
    assert dec == {1: None, 2: "unknown_product", 3: "insufficient_stock", 4: "insufficient_stock",
                   5: "bad_quantity", 6: "bad_quantity", 7: "unknown_customer", 8: None, 9: None,
                   10: "bad_json", 11: None}
    orders = {r.customer_id: r for r in res.orders.collect() if r.customer_id == 1}
    assert orders[1].total_amount == D("214.97") and orders[1].status == "pending"
    items = res.order_items.collect()
    assert sorted((i.product_id, i.unit_price) for i in items) == [(1, D("89.99")), (2, D("34.99")),
                                                                    (4, D("329.00"))]
    empty = [r for r in res.orders.collect() if r.customer_id == 3]
    assert len(empty) == 2 and all(r.total_amount == D("0.00") for r in empty)
    assert sorted(r.id for r in res.orders.collect()) == [21, 22, 23, 24]


def test_last_units_go_to_earliest(spark, seed):
    reqs = [(i, 10 - i, 1, '[{"product_id": 4, "quantity": 20}]') for i in range(1, 4)]
    res = check(spark, seed, reqs)
    assert {r.request_id: r.accepted for r in res.decisions.collect()} == {1: False, 2: True, 3: True}


def random_case(spark):
    rng = random.Random(7)
    products = [(p, 1, f"SKU-{p}", f"P{p}", "1.00", rng.randint(0, 12)) for p in range(1, 9)]
    t = seed_tables(spark, products=products)
    reqs = []
    for i in range(300):
        lines = [{"product_id": rng.randint(1, 9), "quantity": rng.randint(1, 5)}
                 for _ in range(rng.randint(1, 3))]
        reqs.append((i, rng.randint(0, 10_000) * 1000 + i, rng.randint(1, 15), json.dumps(lines)))
    return t, reqs


@pytest.mark.parametrize("rounds,lines", [(3, 500_000), (0, 500_000), (1, 0)])
def test_random_against_sequential(spark, monkeypatch, rounds, lines):
    """Rounds then groups, groups alone, rounds alone."""
    monkeypatch.setattr(placement, "ROUNDS", rounds)
    monkeypatch.setattr(placement, "GROUP_LINES", lines)
    t, reqs = random_case(spark)
    assert check(spark, t, reqs).rounds >= 1


def test_long_chain_needs_few_rounds(spark):
    """Each request shares one product with the next: one at a time, but not
    one round at a time."""
    n = 200
    products = [(p, 1, f"SKU-{p}", f"P{p}", "1.00", 1) for p in range(1, n + 2)]
    t = seed_tables(spark, products=products)
    reqs = [(i, i, 1, json.dumps([{"product_id": i, "quantity": 1}, {"product_id": i + 1, "quantity": 1}]))
            for i in range(1, n + 1)]
    assert check(spark, t, reqs).rounds <= placement.ROUNDS + 1


def test_strict_json(spark, seed):
    bad = ['[{"product_id": 1, "quantity": 1}] trailing', '{"product_id": 1, "quantity": 1}', '[1], [2]', "[] ]", "", "null", "7"]
    reqs = [(i, i, 1, text) for i, text in enumerate(bad)] + [(50, 50, 1, ' [ {"product_id": "1", "quantity": "1"} ] '),
                                                              (51, 51, 1, "[5]")]
    res = place_orders(spark.createDataFrame(reqs, REQ_SCHEMA), seed, placed_at=dt.datetime(2024, 5, 1))
    assert {r.request_id: r.reason for r in res.decisions.collect()} == {
        **{i: "bad_json" for i in range(len(bad))}, 50: None, 51: "bad_quantity"}


def test_repeated_request_id_is_placed_once(spark, seed):
    line = '[{"product_id": 1, "quantity": 1}]'
    res = place_orders(spark.createDataFrame([(1, 5, 1, line), (1, 3, 2, line), (2, 4, 1, line), (2, 4, 1, line)], REQ_SCHEMA), seed)
    assert sorted(r.customer_id for r in res.orders.collect()) == [1, 2] and res.order_items.count() == 2
    assert sorted((r.request_id, r.reason) for r in res.rejects.collect()) == [(1, "duplicate_request"), (2, "duplicate_request")]


def test_publication_is_one_unit_and_ids_never_repeat(spark, seed, scratch):
    store = RunStore(spark, f"{scratch}/store")
    for k in range(2):
        now = store.current(seed)
        res = place_orders(spark.createDataFrame([(k, k, 1, '[{"product_id": 4, "quantity": 20}]')], REQ_SCHEMA), now, store=store)
        publish_placement(res, now, store, f"p{k}")
    with pytest.raises(RunCommittedError):
        publish_placement(res, now, store, "p1")
    now = store.current(seed)
    ids = [r.id for r in now.orders.collect()]
    assert len(ids) == len(set(ids)) == 22 and now.order_items.count() == 32
    assert {r.id: r.stock for r in now.products.collect()}[4] == 47 - 40
    late = place_orders(spark.createDataFrame([(9, 9, 1, '[{"product_id": 4, "quantity": 20}]')], REQ_SCHEMA), now, store=store)
    assert [r.reason for r in late.rejects.collect()] == ["insufficient_stock"]


def test_placements_on_old_stock_conflict(spark, seed, scratch):
    store = RunStore(spark, f"{scratch}/store")
    request = lambda k: spark.createDataFrame([(k, k, 1, '[{"product_id": 4, "quantity": 40}]')], REQ_SCHEMA)
    now = store.current(seed)
    first, second = (place_orders(request(k), now, store=store) for k in (1, 2))
    publish_placement(first, now, store, "p1")
    with pytest.raises(RunConflictError):
        publish_placement(second, now, store, "p2")
    now = store.current(seed)
    again = place_orders(request(2), now, store=store)
    assert [r.reason for r in again.rejects.collect()] == ["insufficient_stock"]
    publish_placement(again, now, store, "p2")
    assert store.table("orders").count() == 1 and {r.id: r.stock for r in store.current(seed).products.collect()}[4] == 7


def test_groups_are_played_by_many_tasks(spark):
    """Few bytes, but much work: the groups are dealt over all tasks, and played as one by one."""
    import random

    from tillpoint.plans import placement as P
    rng = random.Random(3)
    stock = {p: rng.randrange(5, 40) for p in range(60)}
    rows = []
    for rid in range(600):
        root = rng.randrange(20)
        for p in rng.sample([root, root + 20, root + 40], rng.randrange(1, 4)):
            rows.append((root, rid, rid // 2, p, rng.randrange(1, 6), stock[p], "A" if rid % 7 == 0 else "U"))
    df = spark.createDataFrame(rows, "root long, rid long, seq long, product_id long, d long, stock long, st string")
    played = P._played(df)
    assert played.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want, left = {}, dict(stock)
    for rid in range(600):
        lines = [(r[3], r[4]) for r in rows if r[1] == rid]
        fits = all(d <= left[p] for p, d in lines)
        if fits or rid % 7 == 0:
            for p, d in lines:
                left[p] -= d
        if rid % 7:
            want[rid] = fits
    assert {r.rid: r.accepted for r in played.collect()} == want


def test_requests_are_read_as_json_twice_at_most(spark, monkeypatch):
    """One pass tells whether the text is one array, one takes it apart; odd texts as before."""
    texts = ["[]", " \t\r\n[ ]", "[] x", "[1],[2]", "[1]],[[2]", "[1],5]x", "[1]]", "[[1]", "{}", "1", '"[]"', "[1,]", "﻿[]", "\x0b[]", "", None]
    rows = spark.createDataFrame([(k, k, 1, t) for k, t in enumerate(texts)],
                                 "request_id long, seq long, customer_id long, items_json string")
    seen = []
    keep = placement.materialize
    monkeypatch.setattr(placement, "materialize", lambda df, name="stage", *how: seen.append(df) or keep(df, name, *how))
    heads, _ = placement._lines(rows)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json_array_length") + plan.count("lengthOfJsonArray") == 1
    text = F.col("items_json")
    two = F.json_array_length(F.concat(F.lit("["), text, F.lit(",0]"))) == 2
    strict = F.coalesce(F.json_array_length(text).isNotNull() & two, F.lit(False))
    want = {r.request_id: not r.s and r.items_json is not None for r in rows.select("*", strict.alias("s")).collect()}
    assert {r.request_id: r.bad_json for r in heads.collect()} == want
