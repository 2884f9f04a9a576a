"""Feed load job: sample feed, defects, row numbers, idempotency, audit."""

import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from seed import SAMPLE_FEED
from tillpoint.plans import feed_load as L
from tillpoint.sources.feed import read_order_feed
from tillpoint.sources.store import RunCommittedError, RunStore

HEADER = "order_id,customer_email,product_sku,quantity,unit_price,order_date,status\n"


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_sample_feed_loads_and_reruns(spark, seed, scratch):
    csv = write(os.path.join(scratch, "sample.csv"), SAMPLE_FEED)
    store = RunStore(spark, os.path.join(scratch, "store"))
    r1 = L.load_feed(seed, csv, store)
    assert (r1.records_read, r1.records_loaded, r1.records_failed, r1.records_skipped) == (10, 10, 0, 0)
    assert r1.status == "completed" and r1.outcome == "ok" and r1.error_message is None
    orders = store.table("orders")
    assert orders.count() == 10
    assert sum(r.total_amount for r in orders.collect()) == D("686.89")
    assert sorted(r.id for r in orders.collect()) == list(range(21, 31))
    items = store.table("order_items").collect()
    assert sorted(r.id for r in items) == list(range(31, 41))
    assert all(r.subtotal == r.quantity * r.unit_price for r in items)
    r2 = L.load_feed(seed, csv, store)
    assert (r2.records_read, r2.records_loaded, r2.records_failed, r2.records_skipped) == (10, 0, 0, 10)
    assert store.table("orders").count() == 10
    log = store.table("etl_run_log").orderBy("id").collect()
    assert [(r.id, r.records_loaded, r.status) for r in log] == [(1, 10, "completed"), (2, 0, "completed")]
    assert r1.success_pct == 100.0 and r2.success_pct == 0.0


DEFECTS = [
    ("  ,ana.silva@email.com,ELEC-001,1,1.00,2024-03-01,delivered", "missing_order_id", "[Row 2] Missing order_id"),
    ("E2,,ELEC-001,1,1.00,2024-03-01,delivered", "missing_customer_email", "[Row 3] Missing customer_email"),
    ("E3,ana.silva@email.com, ,1,1.00,2024-03-01,delivered", "missing_product_sku", "[Row 4] Missing product_sku"),
    ("E4,ana.silva@email.com,ELEC-001,x,1.00,2024-03-01,delivered", "bad_number", None),
    ("E5,ana.silva@email.com,ELEC-001,0,1.00,2024-03-01,delivered", "bad_quantity",
     "[Row 6] Quantity must be > 0 (got 0)"),
    ("E6,ana.silva@email.com,ELEC-001,-5,1.00,2024-03-01,delivered", "bad_quantity",
     "[Row 7] Quantity must be > 0 (got -5)"),
    ("E7,ana.silva@email.com,ELEC-001,1,-0.01,2024-03-01,delivered", "negative_price",
     "[Row 8] Unit price cannot be negative"),
    ("E8,ana.silva@email.com,ELEC-001,1,1.00,not-a-date,delivered", "bad_date",
     "[Row 9] Invalid date format: 'not-a-date'"),
    ("E9,ana.silva@email.com,ELEC-001,1,1.00,2024-02-30,delivered", "bad_date",
     "[Row 10] Invalid date format: '2024-02-30'"),
    ("E10,ana.silva@email.com,ELEC-001,1,1.00,2024-03-01,lost", "bad_status",
     "[Row 11] Invalid status 'lost'. Allowed: pending, confirmed, shipped, delivered, cancelled, refunded"),
    ("E11,nobody@email.com,ELEC-001,1,1.00,2024-03-01,delivered", "unknown_customer",
     "Order E11: Customer 'nobody@email.com' not found"),
    ("E12,ana.silva@email.com,NOPE-1,1,1.00,2024-03-01,delivered", "unknown_product",
     "Order E12: Product (SKU) 'NOPE-1' not found"),
    ("E13, ANA.SILVA@EMAIL.COM ,elec-001,2,0,2024-03-01, Delivered ", None, None),
    ("E14,ana.silva@email.com,ELEC-002,1,1.50,03/15/2024,pending", None, None),
    ("E13, ANA.SILVA@EMAIL.COM ,elec-001,2,0,2024-03-01, Delivered ", "skip", None),
    ("E13,ana.silva@email.com,ELEC-003,1,5.00,2024-03-02T10:30:00Z,shipped", None, None),
]


def test_defects(spark, seed, scratch):
    csv = write(os.path.join(scratch, "defects.csv"), HEADER + "\n".join(d for d, _, _ in DEFECTS) + "\n")
    res = L.load_feed(seed, csv, RunStore(spark, os.path.join(scratch, "store")), max_errors=5)
    rows = {r.row_num: r for r in res.classified.collect()}
    for i, (_, code, msg) in enumerate(DEFECTS):
        r = rows[i + 2]
        if code == "skip":
            assert r.outcome == "skipped"
        elif code is None:
            assert r.outcome == "loaded", r
        else:
            assert (r.code, r.outcome) == (code, "rejected")
            if msg:
                assert r.message == msg
    assert rows[14].customer_email == "ana.silva@email.com" and rows[14].product_sku == "ELEC-001"
    assert rows[14].status == "delivered"
    assert (res.records_read, res.records_loaded, res.records_failed, res.records_skipped) == (16, 3, 12, 1)
    assert res.outcome == "threshold_exceeded"
    assert len(res.errors) == 10
    assert res.errors[0].startswith("[Row 2]") and all(e.startswith("[Row") for e in res.errors)
    orders = {r.id: r for r in res.orders.collect()}
    assert sorted(orders) == [21, 22, 23]
    assert orders[21].total_amount == D("0.00") and orders[22].placed_at.month == 3


def test_row_numbers_across_splits(spark, seed, scratch):
    lines = [f"X{i},ana.silva@email.com,ELEC-001,1,1.00,2024-03-01,delivered" for i in range(3000)]
    csv = write(os.path.join(scratch, "big.csv"), HEADER + "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        feed = read_order_feed(spark, csv)
        assert feed.rdd.getNumPartitions() > 3
        got = {r.order_id: r.row_num for r in feed.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(got[f"X{i}"] == i + 2 for i in range(3000))


def test_missing_file(spark, seed, scratch):
    with pytest.raises(FileNotFoundError):
        L.load_feed(seed, os.path.join(scratch, "absent.csv"))


def test_dry_run_and_fail_fast(spark, seed, scratch):
    csv = write(os.path.join(scratch, "mixed.csv"), SAMPLE_FEED + "E99,,ELEC-001,1,1.00,2024-03-01,delivered\n")
    store = RunStore(spark, os.path.join(scratch, "store"))
    dry = L.load_feed(seed, csv, store, dry_run=True)
    assert dry.records_loaded == 10 and dry.orders.count() == 10
    assert store.committed_runs() == [] and store.table("orders").count() == 0
    ff = L.load_feed(seed, csv, store, fail_fast=True)
    assert ff.records_loaded == 0 and store.table("orders").count() == 0
    assert store.table("etl_run_log").count() == 1


def test_failed_publish_leaves_target_untouched(spark, seed, scratch):
    csv = write(os.path.join(scratch, "sample.csv"), SAMPLE_FEED)
    store = RunStore(spark, os.path.join(scratch, "store"))

    class Boom(RunStore):
        calls = 0

        def publish(self, run_id, frames, counts=None):
            if "-failed" not in run_id:
                for name, df in frames.items():      # write part of the run, then die
                    df.write.parquet(f"{self.root}/{name}/run_id={run_id}/attempt=dead")
                    raise RuntimeError("executor lost")
            return super().publish(run_id, frames, counts)

    boom = Boom(spark, store.root)
    with pytest.raises(RuntimeError):
        L.load_feed(seed, csv, boom)
    assert store.table("orders").count() == 0
    log = store.table("etl_run_log").collect()
    assert len(log) == 1 and log[0].status == "failed" and "executor lost" in log[0].error_message
    assert log[0].records_loaded == 0
    ok = L.load_feed(seed, csv, store)
    assert ok.records_loaded == 10 and store.table("orders").count() == 10


def test_totals_property(spark, scratch):
    """loaded + failed + skipped = read, on the derived feed."""
    from tillpoint.sources.testdata import bind, derive_feed
    t = bind(spark, "/root/testdata/sf0.001")
    res = L.load_feed(t, derive_feed(spark, "/root/testdata/sf0.001", t), dry_run=True)
    assert res.records_loaded + res.records_failed + res.records_skipped == res.records_read
    assert res.records_failed > 0 and res.records_skipped > 0


def test_command_line(spark, scratch, capsys):
    from tillpoint.cli import main
    csv = write(os.path.join(scratch, "cli.csv"),
                HEADER + "EXT-1,customer.000000001@example.com,SKU-000001,2,10.00,1998-01-02,delivered\n"
                         "EXT-2,nobody@example.com,SKU-000001,1,1.00,1998-01-02,delivered\n")
    code = main(["load-feed", csv, "--testdata", "/root/testdata/sf0.001", "--store", os.path.join(scratch, "st")])
    out = capsys.readouterr().out
    assert code == 1 and "Records loaded  : 1" in out and "Customer 'nobody@example.com' not found" in out
    code = main(["load-feed", csv, "--testdata", "/root/testdata/sf0.001", "--dry-run", "--max-errors", "0"])
    out = capsys.readouterr().out
    assert code == 2 and "Dry run" in out and "Records skipped : 0" in out


def test_folder_with_several_files(spark, seed, scratch):
    folder = os.path.join(scratch, "drop")
    os.makedirs(folder)
    write(os.path.join(folder, "a.csv"), HEADER + "\n".join(
        f"X{i},ana.silva@email.com,ELEC-00{i},1,1.00,2024-03-01,delivered" for i in (1, 2, 3)) + "\n")
    write(os.path.join(folder, "b.csv"), HEADER + "\n".join(
        [f"X1,ana.silva@email.com,ELEC-001,1,1.00,2024-03-01,delivered",
         "Y2,ana.silva@email.com,ELEC-002,1,1.00,2024-03-01,delivered",
         "Y3,,ELEC-002,1,1.00,2024-03-01,delivered"]) + "\n")
    res = L.load_feed(seed, folder)
    assert (res.records_read, res.records_loaded, res.records_skipped, res.records_failed) == (6, 4, 1, 1)
    rows = {(r.source_file.split("/")[-1], r.row_num): r.outcome for r in res.classified.collect()}
    assert rows[("a.csv", 2)] == "loaded" and rows[("b.csv", 2)] == "skipped" and rows[("b.csv", 4)] == "rejected"
    assert sorted(r.id for r in res.orders.collect()) == [21, 22, 23, 24]
    assert res.errors == ["[Row 4] Missing customer_email"]


def test_ids_continue_across_runs(spark, seed, scratch):
    store = RunStore(spark, os.path.join(scratch, "store"))
    a = write(os.path.join(scratch, "a.csv"), SAMPLE_FEED)
    b = write(os.path.join(scratch, "b.csv"), HEADER + "N1,ana.silva@email.com,ELEC-005,1,79.99,2024-03-20,pending\n"
                                                       "N2,ana.silva@email.com,ELEC-004,1,329.00,2024-03-21,pending\n")
    L.load_feed(seed, a, store)
    L.load_feed(seed, b, store)
    assert sorted(r.id for r in store.table("orders").collect()) == list(range(21, 33))
    assert sorted(r.id for r in store.table("order_items").collect()) == list(range(31, 43))
    assert store.id_marks(seed.orders, seed.order_items) == (32, 42)


def test_replay_of_a_committed_run_changes_nothing(spark, seed, scratch):
    csv = write(os.path.join(scratch, "a.csv"), SAMPLE_FEED)
    store = RunStore(spark, os.path.join(scratch, "store"))
    first = L.load_feed(seed, csv, store, run_id="007")
    orders = sorted(map(tuple, store.table("orders").collect()))
    for _ in range(2):
        again = L.load_feed(seed, csv, store, run_id="007")
        assert again.replayed and (again.records_loaded, again.records_read) == (first.records_loaded, first.records_read)
        assert again.orders.count() == 10 and again.status == "completed" and again.outcome == "ok"
    assert sorted(map(tuple, store.table("orders").collect())) == orders and len(orders) == 10
    assert store.table("load_ledger").count() == 10 and store.table("etl_run_log").count() == 1
    other = L.load_feed(seed, csv, store, run_id="8")
    assert (other.records_loaded, other.records_skipped) == (0, 10) and store.table("orders").count() == 10


def test_unreadable_marker_is_an_error(spark, seed, scratch):
    csv = write(os.path.join(scratch, "a.csv"), SAMPLE_FEED)
    store = RunStore(spark, os.path.join(scratch, "store"))
    L.load_feed(seed, csv, store, run_id="r1")
    log = os.path.join(scratch, "store", "_log")
    write(os.path.join(log, sorted(os.listdir(log))[-1]), "{not json")
    with pytest.raises(Exception):
        store.table("orders").count()
    with pytest.raises(Exception):
        L.load_feed(seed, csv, store, run_id="r2")


class Overtaken(RunStore):
    """A store in which another writer publishes first."""

    def __init__(self, spark, root, other):
        super().__init__(spark, root)
        self.other = other

    def publish(self, run_id, frames, counts=None):
        other, self.other = self.other, None
        if other:
            other(RunStore(self.spark, self.root))
        return super().publish(run_id, frames, counts)


def test_two_writers_load_a_feed_once(spark, seed, scratch):
    csv = write(os.path.join(scratch, "a.csv"), SAMPLE_FEED)
    more = write(os.path.join(scratch, "b.csv"), SAMPLE_FEED + "N1,ana.silva@email.com,ELEC-005,1,79.99,2024-03-20,pending\n")
    store = Overtaken(spark, os.path.join(scratch, "store"), lambda s: L.load_feed(seed, csv, s, run_id="b"))
    late = L.load_feed(seed, more, store, run_id="a")
    assert (late.records_loaded, late.records_skipped) == (1, 10)
    orders, items, ledger = (store.table(n).collect() for n in ("orders", "order_items", "load_ledger"))
    assert len(orders) == len(items) == len(ledger) == 11
    assert len({(r.external_order_id, r.product_sku) for r in ledger}) == 11
    for run in "ab":
        for name in ("orders", "order_items"):
            ids = sorted(r.id for r in store.table(name, run).collect())
            assert ids == list(range(ids[0], ids[0] + len(ids)))
    assert len({r.id for r in orders}) == len({r.id for r in items}) == 11
    assert sorted((r.id, r.records_loaded) for r in store.table("etl_run_log").collect()) == [(1, 1), (2, 10)]


def test_writers_of_different_rows_do_not_disturb_each_other(spark, seed, scratch):
    csv = write(os.path.join(scratch, "a.csv"), SAMPLE_FEED)
    other = write(os.path.join(scratch, "b.csv"), HEADER + "N1,ana.silva@email.com,ELEC-005,1,79.99,2024-03-20,pending\n")
    store = Overtaken(spark, os.path.join(scratch, "store"), lambda s: L.load_feed(seed, other, s, run_id="b"))
    assert L.load_feed(seed, csv, store, run_id="a").records_loaded == 10
    ids = [r.id for r in store.table("orders").collect()]
    assert sorted(ids) == list(range(21, 32)) and sorted(store.committed_runs()) == ["a", "b"]


def test_one_run_id_is_committed_by_one_writer(spark, seed, scratch):
    csv = write(os.path.join(scratch, "a.csv"), SAMPLE_FEED)
    store = Overtaken(spark, os.path.join(scratch, "store"), lambda s: L.load_feed(seed, csv, s, run_id="a"))
    with pytest.raises(RunCommittedError):
        L.load_feed(seed, csv, store, run_id="a")
    assert store.table("orders").count() == 10 and store.committed_runs() == ["a"]


def test_a_commit_that_dies_leaves_the_run_id_loadable(spark, seed, scratch, monkeypatch):
    csv = write(os.path.join(scratch, "a.csv"), SAMPLE_FEED)
    store = RunStore(spark, os.path.join(scratch, "store"))
    real, died = os.link, []

    def link(source, target):
        with open(source) as f:
            if '"commit"' in f.read() and not died:
                died.append(target)
                os.rename(source, source + ".left")        # the draft stays, as after a crash
                raise OSError("killed")
        real(source, target)

    monkeypatch.setattr(os, "link", link)
    with pytest.raises(OSError):
        L.load_feed(seed, csv, store, run_id="x")
    assert died and store.table("orders").count() == 0 and store.marker("x") is None
    assert L.load_feed(seed, csv, store, run_id="x").records_loaded == 10
    assert sorted(r.id for r in store.table("orders").collect()) == list(range(31, 41))
    assert [(r.status, r.records_loaded) for r in store.table("etl_run_log").orderBy("id").collect()] == [("failed", 0), ("completed", 10)]


def test_reservations_never_overlap(spark, scratch):
    from concurrent.futures import ThreadPoolExecutor
    root = os.path.join(scratch, "store")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda k: RunStore(spark, root).reserve(k, 2 * k), range(1, 9)))
    spans = sorted((o, o + k) for k, (o, _, _) in zip(range(1, 9), got))
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert RunStore(spark, root).version() == 8


def test_rows_whose_total_does_not_fit_are_rejected(spark, seed, scratch):
    rows = [f"T{i},ana.silva@email.com,ELEC-005,{q},{p},2024-03-20,pending" for i, (q, p) in enumerate(
        [(2000000, "99999999"), (100, "99999999.99"), (100, "100000000"), (2, "4999999999.995"), (2000000000, "4.9999"), (2000000000, "5.0"), (1, "1.00")])]
    res = L.load_feed(seed, write(os.path.join(scratch, "t.csv"), HEADER + "\n".join(rows) + "\n"), RunStore(spark, os.path.join(scratch, "store")))
    codes = {r.row_num: r.code for r in res.rejects().collect()}
    assert codes == {2: "bad_number", 4: "bad_number", 5: "bad_number", 6: "bad_number", 7: "bad_number"}
    assert sorted(r.total_amount for r in res.orders.collect()) == [D("1.00"), D("9999999999.00")]
    assert res.errors[0] == "[Row 2] Invalid number: quantity '2000000', unit_price '99999999'"


def test_ids_follow_a_grown_base(spark, seed, scratch):
    store = RunStore(spark, os.path.join(scratch, "store"))
    L.load_feed(seed, write(os.path.join(scratch, "a.csv"), SAMPLE_FEED), store)
    grown = seed.with_(orders=seed.orders.unionByName(seed.orders.limit(1).withColumn("id", F.lit(500).cast("long"))))
    b = write(os.path.join(scratch, "b.csv"), HEADER + "N1,ana.silva@email.com,ELEC-005,1,79.99,2024-03-20,pending\n")
    assert [r.id for r in L.load_feed(grown, b, store).orders.collect()] == [501]


def test_every_run_leaves_an_audit_row(spark, seed, scratch):
    store = RunStore(spark, os.path.join(scratch, "store"))
    with pytest.raises(FileNotFoundError):
        L.load_feed(seed, os.path.join(scratch, "absent.csv"), store)
    bad = write(os.path.join(scratch, "bad.csv"), "order_id,status\n1,pending\n")
    with pytest.raises(ValueError):
        L.load_feed(seed, bad, store)
    empty = write(os.path.join(scratch, "empty.csv"), HEADER)
    assert L.load_feed(seed, empty, store).status == "completed"
    log = sorted((r.id, r.status, r.records_loaded) for r in store.table("etl_run_log").collect())
    assert log == [(1, "failed", 0), (2, "failed", 0), (3, "completed", 0)]


def test_files_with_other_column_orders(spark, seed, scratch):
    folder = os.path.join(scratch, "mixed")
    os.makedirs(folder)
    write(os.path.join(folder, "a.csv"), HEADER + "X1,ana.silva@email.com,ELEC-005,3,4.00,2024-03-20,pending\n")
    write(os.path.join(folder, "b.csv"), "status,order_id,customer_email,product_sku,unit_price,quantity,order_date\n"
                                         "pending,X2,ana.silva@email.com,ELEC-004,4.00,3,2024-03-20\n")
    res = L.load_feed(seed, folder)
    assert sorted((r.quantity, float(r.unit_price)) for r in res.items.collect()) == [(3, 4.0), (3, 4.0)]
    assert sorted((r.row_num, r.feed_seq) for r in res.classified.collect()) == [(2, 1), (2, 2)]


def test_line_breaks_in_quotes(spark, seed, scratch):
    csv = write(os.path.join(scratch, "m.csv"), HEADER + '"X\n1",ana.silva@email.com,ELEC-005,1,4.00,2024-03-20,pending\n'
                + "X2,ana.silva@email.com,ELEC-004,0,4.00,2024-03-20,pending\n")
    res = L.load_feed(seed, csv, multiline=True)
    assert res.errors == ["[Row 3] Quantity must be > 0 (got 0)"]
    assert [r.external_order_id for r in res.ledger.collect()] == ["X\n1"]


def test_prices_that_do_not_fit_are_rejected(spark, seed, scratch):
    rows = [f"P{i},ana.silva@email.com,ELEC-005,1,{p},2024-03-20,pending" for i, p in enumerate(
        ["1.23456", "99999999.99", "100000000", "99999999.995", "1e3", "0.0001"])]
    res = L.load_feed(seed, write(os.path.join(scratch, "p.csv"), HEADER + "\n".join(rows) + "\n"))
    assert {r.row_num: r.code for r in res.rejects().collect()} == {2: "bad_number", 4: "bad_number", 5: "bad_number"}
    assert res.orders.count() == 3


@pytest.mark.parametrize("seed_,end", [(1, "\n"), (2, "\r\n"), (3, "\n"), (4, "\n")])
def test_quoted_line_breaks_over_several_tasks(spark, scratch, seed_, end):
    """Equal to the one-task parse, file by file, on random quoted files."""
    import random
    rng = random.Random(seed_)
    folder = os.path.join(scratch, "q")
    os.makedirs(folder)
    columns = HEADER.strip().split(",")

    def field():
        x = rng.choice(["a", "b c", "", "x,y", 'say ""hi""', "two" + end + "lines", end, "three" + end + end + "gaps", 'q""' + end + '""q', "long " * 40, "é世"])
        return f'"{x}"' if rng.random() < 0.4 or any(c in x for c in ',"\r\n') else x

    for k, n in enumerate((400, 0, 37, 150)):
        order = rng.sample(columns, len(columns))
        rows = [",".join(order)] + [",".join(field() for _ in order) for _ in range(n)]
        if k == 2:                                     # blank lines between records, one long quoted field, no last line end
            rows += ["", ",".join(['"' + ("part" + end) * 900 + '"'] + ["z"] * 6), ""]
        with open(os.path.join(folder, f"{k}.csv"), "w", newline="", encoding="utf-8") as f:
            f.write(end.join(rows) + (end if k != 2 else ""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        feed = read_order_feed(spark, folder, multiline=True)
        assert spark.read.text(folder).rdd.getNumPartitions() > 10
        got = {}
        for r in feed.collect():
            got.setdefault(r.source_file.split("/")[-1], []).append(r)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    seen = 0
    for k in range(4):
        one = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(os.path.join(folder, f"{k}.csv")).select(*columns).collect()
        mine = sorted(got.get(f"{k}.csv", []), key=lambda r: r.row_num)
        assert [r.row_num for r in mine] == list(range(2, len(one) + 2))
        assert [r.feed_seq for r in mine] == list(range(seen + 1, seen + len(one) + 1))
        assert [tuple(r[c] for c in columns) for r in mine] == [tuple(r) for r in one]
        seen += len(one)


def test_headers_come_from_the_first_bytes(spark, seed, scratch):
    import gzip
    folder = os.path.join(scratch, "gz")
    os.makedirs(folder)
    with gzip.open(os.path.join(folder, "a.csv.gz"), "wt") as f:
        f.write(HEADER + "X1,ana.silva@email.com,ELEC-005,3,4.00,2024-03-20,pending\n")
    write(os.path.join(folder, "b.csv"), "\ufeffstatus,order_id,customer_email,product_sku,unit_price,quantity,order_date\r\n"
                                         "pending,X2,ana.silva@email.com,ELEC-004,4.00,3,2024-03-20\r\n")
    for multiline in (False, True):
        got = L.load_feed(seed, folder, multiline=multiline)
        assert sorted((r.quantity, float(r.unit_price)) for r in got.items.collect()) == [(3, 4.0), (3, 4.0)]


def test_a_load_reads_only_ledger_parts_that_may_hold_its_keys(spark, scratch, monkeypatch):
    from tillpoint.sources import store as S
    monkeypatch.setattr(S, "PART_KEYS", 2_000)
    store = RunStore(spark, os.path.join(scratch, "store"))

    def ledger(run, n):
        return spark.range(n).select(F.format_string(f"{run}-%d", "id").alias("external_order_id"), F.lit("SKU").alias("product_sku"),
                                     F.col("id").alias("row_num"), F.col("id").alias("order_id"))
    for run, n in (("a", 20_000), ("b", 5_000), ("c", 700), ("empty", 0)):
        store.publish(run, {"load_ledger": ledger(run, n)})
    assert store.table("load_ledger").count() == 25_700
    assert sorted(store.table("load_ledger", "c").columns) == ["external_order_id", "order_id", "product_sku", "row_num"]
    # Whole runs again: all their parts, and no part of another run.
    assert {r for r, _, _ in store.ledger_parts(ledger("b", 5_000))} == {"b"}
    assert len(store.ledger_parts(ledger("a", 20_000))) == 16
    assert store.ledger_for(ledger("a", 20_000)).join(ledger("a", 20_000), S.LEDGER_KEY, "left_semi").count() == 20_000
    # One key: the part that holds it.
    one = store.ledger_for(ledger("a", 1))
    assert len(one.inputFiles()) == 1 and one.filter("external_order_id = 'a-0'").count() == 1 and one.count() < 3_000
    # New keys: 27,000 tests against filters that pass about one in a million.
    assert len(store.ledger_parts(ledger("new", 9_000))) <= 1
    assert store.ledger_for(ledger("new", 0)).count() == 0


def test_uncommitted_attempts_are_not_in_the_ledger(spark, scratch, monkeypatch):
    store = RunStore(spark, os.path.join(scratch, "store"))
    keys = spark.createDataFrame([("X1", "SKU", 1, 1)], "external_order_id string, product_sku string, row_num long, order_id long")
    with monkeypatch.context() as m:
        m.setattr(RunStore, "_append", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.publish("dead", {"load_ledger": keys})
    assert store.ledger_parts(keys) == [] and store.ledger_for(keys).count() == 0
    store.publish("dead", {"load_ledger": keys})
    assert len(store.ledger_parts(keys)) == 1 and store.ledger_for(keys).count() == 1
