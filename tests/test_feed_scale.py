"""What the feed jobs write and move, and the paths behind it."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from tillpoint.operators import ranking
from tillpoint.operators.ranking import dense_ids, dense_ids_by_int_key
from tillpoint.plans import feed_load as L
from tillpoint.sources import testdata as TD
from tillpoint.sources.feed import name_files, number_files, scan_order_feed, write_feed_files
from tillpoint.sources.store import RunStore

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def written(monkeypatch):
    """Names and columns of the intermediate tables that get written."""
    names = []
    for module in (L, ranking):
        keep = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name="stage", *how, keep=keep: names.append((name, df.columns)) or keep(df, name, *how))
    return names


def test_feed_rows_are_written_once(spark, written):
    t = TD.bind(spark, SF)
    feed = TD.derive_feed(spark, SF)
    assert [("customer_email" in columns, name) for name, columns in written] == [(False, "ranked")]
    written.clear()
    res = L.load_feed(t, feed, dry_run=True)
    assert res.orders.count() == res.records_loaded > 0
    assert [name for name, columns in written if "external_order_id" in columns] == ["feed_resolved"]
    assert {name for name, _ in written} == {"feed_resolved", "bitmaps"}
    for df in (res.classified, res.orders, res.items, res.ledger):
        assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_lookup_rows_are_narrow(spark):
    """A valid row carries its email and its sku once through the joins."""
    t = TD.bind(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = L.resolve_keys(L.tag_rows(TD.derive_feed(spark, SF)), t)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    rows = lines[next(i for i, line in enumerate(lines) if "Join LeftOuter, (_email" in line) + 1]
    assert "AS subtotal" not in rows
    assert rows.count("CASE WHEN isnotnull(code") == 2


def test_feed_rows_of_repeated_lookup_keys(spark):
    """Two orders of one id make two rows of every item, numbered apart."""
    t = TD.bind(spark, SF)
    once = TD.derive_feed(spark, SF, t).count()
    twice = t.orders.filter("id % 2 = 0")
    more = t.order_items.filter("order_id % 2 = 0")
    more = more.count() + more.filter(F.col("id") % TD.DEFECT_MOD == TD.DUPLICATE_RESIDUE).count()
    feed = TD.derive_feed(spark, SF, t.with_(orders=t.orders.unionByName(twice)))
    numbers = sorted(r[0] for r in feed.select("row_num").collect())
    assert numbers == list(range(2, once + more + 2))
    assert sorted(map(str, TD.derive_feed(spark, SF).collect())) == sorted(map(str, TD.derive_feed(spark, SF, t).collect()))


@pytest.mark.parametrize("keys", [
    [5, 6, 7, 8, 40_000, 32_767, 32_768, 32_769, 65_535, 65_536], [-40_000, -32_769, -32_768, -1, 0, 1, 7], [1, 10 ** 15, 10 ** 12, -10 ** 15],
    [3, 3, 3, 4], [None, 1, 2], []])
def test_ids_by_int_key(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    got = [(r.k, r.i) for r in dense_ids_by_int_key(df, "k", "i", start=10).collect()]
    order = lambda k: (k is not None, k or 0)
    assert sorted(got, key=lambda r: (r[1], order(r[0]))) == list(zip(sorted(keys, key=order), range(10, 10 + len(keys))))


@pytest.mark.parametrize("ordered", [True, False])
def test_ids_of_ranged_rows(spark, ordered):
    """Partitions that overlap although they were said to follow each other are ranged."""
    rows = [(random.Random(k).randrange(1000) if not ordered else k, k) for k in range(500)] + [(None, 500)] * ordered
    df = spark.createDataFrame(rows, "k long, v long")
    df = df.repartitionByRange(5, "k") if ordered else df.repartition(5, "v")
    got = [(r.k, r.v) for r in dense_ids(df, ["k", "v"], "i", start=1, ranged=True).orderBy("i").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_far_row_numbers(spark, seed):
    """Row numbers that no bitmap can span: the same outcomes as close ones."""
    rows = [("A", "SKU-1"), ("A", "SKU-1"), ("B", "SKU-1"), ("", "SKU-1"), ("B", "SKU-2"), ("A", "SKU-1")]
    frame = lambda step: spark.createDataFrame([(o, s, None, n * step) for n, (o, s) in enumerate(rows)],
                                               "external_order_id string, product_sku string, code string, row_num long")
    ledger = spark.createDataFrame([("B", "SKU-2")], "external_order_id string, product_sku string")
    near, far = ([r.outcome for r in L.mark_loads(frame(s), ledger).orderBy("feed_seq").collect()] for s in (1, 10 ** 15))
    assert near == far == ["loaded", "skipped", "loaded", "loaded", "skipped", "skipped"]


def test_large_generated_methods_are_not_interpreted(spark):
    from tillpoint.session import HUGE_METHOD, ensure_defaults
    ensure_defaults(spark)
    assert spark.conf.get(HUGE_METHOD) == "8000"


def test_line_breaks_move_no_records(spark, scratch):
    """Records that lie in one split are put together where they are read."""
    from tillpoint.schema import FEED_COLUMNS
    from tillpoint.sources.feed import read_order_feed
    with open(f"{scratch}/a.csv", "w") as f:
        f.write(",".join(FEED_COLUMNS) + "\n" + "".join(f'"E\n\n{i}",c@x,S,1,2,2024-01-01,pending\n' for i in range(50)))
    df = read_order_feed(spark, f"{scratch}/a.csv", multiline=True)
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.row_num, r.order_id) for r in df.collect()) == [(i + 2, f"E\n\n{i}") for i in range(50)]


@pytest.mark.parametrize("seed", range(6))
def test_records_over_batches(seed, monkeypatch):
    """Lines in batches of any size, of several splits: as the whole file in one."""
    import pyarrow as pa

    from tillpoint.sources import feed
    monkeypatch.setattr(feed, "HELD_BYTES", (10, 1 << 20)[seed % 2])
    rng = random.Random(seed)
    lines, before, record, inside = [], {}, 0, False
    want: dict = {}
    for n in range(300):
        key = ("f", n // 60)
        if key not in before:
            before[key] = (int(inside), record)
        text = rng.choice(["", "x", 'a"b', 'a"b"c', '"', "y,z"])
        if not inside and not text:
            lines.append((text, *key, n))
            continue
        record += not inside
        want.setdefault(record, []).append(text)
        inside ^= text.count('"') % 2
        lines.append((text, *key, n))
    batches, at = [], 0
    while at < len(lines):
        step = rng.randrange(1, 50)
        batches.append(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*lines[at:at + step])], names=["value", "source_file", "_block", "_mid"]))
        at += step
    rows = [r for b in feed._number_lines(before, False)(iter(batches)) for r in b.to_pylist()]
    got: dict = {}
    for r in sorted(rows, key=lambda r: r["_mid"]):
        got.setdefault(r["row_num"], []).append(r)
    assert {k: "\n".join(r["value"] for r in v) for k, v in got.items()} == {k: "\n".join(v) for k, v in want.items()}
    assert all(len(v) == 1 for v in got.values() if v[0]["whole"])
    if seed % 2:
        assert sum(not r["whole"] for r in rows) < len(rows) / 2


def test_order_documents_move_narrow_items(spark):
    """Items meet their order once they are gathered; equal orders make one row."""
    from tillpoint.plans import catalog as C
    t = TD.bind(spark, SF)
    odd = t.with_(orders=t.orders.unionByName(t.orders.filter("id % 3 = 0")), products=t.products.unionByName(t.products.filter("id % 5 = 0")))
    df = C.order_detail(odd, order_ids=t.orders.select("id"))
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    gathered = [line for line in lines if "collect_list" in line]
    assert len(gathered) == 1 and "customer_email" not in gathered[0]
    got = {(r.id, i) for r in df.collect() for i in [tuple(sorted(x.id for x in r["items"]))]}
    want: dict = {}
    for r in C.order_detail_lines(odd, order_ids=t.orders.select("id")).select("id", "item_id").collect():
        want.setdefault(r.id, []).append(r.item_id)
    assert got == {(k, tuple(sorted(v))) for k, v in want.items()} and df.count() == len(want)


def test_highest_ids_sort_no_items(spark):
    """The highest item id is counted; other items are asked themselves."""
    from tillpoint.sources.store import max_ids
    t = TD.bind(spark, SF)
    assert "Window" not in t.id_tables()[1]._jdf.queryExecution().optimizedPlan().toString()
    assert max_ids(*t.id_tables()) == max_ids(t.orders, t.order_items)
    less = t.with_(order_items=t.order_items.filter("order_id < 100"))
    assert max_ids(*less.id_tables()) == max_ids(less.orders, less.order_items) != max_ids(*t.id_tables())
    assert t.with_(orders=t.orders.limit(1)).last_item_ids is not None


def test_subtotal_is_not_written(spark, written):
    t = TD.bind(spark, SF)
    res = L.load_feed(t, TD.derive_feed(spark, SF), dry_run=True)
    assert ["subtotal" in columns for name, columns in written if name == "feed_resolved"] == [False]
    assert dict(res.classified.dtypes)["subtotal"] == dict(L.tag_rows(TD.derive_feed(spark, SF)).dtypes)["subtotal"]
    rows = res.classified.filter("code IS NULL")
    assert rows.count() == rows.filter("subtotal = quantity * unit_price").count() > 0


def test_a_file_is_a_number_while_its_rows_move(spark, tmp_path, written):
    folder = str(tmp_path / "feed")
    feed = TD.derive_feed(spark, SF).filter("row_num < 302")
    write_feed_files(feed, folder, 100)
    assert not glob.glob(f"{folder}/**/*.csv", recursive=True) and len(glob.glob(f"{folder}/**/*.csv.gz", recursive=True)) == 3
    scanned = scan_order_feed(spark, folder)
    short, table = number_files(scanned)
    assert short.filter("source_file IS NOT NULL OR _file IS NULL").count() == 0
    assert sorted(map(str, name_files(short, table).select(*scanned.columns).collect())) == sorted(map(str, scanned.collect()))
    # A file outside the list keeps its text.
    short = short.withColumn("_file", F.lit(None).cast("int")).withColumn("source_file", F.lit("elsewhere"))
    assert {r.source_file for r in name_files(short, table).collect()} == {"elsewhere"}
    written.clear()
    res = L.load_feed(TD.bind(spark, SF), folder, dry_run=True)
    assert [name for name, columns in written if "_file" in columns] == ["feed_resolved"]
    want = {(r.row_num, r.order_id or "") for r in feed.select((F.col("row_num") - 2).alias("row_num"), "order_id").collect()}
    at = (F.regexp_extract("source_file", r"chunk=(\d+)", 1).cast("long") * 100 + F.col("row_num") - 2).alias("row_num")
    got = res.classified.select(at, "external_order_id").collect()
    assert {(n, (x or "").strip()) for n, x in got} == {(n, x.strip()) for n, x in want}


def test_ledger_keys_move_once(spark, tmp_path, monkeypatch):
    """Keys are asked about with one shuffle, and their positions stay at home."""
    store = RunStore(spark, str(tmp_path / "store"))
    keys = spark.range(500).select(F.concat(F.lit("X"), (F.col("id") % 250).cast("string")).alias("external_order_id"), F.lit("SKU").alias("product_sku"),
                                   F.col("id").alias("row_num"), F.col("id").alias("order_id"))
    store.publish("a", {"load_ledger": keys.filter("id < 250")})
    files = glob.glob(f"{store.root}/load_ledger/**/*.parquet", recursive=True) + glob.glob(f"{store.root}/ledger_filter/**/*.parquet", recursive=True)
    assert len(files) >= 2 and all(f.endswith(".zstd.parquet") for f in files)
    plans, collect = [], type(keys).collect
    monkeypatch.setattr(type(keys), "collect", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or collect(df))
    assert [part for _, _, part in store.ledger_parts(keys)] == [0]
    probe = plans[-1]
    assert probe.count("RepartitionByExpression") == 1
    assert "Aggregate [blocks" in probe and "Aggregate [external_order_id" not in probe
