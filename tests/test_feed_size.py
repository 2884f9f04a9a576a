"""What a feed load reads again, keeps on disk and computes again as its input grows."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tillpoint.operators.ranking import bitmap_place, bitmap_slot, dense_ids_by_int_key, has_bit, key_bitmaps
from tillpoint.plans import feed_load as L
from tillpoint.schema import FEED_COLUMNS
from tillpoint.session import materialize, scratch_mark
from tillpoint.sources import feed as FE
from tillpoint.sources import testdata as TD
from tillpoint.sources.store import RunStore

SF = "/root/testdata/sf0.001"
COLUMNS = list(FEED_COLUMNS)


def _feed_folder(root, columns_of):
    """Files of three rows each, with the given columns."""
    folder = os.path.join(root, "a folder with 100% of it")
    os.makedirs(folder)
    for n, columns in enumerate(columns_of):
        with open(os.path.join(folder, f"{n}.csv"), "w") as f:
            f.write("\n".join([",".join(columns), *[",".join(f"{c}-{n}-{k}" for c in columns) for k in range(3)]]) + "\n")
    return folder


@pytest.mark.parametrize("extra", [[], ["note"]])
def test_files_of_several_headers_are_one_scan(spark, tmp_path, extra):
    """A folder is listed and read once, whatever its headers; no row takes another file's order."""
    folder = _feed_folder(str(tmp_path), [COLUMNS, COLUMNS[::-1], extra + COLUMNS[3:] + COLUMNS[:3], COLUMNS])
    scanned = FE.scan_order_feed(spark, folder)
    assert scanned._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = sorted(tuple(r[c] for c in FEED_COLUMNS) for r in scanned.collect())
    assert got == sorted(tuple(f"{c}-{n}-{k}" for c in FEED_COLUMNS) for n in range(4) for k in range(3))
    short, files = FE.number_files(scanned)
    numbered = FE.number_rows(short, files)
    assert sorted(map(str, numbered.select("order_id", "source_file", "row_num", "feed_seq").collect())) == \
        sorted(map(str, FE.number_rows(scanned).select("order_id", "source_file", "row_num", "feed_seq").collect()))


def test_headers_look_up_their_file_system_once(spark, tmp_path, monkeypatch):
    folder = _feed_folder(str(tmp_path), [COLUMNS] * 6)
    files = spark.read.text(folder).inputFiles()
    headers = FE._Headers(spark)
    calls = []
    opened = headers._open
    monkeypatch.setattr(headers, "_open", lambda file: calls.append(file) or opened(file))
    assert {headers.read(f) for f in files} == {(",".join(FEED_COLUMNS), False)}
    assert len(calls) == 6 and len(headers.systems) == 1 and len(headers.codec_of) == 1


def test_deltas_come_from_the_written_rows(spark, tmp_path, monkeypatch):
    """The feed's rows are not numbered again for each report."""
    store, seen, deltas = RunStore(spark, str(tmp_path / "store")), [], L.sales_deltas
    monkeypatch.setattr(L, "sales_deltas", lambda o, i, p: seen.extend([*o.inputFiles(), *i.inputFiles()]) or deltas(o, i, p))
    t = TD.bind(spark, SF)
    res = L.load_feed(t, TD.derive_feed(spark, SF), store, run_id="a")
    assert seen and all("/store/orders/run_id=a/" in f or "/store/order_items/run_id=a/" in f for f in seen)
    for name, df in deltas(res.orders, res.items, t.products).items():
        assert sorted(map(str, store.table(name).select(*df.columns).collect())) == sorted(map(str, df.collect()))


def test_ids_from_known_bitmaps(spark):
    rows = random.Random(3).sample(range(-40_000, 100_000), 3_000)
    df = spark.createDataFrame([(k,) for k in rows], "k long")
    bits = key_bitmaps(df, "k", min(rows), max(rows))
    got = [(r.k, r.i) for r in dense_ids_by_int_key(df, "k", "i", start=5, known=(bits, len(rows))).collect()]
    assert sorted(got) == list(zip(sorted(rows), range(5, 5 + len(rows))))
    asked = spark.createDataFrame([(k,) for k in range(-42_000, 101_000)], "k long").withColumn("_slot", bitmap_slot(F.col("k")))
    found = asked.join(bits, "_slot").filter(has_bit(F.col("_words"), bitmap_place(F.col("k"))))
    assert sorted(r.k for r in found.select("k").collect()) == sorted(rows)
    # Repeated keys are not what the bitmaps say.
    twice = df.unionByName(df.limit(10))
    got = [r.i for r in dense_ids_by_int_key(twice, "k", "i", start=1, known=(bits, len(rows) + 10)).collect()]
    assert sorted(got) == list(range(1, len(rows) + 11))


def test_large_lookups_are_hashed(spark):
    """Lookups above the broadcast limit are hashed in parts; the rows that meet them are not sorted."""
    t = TD.bind(spark, SF)
    tagged = L.tag_rows(TD.derive_feed(spark, SF))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(str, L.resolve_keys(tagged, t).collect()))
    assert "ShuffledHashJoin" not in plan(L.resolve_keys(tagged, t))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1024")
    try:
        hashed = L.resolve_keys(tagged, t)
        assert plan(hashed).count("ShuffledHashJoin [_") == 2
        assert sorted(map(str, hashed.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_written_tables_leave_no_shuffle_files(spark):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = files()
    df = materialize(spark.range(10_000).repartition(7).groupBy((F.col("id") % 999).alias("k")).count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and df.count() == 999
    # Outside of it the session keeps what it had.
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_summary_keeps_one_load_on_disk(spark):
    from tillpoint.checks import gate
    mark = scratch_mark()
    rows = gate.QUERIES["feed_summary"](spark, SF).collect()
    assert [r.outcome for r in rows] == ["threshold_exceeded", "errors"]
    assert scratch_mark() - mark == 2                  # the numbered items and the feed

