"""Run store: all-or-nothing publication of a job's output tables on plain
Parquet (feed loads: orders, items, ledger, audit row; placements: orders,
items, stock changes), safe for several writers at once.

Layout under ``root``::

    <table>/run_id=<id>/attempt=<token>/...   rows written by one attempt of a run
    load_ledger/run_id=<id>/attempt=<token>/part=<n>/...   keys, in parts by their hash
    _log/<version>.json                       commits and id reservations, in order

The log is the only thing that decides.  Version n + 1 is one small file that is
created exclusively: of two writers one creates it, the other one reads it
and tries the next version.  A file appears whole or not at all, so a writer
that dies leaves nothing behind that anyone reads.

* A commit names the attempt whose rows count.  A writer notes the version at which it
  read the store (``begin``); commits since then are checked before its own:
  the same run id (``RunCommittedError``), ledger keys in common or stock
  that someone else changed (``RunConflictError``: decide again and publish again).
* ``reserve`` takes ranges of ids before rows are written, so no two
  writers share one.  The ids of a run are consecutive; a run that dies leaves a gap.

The ledger grows with every run, and a load asks it about the keys of one feed.
``publish`` therefore writes a Bloom filter of a run's keys beside them, in
blocks of about 1,000 keys (``ledger_filter``); ``ledger_for`` tests the feed's
keys against the blocks that they fall into, and reads only the parts that may
hold one.

An attempt writes into folders of its own and never touches another's.
Readers join each table with the commits, so uncommitted rows are invisible.

Only a folder that does not exist counts as empty.  Anything else that keeps
a table or the log from being read is an error."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.operators.ranking import bitmap_words, has_bit
from tillpoint.schema import SCHEMAS
from tillpoint.session import shuffles_dropped
from tillpoint.sources.tables import Tables, conform

LEDGER_SCHEMA = "external_order_id string, product_sku string, row_num long, order_id long"
LEDGER_KEY = ["external_order_id", "product_sku"]
PARALLEL_WRITES = 4
# The Bloom filter of a run's ledger: bitmaps of 2^15 bits, 32 bits and 12
# positions a key, so about one absent key in a million passes.
FILTER_SCHEMA = "blocks long, parts long, block long, bits binary"
BLOCK_KEYS = 1_000
PART_KEYS = 1_000_000
HASHES, SLICES, SLICE_BITS = 3, 4, 15
STOCK_SCHEMA = "product_id long, change long"
# What a run adds to the reports (``plans/live_views.py``), the key first.
DELTA_SCHEMAS = {
    "product_delta": {"product_id": "bigint", "orders": "bigint", "units": "bigint", "revenue": "decimal(38,2)",
                      "price_sum": "decimal(38,2)", "price_n": "bigint"},
    "category_delta": {"category_id": "bigint", "orders": "bigint"},
    "customer_delta": {"customer_id": "bigint", "orders": "bigint", "revenue": "decimal(38,2)",
                       "first_order_at": "timestamp", "last_order_at": "timestamp"},
    "month_delta": {"month": "timestamp", "orders": "bigint", "revenue": "decimal(38,2)"},
}
LOG_SCHEMA = ("version long, kind string, run_id string, attempt string, tables array<string>, committed_at timestamp, "
              "records_read long, records_loaded long, records_failed long, records_skipped long, "
              "last_order_id long, last_item_id long, last_log_id long")


class RunCommittedError(RuntimeError):
    """The run id is already committed."""


class RunConflictError(RuntimeError):
    """Another run was committed meanwhile that this one depends on."""


def create_exclusively(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with ``text``, whole or not at all; False if it exists.

    A local file (or a shared mount) is linked into place, which never replaces one.
    Elsewhere it is renamed into place, which HDFS refuses if the target exists."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":
        place = target.toUri().getPath()
        draft = os.path.join(os.path.dirname(place), f".{uuid.uuid4().hex}")
        os.makedirs(os.path.dirname(place), exist_ok=True)
        try:
            with open(draft, "x") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            os.link(draft, place)
            return True
        except FileExistsError:
            return False
        finally:
            if os.path.exists(draft):
                os.unlink(draft)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    done = not fs.exists(target) and fs.rename(draft, target)
    if not done:
        fs.delete(draft, False)
    return done


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._seen: dict[str, int] = {}

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _schema(self, name: str) -> T.StructType:
        deltas = {n: ", ".join(f"{c} {kind}" for c, kind in fields.items()) for n, fields in DELTA_SCHEMAS.items()}
        fixed = ({"load_ledger": LEDGER_SCHEMA, "ledger_filter": FILTER_SCHEMA, "stock_changes": STOCK_SCHEMA} | deltas).get(name)
        # Not from the session's own parser state: a DDL string names its types.
        return SCHEMAS[name] if fixed is None else T.StructType.fromDDL(fixed)

    # -- the log ------------------------------------------------------------
    def log(self) -> DataFrame:
        """All entries of the log, as a table."""
        schema = T.StructType.fromDDL(LOG_SCHEMA)
        if not self.version():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("mode", "FAILFAST").json(self._path("_log"))

    def version(self) -> int:
        """The latest version of the log; 0 before the first entry."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._path("_log"))
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return max([int(n.split(".")[0]) for n in names if not n.startswith(".")], default=0)

    def _append(self, version: int, entry: dict) -> bool:
        text = json.dumps({"version": version} | {k: v for k, v in entry.items() if v is not None})
        return create_exclusively(self.spark, f"{self._path('_log')}/{version:020d}.json", text + "\n")

    def markers(self) -> DataFrame:
        """One row per committed run."""
        return self.log().filter("kind = 'commit'")

    def committed_runs(self) -> list[str]:
        """Ids of the committed runs, for inspection."""
        return [r[0] for r in self.markers().select("run_id").collect()]

    def marker(self, run_id: str):
        """The commit of a run, or None."""
        return self.markers().filter(F.col("run_id") == F.lit(run_id)).first()

    # -- tables -------------------------------------------------------------
    def _read(self, name: str) -> DataFrame | None:
        """All attempts of a table, run_id and attempt as text; None if
        nothing was ever written."""
        schema = T.StructType([*self._schema(name).fields, T.StructField("run_id", T.StringType()), T.StructField("attempt", T.StringType())])
        try:
            return self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _rows(self, name: str, commits: DataFrame) -> DataFrame:
        found = self._read(name)
        if found is None:
            return self.spark.createDataFrame([], self._schema(name))
        rows = found.join(commits.select("run_id", "attempt"), ["run_id", "attempt"], "left_semi").drop("run_id", "attempt", "part")
        return conform(rows, name) if name in SCHEMAS else rows

    def table(self, name: str, run_id: str | None = None) -> DataFrame:
        """Committed rows of ``name`` (of one run, if given); empty with the
        declared schema when there are none."""
        commits = self.markers()
        return self._rows(name, commits if run_id is None else commits.filter(F.col("run_id") == F.lit(run_id)))

    def current(self, t: Tables) -> Tables:
        """``t`` with the committed runs applied: their orders and items
        added, their stock changes summed per product.  ``version`` tells
        which commits are in it for certain."""
        version = self.version()
        change = self.table("stock_changes").groupBy(F.col("product_id").alias("id")).agg(F.sum("change").alias("_change"))
        products = t.products.join(change, "id", "left").withColumn(
            "stock", (F.col("stock") + F.coalesce(F.col("_change"), F.lit(0))).cast("int"))
        return t.with_(orders=t.orders.unionByName(self.table("orders")),
                       order_items=t.order_items.unionByName(self.table("order_items")),
                       products=conform(products, "products"), version=version)

    def prepare(self, *names: str) -> None:
        """Give the log and these tables a folder, if they have none, so that SQL
        over the folders resolves before the first run.  A table gets an attempt without rows
        that no commit names."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self._path("_log"))
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
        for name in names:
            self.spark.createDataFrame([], self._schema(name)).write.mode("ignore").parquet(
                f"{self._path(name)}/run_id=no-run/attempt=no-attempt")

    # -- ledger -------------------------------------------------------------
    def ledger_parts(self, keys: DataFrame) -> list[tuple[str, str, int]]:
        """(run_id, attempt, part) of the committed ledger parts that may hold
        a key of ``keys``.  Only the filters are read; what reaches the driver is
        folder names."""
        filters = self._read("ledger_filter")
        if filters is None:
            return []
        commits = self.markers().select("run_id", "attempt")
        filters = filters.join(commits, ["run_id", "attempt"], "left_semi")
        # Block counts are powers of two: at most 63 different ones.
        counts = [r[0] for r in filters.select("blocks").distinct().collect()]
        if not counts:
            return []
        # A key moves once, to its block, and without its positions.
        probe = keys.select(F.explode(F.array(*[F.struct(F.lit(n).alias("blocks"), _block(n).alias("block")) for n in counts])).alias("at"),
                            *LEDGER_KEY).select("at.*", *LEDGER_KEY).repartition("blocks", "block").distinct()
        # Bits are read from numbers, which are made once a block: no key copies its bitmap.
        filters = filters.withColumn("words", bitmap_words(F.col("bits"))).drop("bits")
        found = probe.join(filters, ["blocks", "block"]).filter(reduce(Column.__and__, [has_bit(F.col("words"), p) for p in _positions()]))
        part = F.pmod("block", "parts").alias("part")
        return [tuple(r) for r in found.select("run_id", "attempt", part).distinct().collect()]

    def ledger_for(self, keys: DataFrame) -> DataFrame:
        """The committed ledger rows of the parts that may hold a key of
        ``keys``: all that an anti join of ``keys`` with the ledger needs."""
        parts = self.ledger_parts(keys)
        if not parts:
            return self.spark.createDataFrame([], self._schema("load_ledger"))
        paths = [f"{self._path('load_ledger')}/run_id={r}/attempt={a}/part={p}" for r, a, p in sorted(parts)]
        return self.spark.read.schema(self._schema("load_ledger")).parquet(*paths)

    # -- ids ----------------------------------------------------------------
    def _taken(self) -> tuple[int, int, int]:
        r = self.log().agg(F.max("last_order_id"), F.max("last_item_id"), F.max("last_log_id")).first()
        return tuple(x or 0 for x in r)

    def id_marks(self, base_orders: DataFrame, base_items: DataFrame) -> tuple[int, int]:
        """Highest order id and item id in use or reserved: the base tables'
        maxima, read anew for every run, and the log's; no published table is scanned."""
        o, i = max_ids(base_orders, base_items)
        taken = self._taken()
        return max(o, taken[0]), max(i, taken[1])

    def reserve(self, orders: int = 0, items: int = 0, logs: int = 0,
                base: tuple[DataFrame, DataFrame] | None = None) -> tuple[int, int, int]:
        """Reserve that many consecutive ids of orders, items and audit rows
        for this writer.  Returns the ids before the first ones; ``base``: tables
        whose ids are in use besides."""
        used = max_ids(*base) if base is not None else (0, 0)
        while True:
            version = self.version()
            taken = self._taken()
            last = max(used[0], taken[0]), max(used[1], taken[1]), taken[2]
            # Entries written since the version was read make this one fail.
            if self._append(version + 1, {"kind": "ids", "last_order_id": last[0] + orders, "last_item_id": last[1] + items,
                                          "last_log_id": last[2] + logs}):
                return last

    # -- publication --------------------------------------------------------
    def begin(self, run_id: str, version: int | None = None) -> None:
        """Note the version at which this run reads the store (default: now)."""
        self._seen[run_id] = self.version() if version is None else version

    def publish(self, run_id: str, frames: dict[str, DataFrame | Callable], counts: dict[str, int] | None = None) -> str:
        """Write every frame into a new attempt, then commit it.  Returns the
        attempt.  Fails if the run is already committed, or if commits since
        ``begin`` (of any run, without it: since now) conflict with this one.

        A frame may be a function: it gets the frames that this attempt has written, as read back
        from there, so that what follows from them is not computed from their sources again."""
        attempt = "a" + uuid.uuid4().hex
        seen = self._seen.get(run_id, self.version())
        place = lambda name: f"{self._path(name)}/run_id={run_id}/attempt={attempt}"
        if "load_ledger" in frames:
            ledger, blocks, parts = ledger_parted(frames["load_ledger"], (counts or {}).get("loaded"))
            frames = frames | {"load_ledger": ledger}

        def write(frame: tuple[str, DataFrame]) -> None:
            by = ["part"] if frame[0] == "load_ledger" else []
            frame[1].write.mode("error").partitionBy(*by).parquet(place(frame[0]), compression="zstd")

        # Independent jobs: the small tables are written while tasks of the large ones run.
        first = {name: df for name, df in frames.items() if not callable(df)}
        with shuffles_dropped(self.spark), ThreadPoolExecutor(PARALLEL_WRITES) as pool:
            list(pool.map(write, first.items()))
            written = {name: self.spark.read.schema(self._schema(name)).parquet(place(name)) for name in first}
            rest = {name: df(written) for name, df in frames.items() if callable(df)}
            list(pool.map(write, rest.items()))
            if "load_ledger" in frames:
                # From the written keys, which lie by part: they do not move again.  It sorts twelve
                # rows a key, so it has the memory to itself.
                rest["ledger_filter"] = ledger_filter(written["load_ledger"], blocks, parts)
                write(("ledger_filter", rest["ledger_filter"]))
        frames = first | rest
        n = counts or {}
        entry = {"kind": "commit", "run_id": run_id, "attempt": attempt, "tables": sorted(frames),
                 "committed_at": dt.datetime.now(dt.timezone.utc).isoformat(), "records_read": n.get("read"),
                 "records_loaded": n.get("loaded"), "records_failed": n.get("failed"), "records_skipped": n.get("skipped")}
        checked = 0
        while True:
            version = self.version()
            if self.marker(run_id) is not None:
                raise RunCommittedError(f"run {run_id} is already committed")
            self._check(run_id, attempt, frames, max(seen, checked), version)
            if self._append(version + 1, entry):
                self._seen.pop(run_id, None)
                return attempt
            checked = version

    def _check(self, run_id: str, attempt: str, frames: dict[str, DataFrame], after: int, upto: int) -> None:
        """Raise if a commit of the versions after ``after`` conflicts."""
        if upto <= after:
            return
        newer = self.markers().filter(F.col("version").between(after + 1, upto))
        if "stock_changes" in frames and newer.filter(F.array_contains("tables", "stock_changes")).limit(1).count():
            raise RunConflictError(f"run {run_id}: stock was changed meanwhile")
        newer = newer.filter(F.array_contains("tables", "load_ledger"))
        if "load_ledger" in frames and newer.limit(1).count():
            mine = self.spark.read.schema(self._schema("load_ledger")).parquet(
                f"{self._path('load_ledger')}/run_id={run_id}/attempt={attempt}")
            both = self._rows("load_ledger", newer).select(*LEDGER_KEY).join(mine.select(*LEDGER_KEY), LEDGER_KEY)
            if both.limit(1).count():
                raise RunConflictError(f"run {run_id}: some of its rows were loaded meanwhile")


def max_ids(base_orders: DataFrame, base_items: DataFrame) -> tuple[int, int]:
    """(highest order id, highest item id); 0 for empty tables."""
    return tuple(df.agg(F.max("id")).first()[0] or 0 for df in (base_orders, base_items))


def _block(blocks: int | Column) -> Column:
    return F.pmod(F.xxhash64(*LEDGER_KEY), F.lit(blocks).cast("long"))


def _positions() -> list[Column]:
    """The bits of a key inside its block, cut from hashes that do not choose the block."""
    hashes = [F.xxhash64(*LEDGER_KEY, F.lit(k)) for k in range(HASHES)]
    low = F.lit((1 << SLICE_BITS) - 1).cast("long")
    return [F.shiftright(h, SLICE_BITS * i).bitwiseAND(low) for h in hashes for i in range(SLICES)]


def _power(n: int) -> int:
    """The least power of two that is at least ``n``, and 1."""
    return 1 << max(n - 1, 0).bit_length()


def ledger_parted(ledger: DataFrame, rows: int | None = None) -> tuple[DataFrame, int, int]:
    """The ledger of a run with its parts, and the numbers of blocks and parts.  A
    part is a union of blocks, as both counts are powers of two.  ``rows``: how many it has, if known."""
    rows = ledger.count() if rows is None else rows
    blocks, parts = _power(-(-rows // BLOCK_KEYS)), _power(-(-rows // PART_KEYS))
    return ledger.withColumn("part", F.pmod(_block(blocks), F.lit(parts)).cast("int")).repartition(parts, "part"), blocks, parts


def ledger_filter(ledger: DataFrame, blocks: int, parts: int) -> DataFrame:
    """The filter of a run's keys."""
    bits = ledger.select(_block(blocks).alias("block"), F.explode(F.array(*_positions())).alias("position"))
    bits = bits.groupBy("block").agg(F.bitmap_construct_agg("position").alias("bits"))
    return bits.select(F.lit(blocks).cast("long").alias("blocks"), F.lit(parts).cast("long").alias("parts"), "block", "bits")
