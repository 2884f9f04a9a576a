"""Session defaults and lineage helpers.

Everything here is configuration a Spark user would set: UTC session time
zone (month/day buckets depend on it), adaptive execution with skew-join
splitting, Arrow for the rare pandas hop, and a shared checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str | None = None, app: str = "tillpoint",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> SparkSession:
    """Pin UTC (bucketing by month/day is zone dependent) and make sure a
    checkpoint folder exists.  An existing cluster setting is never replaced."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # HotSpot never compiles methods beyond 8,000 bytes of bytecode: a stage whose
    # generated method is larger would run interpreted.  A value set by hand stays.
    if spark.conf.get(HUGE_METHOD) == "65535":
        spark.conf.set(HUGE_METHOD, "8000")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session.  Only a local-mode session (tests) without the
    setting gets a private scratch folder; on a cluster a missing setting is
    an error, since a machine-local folder would not survive executor loss."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder (HDFS / object store)")
        d = tempfile.mkdtemp(prefix="tillpoint-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


# Scratch folders created by this process (released by release_scratch).
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    folder = f"{checkpoint_dir(spark)}/tillpoint/{uuid.uuid4().hex}"
    _SCRATCH.append(folder)
    return f"{folder}/{name}"


def scratch_mark() -> int:
    """Position to pass to release_scratch(since=...) later."""
    return len(_SCRATCH)


def release_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete the scratch folders this process created after the mark
    ``since`` (all by default).  Call it once the DataFrames that read them have been
    consumed (they are lazy and read the folders when executed).  Uses the
    Hadoop FileSystem of the checkpoint folder, so it works for HDFS, object
    stores and local paths; a no-op when the JVM gateway is not available."""
    victims = list(_SCRATCH[since:])
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    except Exception:  # noqa: BLE001 - e.g. a remote (Connect) session
        return 0
    done = 0
    for folder in victims:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        _SCRATCH.remove(folder)
        done += 1
    return done


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs begun inside delete their shuffle files when they end, not when the driver's
    garbage collector finds them unused.  For writes: nobody runs their plan again."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, name: str = "stage", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Cuts lineage (a lost executor re-reads the written files instead of
    recomputing upstream shuffles) and freezes non-deterministic columns such
    as partition ids.  One job, no recomputation.  ``compression``: zstd for what
    is written whole and read few times."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.parquet(path)


def local_session_for_tests(cores: int = 8) -> SparkSession:
    os.environ.setdefault("PYSPARK_PYTHON", "python")
    return get_session(master=f"local[{cores}]", shuffle_partitions=8,
                       extra={"spark.driver.memory": "8g"})
