"""Spark session and shared-folder helpers."""

from __future__ import annotations

import hashlib
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "hpfunnel",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    On a cluster the master, memory and shuffle sizing come from the
    deployment; here only query-semantics settings are pinned (UTC, AQE).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  A local session without one gets a
    private folder; on a cluster that would be each machine's own disk, so
    there a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="hpfunnel-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate table in the shared folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def published(spark: SparkSession, name: str, version: str, write) -> str:
    """Path of a table that all sessions of the shared folder use: written once for each ``version``.

    ``write(path)`` makes it in a folder of its own, which gets its lasting
    name only when it is complete; if another session was first, its table
    is used.
    """
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    last = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{version}")
    fs, done = last.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path(last, "_SUCCESS")
    if not fs.exists(done):
        fresh = shared_path(spark, name)
        with shuffles_removed(spark):
            write(fresh)
        try:  # fails if the name is taken, where FileSystem.rename would move into it
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(last.toUri(), conf)
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            files.rename(jvm.org.apache.hadoop.fs.Path(fresh), last, none)
        except Py4JJavaError:
            if not fs.exists(done):
                return fresh
    return last.toString()


def source_version(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of the files below ``path``.

    What is kept by path is kept under this version too, so files that are
    added or rewritten later in the session are seen.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()


_REMOVING, _REMOVERS = threading.Lock(), {"inside": 0, "before": None}
SHUFFLE_REMOVAL = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What is written inside leaves no shuffle files: they go when the write ends, not with a garbage collection.

    Later plans start from the written files.  Writes of several threads share the setting.
    """
    with _REMOVING:
        if not _REMOVERS["inside"]:
            _REMOVERS["before"] = spark.conf.get(SHUFFLE_REMOVAL, "false")
            spark.conf.set(SHUFFLE_REMOVAL, "true")
        _REMOVERS["inside"] += 1
    try:
        yield
    finally:
        with _REMOVING:
            _REMOVERS["inside"] -= 1
            if not _REMOVERS["inside"]:
                spark.conf.set(SHUFFLE_REMOVAL, _REMOVERS["before"])


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared folder that this session wrote and has read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df):
    """``df`` written as Parquet into the shared folder and read back.

    Used where a derived table (client features, modelling base, scored
    grid) feeds several later plans: each of them starts from the files,
    with column pruning, pushed filters and a size that Catalyst knows, and
    a lost executor only costs the re-read.
    """
    path = shared_path(df.sparkSession, "table")
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_in_ranges(df, keys, ranges: int | None = None):
    """``df`` with ``_b``, written: rows of ``_b`` = 0 come before those of 1, and so on, in the order of ``keys``.

    The ranges follow the keys' own distribution, so rows that crowd in a
    narrow interval still spread over tasks.  By default there are as many as
    shuffle partitions, which AQE joins where they are small.  Written,
    because a plan that runs twice may begin its ranges elsewhere.
    """
    from pyspark.sql import functions as F
    df = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    return materialize(df.withColumn("_b", F.spark_partition_id()))


#: Rows of a wide table that a task sorts, and the shuffled bytes of about as many.
SORTED_ROWS_A_TASK = 250_000
SORTED_BYTES_A_TASK = 16 << 20


@contextmanager
def small_sorts(spark: SparkSession, rows: int):
    """Joins and sorts of ``rows`` wide rows run in tasks that fit a core's share of memory.

    Rows are far wider unpacked than shuffled, so tasks of AQE's usual size
    spill once the tables fill them.  More shuffle partitions, in proportion to the
    rows, and a smaller advisory size hold for what is run inside.
    """
    now = {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    parts = max(int(now["spark.sql.shuffle.partitions"]), rows // SORTED_ROWS_A_TASK + 1)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(SORTED_BYTES_A_TASK))
        yield parts
    finally:
        for name, value in now.items():
            spark.conf.set(name, value)


#: Most rows of a table that is hinted for broadcast.
BROADCAST_ROWS = 100_000


def if_small(df):
    """``df`` written, and hinted for broadcast only if it has at most ``BROADCAST_ROWS`` rows.

    Larger ones are left to Catalyst's and AQE's own choice of join.
    """
    from pyspark.sql import functions as F
    df = materialize(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def dealt(df, key: str, parts: int = 32):
    """Rows dealt by key into a fixed number of sorted partitions.

    Learners sample by partition and position; with this layout the model
    depends neither on the number of cores nor on the files.
    """
    return df.repartition(parts, key).sortWithinPartitions(key)
