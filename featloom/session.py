"""Session defaults and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split skewed join partitions even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # aggregates of a hundred columns make methods the JVM will not compile; without
    # code generation they run faster
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Since Spark 4.1: files of a query's exchanges go when it ends, not when the driver collects garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleanup_lock = threading.Lock()
_cleanup_users: dict[int, tuple[int, str | None]] = {}

T = TypeVar("T")


def build_session(app: str = "featloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def limit_methods(spark: SparkSession) -> None:
    """Set the limit of :data:`SESSION_DEFAULTS` in a session built elsewhere, if it has Spark's own.

    Methods beyond it are generated all the same, but the JVM interprets them.
    """
    key, own = "spark.sql.codegen.hugeMethodLimit", "65535"
    if spark.conf.get(key) == own:
        spark.conf.set(key, SESSION_DEFAULTS[key])


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode.

    On a cluster a machine-local folder would be lost with its machine, so an
    unset folder is an error there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="featloom-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table written between two steps."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def exchanges_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no files of their exchanges behind.

    For writes, whose exchanges nothing reads again; otherwise they lie beside the files they
    were for until the end.  Threads may be inside together; the last one restores the setting.
    """
    me = id(spark)
    with _cleanup_lock:
        users, before = _cleanup_users.get(me, (0, None))
        if users == 0:
            before = spark.conf.get(CLEANUP_CONF, None)
            spark.conf.set(CLEANUP_CONF, "true")
        _cleanup_users[me] = (users + 1, before)
    try:
        yield
    finally:
        with _cleanup_lock:
            users, before = _cleanup_users.pop(me)
            if users > 1:
                _cleanup_users[me] = (users - 1, before)
            elif before is None:
                spark.conf.unset(CLEANUP_CONF)
            else:
                spark.conf.set(CLEANUP_CONF, before)


def drop_files(df: DataFrame) -> None:
    """Delete the files of a :func:`materialize` result that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(
    df: DataFrame, name: str, file_rows: int | None = None, schema: st.StructType | None = None
) -> DataFrame:
    """Write a result that several jobs read to the shared folder, and read it back.

    Unlike a cache it survives lost executors, and later jobs read only the
    columns they need.  ``file_rows`` is the most rows a file may hold; ``schema`` the
    types to read back, where they are not those written.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write if file_rows is None else df.write.option("maxRecordsPerFile", file_rows)
    with exchanges_dropped(df.sparkSession):
        writer.option("compression", "zstd").parquet(path)
    reader = df.sparkSession.read
    return (reader if schema is None else reader.schema(schema)).parquet(path)


@contextlib.contextmanager
def one_file_a_task(spark: SparkSession) -> Iterator[None]:
    """Scans planned inside do not put several files into one task.

    Spark fills tasks by the bytes of files, of which repeated values leave few: a task may
    hold rows that are many times as large in memory.
    """
    opening, most = "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(opening)
    # With this cost a first file fills its task.
    spark.conf.set(opening, spark.conf.get(most))
    try:
        yield
    finally:
        spark.conf.set(opening, before)


# Types whose values lie in the fixed part of a row, eight bytes each.
_FIXED = (st.BooleanType, st.ByteType, st.ShortType, st.IntegerType, st.LongType, st.FloatType,
          st.DoubleType, st.DateType, st.TimestampType, st.TimestampNTZType)


def row_bytes(schema: st.StructType) -> Column:
    """Bytes a row takes in memory: eight for each column, a bit for its null, and its text.

    Texts are rounded up to eight bytes.  Files hold the same columns much smaller where
    values repeat or are null.  Nested columns are refused.
    """
    fixed = 8 * ((len(schema) + 63) // 64) + 8 * len(schema)
    total = F.lit(fixed).cast("long")
    for field in schema:
        if isinstance(field.dataType, (st.StringType, st.BinaryType)):
            size = F.octet_length(F.col("`" + field.name.replace("`", "``") + "`"))
            total = total + F.coalesce(F.ceil(size / 8) * 8, F.lit(0))
        elif isinstance(field.dataType, st.DecimalType):
            total = total + 16
        elif not isinstance(field.dataType, _FIXED):
            raise TypeError(f"{field.name}: no size of {field.dataType.simpleString()}")
    return total


def materialize_measured(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """:func:`materialize`, and the bytes of all rows in memory, summed while they are written."""
    seen = Observation()
    size = F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0)).alias("bytes")
    return materialize(df.observe(seen, size), name), seen.get["bytes"]


def in_parallel(calls: Iterable[Callable[[], T]], threads: int = 8) -> list[T]:
    """Run independent fits side by side; each is a small job that waits on the cluster."""
    calls = list(calls)
    if len(calls) < 2:
        return [call() for call in calls]
    with ThreadPoolExecutor(min(threads, len(calls))) as pool:
        return list(pool.map(lambda call: call(), calls))
