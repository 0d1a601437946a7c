"""What the training-data operators share: tables, the shared folder, staging, the held-out rule."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch handed to Python. Whole texts travel in them, so it is kept small.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of our own, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and all run on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="lodestrata-")
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, so a lost executor costs no more than its tasks."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    hand_back(df.sparkSession)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def done(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and have Spark's cleaner look for shuffle files that nothing refers to."""
    for t in tables:
        if path := getattr(t, "scratch_path", None):
            drop_scratch(t.sparkSession, path)
    gc.collect()
    for t in tables[:1]:
        t.sparkSession.sparkContext._jvm.System.gc()
        hand_back(t.sparkSession)


def trim() -> None:
    """Give what this process has freed back to the system; its C library and Arrow keep it. Where there is no such call, nothing happens."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def hand_back(spark: SparkSession) -> None:
    """Give what the driver's Python and JVM have freed outside the Java heap back to the system. The C library keeps it, scattered
    over an arena for each of dozens of threads, so that a long session would hold far more than it uses. Where there is no such call, nothing happens."""
    trim()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    with suppress(Py4JError):
        command = gateway.new_array(jvm.java.lang.Object, 4)
        command[0], command[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # Through the interface, as the server's own class is not open to the gateway.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), command)


ARROW_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the session's Arrow batch size to what whole texts bear. It stays so, as lazy tables read it when they run."""
    if not 0 < int(spark.conf.get(ARROW_CONF)) <= rows:
        spark.conf.set(ARROW_CONF, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Another Arrow batch size for what runs inside, put back after it."""
    before = spark.conf.get(ARROW_CONF)
    spark.conf.set(ARROW_CONF, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_CONF, before)


def remainder(key: Column) -> Column:
    """crc32 of the id as text, modulo 5. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours in the shared folder, through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        name, n = f"{base}_{n}", n + 1
    return name


def kept_rows(df: DataFrame, keep) -> DataFrame:
    """The rows, all columns as they are, of which keep(texts) says so; keep is called per Arrow batch where the data lies."""
    small_batches(df.sparkSession)
    names = df.columns
    at = [c.lower() for c in names].index("text")

    def run(batches):
        choose = keep()
        for b in batches:
            yield b.filter(pa.array(choose(b.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, T.StructType(df.schema.fields))
