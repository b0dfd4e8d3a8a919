"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPOSITORY = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Text that a broadcast table may hold.
MAX_BROADCAST_BYTES = 64 << 20
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20)

#: ASCII white space, as the word patterns of the operators see it.
SPACES = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where the folder is visible to them, and bound what goes to them at once.

    On a cluster without a common file system, ship the package with --py-files. Batches of whole texts are buffered outside the
    heap on both sides, so unless the session says otherwise they are cut at BATCH_BYTES.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if REPOSITORY not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [REPOSITORY, known]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A local session without the setting gets a temporary folder; a cluster without it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="feedweir-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


_own: str | None = None


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends at files that outlive executors."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    give_back(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trim() -> None:
    """What this Python process has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run):
    """Wrap a function over the batches of a partition: after the last one, freed memory goes back to the system,
    for Python workers stay and serve later tasks."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def give_back(spark: SparkSession) -> bool:
    """The same for the driver, its JVM's memory outside the heap as well: planning and compiling a query takes and frees much
    of it, which the C library keeps for each thread. False where the JVM has no such command."""
    trim()
    gateway = spark.sparkContext._gateway
    java = gateway.jvm.java.lang
    types, values = gateway.new_array(java.Class, 4), gateway.new_array(java.Object, 4)
    try:
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = java.Class.forName(name)
        values[0], values[1] = gateway.jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # through the interface, for the server's own class is closed to callers
        java.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


def settled(frame: pd.DataFrame) -> pd.DataFrame:
    """An empty frame's columns default to floats, which can't become text; as objects they fit any type."""
    return frame if len(frame) else frame.astype(object)


def few(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """The table, marked for broadcast if it is counted to have at most `max_rows` rows and MAX_BROADCAST_BYTES of text."""
    rows = df.count()
    if rows > max_rows:
        return df
    texts = [F.octet_length(c) if t == "string" else F.octet_length(F.array_join(c, " ")) for c, t in df.dtypes if t in ("string", "array<string>")]
    size = df.agg(F.sum(sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(0)))).first()[0] if texts and rows else 0
    return F.broadcast(df) if (size or 0) <= MAX_BROADCAST_BYTES else df


def salted_lookup(big: DataFrame, small: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """Left join of `big` to `small` (at most one row a key), spreading each key of `big` over `salts` tasks.

    The copies of `small` cost salts times its rows, so pre-aggregate it first. Null keys find nothing.
    """
    left = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
