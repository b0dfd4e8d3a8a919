"""Tables written on the way, in the folder that driver and executors share: spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REPOSITORY = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_own: str | None = None


def workers_import_here(spark: SparkSession) -> None:
    """Let Python workers import this package where its folder is visible to them; elsewhere, ship it with --py-files."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if REPOSITORY not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [REPOSITORY, known]))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it gets a temporary folder, a cluster without it is an error."""
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


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The table, evaluated once: what follows reads files that outlive executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tuned(spark: SparkSession) -> SparkSession:
    """HotSpot never compiles methods beyond 8,000 bytes of code, and the chain of checks makes longer ones: there, plain generated
    projections, whose methods are split, are faster. A limit that the session sets stays."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, "8000")
    return spark


def dealt(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan of fewer files than cores is dealt out by `keys`, for a file with a single row group is one task, however long the work per row;
    a scan of many files stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if len(scan.inputFiles()) < cores else scan
