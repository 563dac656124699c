"""Session defaults and the shared scratch folder."""
from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(app: str = "recurra", cores: str | int = "*", shuffle_partitions: int = 8,
              memory: str = "8g") -> SparkSession:
    """A local session with the settings the package expects (UTC, AQE on)."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")     # small local data: keep the cores busy
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application: Python functions are unpickled there by module name."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="recurra-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/recurra.zip"
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


_LOCAL: dict[str, str] = {}          # application id -> folder, for local masters without a setting


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in the cluster's shared folder (``spark.checkpoint.dir``).

    Executors can be lost, so intermediate tables go to storage every node
    sees. Only a ``local`` master, where driver and tasks are one process, may do without the
    setting; its folder goes when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all nodes")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="recurra-")
            atexit.register(shutil.rmtree, _LOCAL[app], True)
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/recurra-{uuid.uuid4().hex}"


def materialise(df, spark: SparkSession | None = None, codec: str | None = None):
    """Cut lineage: write ``df`` to the shared folder and read it back. ``codec``: the compression, if not the session's."""
    spark = spark or df.sparkSession
    path = scratch_dir(spark)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20):
    """Batches for Python are bounded by ``size`` bytes, or hold one row, in what runs inside; the session's setting is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)                            # None: not set, the default holds
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files of finished steps now: Spark deletes them once the driver's garbage collection has found them unused."""
    spark.sparkContext._jvm.System.gc()
