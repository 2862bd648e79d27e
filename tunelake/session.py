"""Session helpers: building a local session for tests/bench and finding the
shared checkpoint folder of whatever session we were handed."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "tunelake") -> SparkSession:
    """Local session with the settings the library is tuned for.

    On a cluster the caller owns the session; nothing in the library
    depends on these values except for speed."""
    master = master or os.environ.get("TUNELAKE_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TUNELAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Only on a ``local`` master, as in tests, an unset
    one is replaced by a scratch folder; elsewhere that is an error, since
    other hosts could not read it."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None) or None
        if found:
            sc.setCheckpointDir(found)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tunelake-ckpt-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: computes it once, cuts the lineage (a lost executor re-reads the
    files instead of recomputing) and gives exact row counts for size
    checks from file metadata."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Spark removes a query's shuffle files when it ends, not when the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize_tidy(df, name: str):
    """``materialize``, and the shuffle files of this one write go when it ends."""
    conf = df.sparkSession.conf
    was = conf.get(TIDY, None)
    conf.set(TIDY, "true")
    try:
        return materialize(df, name)
    finally:
        conf.unset(TIDY) if was is None else conf.set(TIDY, was)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tunelake`` importable in the Python workers of this
    application (pandas UDFs and ``mapInPandas`` functions refer to its
    modules): zip the package once and register it with ``addPyFile``, the
    same mechanism as ``spark-submit --py-files``; Spark serves the file to
    every executor."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import tunelake

    root = os.path.dirname(os.path.abspath(tunelake.__file__))
    folder = tempfile.mkdtemp(prefix="tunelake-pyfiles-")
    path = os.path.join(folder, "tunelake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(key)
