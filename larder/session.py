"""Session set-up and shared-storage helpers.

Library code never invents its own storage location on a cluster: every
intermediate that must survive an executor loss (checkpoints, round-trip
writes, streaming state) goes below the folder the cluster names in
``spark.checkpoint.dir``.  Only when that setting is absent (local tests)
do we create a scratch folder ourselves.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # whole documents can be long: keep Arrow batches to the UDFs small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # remove checkpoint files once their DataFrames are garbage-collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def shuffle_partitions_for(input_bytes: int, cores: int, target_bytes: int = 256 << 20) -> int:
    """Shuffle partitions so each holds about ``target_bytes`` (AQE coalesces the rest).

    100 TB at 256 MB gives ~400k partitions; never fewer than the cores.
    """
    return max(cores, -(-input_bytes // target_bytes))


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "larder", extra: dict | None = None,
                  input_bytes: int | None = None) -> SparkSession:
    """Session with AQE, UTC and Arrow on.

    Shuffle partitions: given, else sized from ``input_bytes`` (about 256 MB
    each), else one per core.  AQE coalesces small partitions and splits
    skewed ones at run time; scan splits are 256 MB.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    cores = os.cpu_count() or 8
    conf = dict(_DEFAULTS)
    if shuffle_partitions is None:
        shuffle_partitions = shuffle_partitions_for(input_bytes, cores) if input_bytes else cores
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = str(256 << 20)
    conf["spark.sql.files.maxPartitionBytes"] = str(256 << 20)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, whatever folder the driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_larder_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="larder-package-")      # the driver serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "larder-package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for where, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(where, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._larder_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only if unset."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session: the server owns the setting
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # unset in a local run: one machine, so a private folder is shared by all tasks
        configured = tempfile.mkdtemp(prefix="larder-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/larder/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked of the file system that holds it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder, from the file system's own books."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def table_path(sf_dir: str, name: str) -> str:
    """Path of one Parquet table in a data folder."""
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


SPREAD_MIN_BYTES = 128 * 1024


def spread(df, min_bytes: int = SPREAD_MIN_BYTES):
    """Round-robin a scan over all cores when it arrives in fewer splits than cores.

    Few, large row groups leave most scan tasks empty, so per-row text work
    would run on one core.  On a cluster reading many files the scan already
    has more splits than cores and this is a no-op (no extra shuffle).
    """
    spark = df.sparkSession
    try:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= cores:
            return df
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - no JVM handle (remote session): leave the scan as it is
        return df
    return df.repartition(cores) if size >= min_bytes else df


def read_table(spark: SparkSession, sf_dir: str, name: str, balance: bool = True):
    """Read one table; ``balance`` spreads a narrow scan over the cores (see ``spread``)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread(df) if balance else df
