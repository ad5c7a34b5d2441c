"""SparkSession construction and cluster-shared scratch locations."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "quarry") -> SparkSession:
    """Session with AQE, Arrow and no UI.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # streaming state spills to local disk
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets it to shared storage. Only a ``local`` master may leave it
    unset (tests); then a temporary folder is made.
    """
    sc = spark.sparkContext
    path = spark.conf.get(_CKPT_KEY, None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"set {_CKPT_KEY} to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set(_CKPT_KEY, path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/quarry-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables; unique across drivers and calls."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this application wrote below ``scratch_root``. Call
    it at the end, when no frame that reads the scratch tables is in use."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(conf).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable on the executors (UDFs and ``mapInPandas``
    functions reference it), once per application.

    The package is zipped and added with ``addPyFile``; Spark distributes it
    to every executor, so the code does not depend on the working directory or
    on executor images.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="quarry-pkg-")
    archive = shutil.make_archive(os.path.join(out, "quarry"), "zip", os.path.dirname(pkg), "quarry")
    sc.addPyFile(archive)
    _SHIPPED.add(app)
