"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "fairlake") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


@atexit.register
def _remove_made() -> None:
    """Results are read lazily from intermediate tables, so these go when the driver's process ends."""
    for spark, path in _MADE:
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
        except (Py4JError, OSError):  # the JVM has ended already
            return


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can reach; removed when the driver's process ends.

    Lies below ``spark.checkpoint.dir``, or below the warehouse, which executors share as
    well, where that setting is absent. A warehouse in a machine's own files is refused off local mode.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        own_files = ":" not in base or base.startswith("file:")
        if own_files and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{base.rstrip('/')}/_intermediate"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Makes ``DataFrame.checkpoint`` usable where the cluster has not set a folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))
