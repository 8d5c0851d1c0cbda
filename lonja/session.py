"""Session helper and lineage control."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def build_session(app: str = "lonja", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on.

    Nothing here depends on the size of the cluster: partition counts come from AQE
    coalescing, so on a real cluster only the initial number has to be raised.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


_LOCAL_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is only made in local mode, where the driver and the executors
    share one disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if sc.applicationId not in _LOCAL_DIR:
        _LOCAL_DIR[sc.applicationId] = tempfile.mkdtemp(prefix="lonja-")
    return _LOCAL_DIR[sc.applicationId]


def side_by_side(steps: list[Callable[[], T]], at_once: int = 4) -> list[T]:
    """Results of independent driver steps (model fits), whose Spark jobs then share the cluster."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(inherit(step)) for step in steps]]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{shared_dir(spark)}/checkpoint")
    return df.checkpoint()
