"""Session helpers: runtime settings, the shared staging folder, and staged (lineage-cutting) tables."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

# Settings every plan here relies on; all can be set on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's `spark.checkpoint.dir`.

    A machine-local folder is created only for local mode, where driver and executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    global _LOCAL_DIR
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="riskloom-stage-")
    return _LOCAL_DIR


_LOCAL_DIR: str | None = None


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Unlike a cache, the result survives the loss of executors, has no lineage to recompute, and later readers scan
    only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_parts(spark: SparkSession, parts: Sequence[Callable[[], DataFrame]], name: str, at_once: int = 6) -> DataFrame:
    """Stage several same-shaped results as one table, each as its own job, a few at a time.

    One union of many aggregations would be re-planned as a whole by adaptive execution after every stage; separate jobs
    keep plans small, and the short tail of one fills up with the start of the next.
    """
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(i: int):
        df = parts[i]()
        df.write.parquet(f"{path}/part={i}")
        return df.schema

    with ThreadPoolExecutor(at_once) as pool:
        schemas = list(pool.map(write, range(len(parts))))
    return spark.read.schema(schemas[0]).parquet(*[f"{path}/part={i}" for i in range(len(parts))])
