"""Session helpers shared by every plan."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data directory ``sf_dir`` (one Parquet file or a folder of them)."""
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def find_package(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies for the driver, whatever their working directory."""
    root = str(Path(__file__).resolve().parents[1])
    path = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, path)))


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Give CPU-heavy Arrow stages enough partitions.

    A scan that already has as many partitions as the cluster has cores is left alone (at scale no shuffle is added), and
    so is what comes from an exchange; a small scan is dealt round-robin over ``per_core`` partitions per core. The rows
    are the same either way.
    """
    if _EXCHANGES.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    want = max(2, df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want * per_core)


_EXCHANGES = re.compile(r"(?m)^[ :+-]*(?:Aggregate|Join|Window|Repartition|RepartitionByExpression|RebalancePartitions|Deduplicate|Distinct|Sort|Intersect|Except)\b")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` hash-partitioned by ``by`` over ``spark.sql.shuffle.partitions``, which adaptive execution leaves as they are.

    For exchanges that come anyway before work that costs much more per byte than a scan.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one is set only where none is (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = Path(tempfile.gettempdir(), f"textloom-checkpoint-{os.getpid()}").as_uri()
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: lineage ends, executors may be lost.

    Parquet takes a fraction of an RDD checkpoint's space. The tables of a process are removed when it ends. What was
    exchanged to make a table is removed as soon as it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)
    if not _written:
        atexit.register(_remove)
    _written.append((spark, at))
    table = spark.read.schema(df.schema).parquet(at)
    table._cut_at = at
    return table


def discard(table: DataFrame) -> None:
    """Delete a table written by ``cut`` once nothing reads it any more."""
    at = getattr(table, "_cut_at", None)
    for entry in [x for x in _written if x[1] == at]:
        _written.remove(entry)
        _delete(*entry)


_written: list[tuple[SparkSession, str]] = []


def _remove() -> None:
    for spark, at in _written:
        try:
            _delete(spark, at)
        except Exception:  # noqa: BLE001 - the session is gone, and its folder with it or kept for inspection
            return


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame) -> DataFrame:
    """Persist with spill to disk, for results used by more than one branch of a plan."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
