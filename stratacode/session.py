"""Session helpers: reading tables and cutting lineage on shared storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_SHIPPED: set[str] = set()
_CUTS: list[str] = []
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Prepares a session: gives the executors' Python this package, once per application, wherever the driver was started.

    The archive is served by the driver; it is read there only. Unions are also kept from claiming a partitioning:
    with it, adaptive planning of a join over a union can end in "PartitioningCollection requires all of its
    partitionings have the same numPartitions" (seen with Spark 4.1.2).
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="stratacode_ship_")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"stratacode_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session in one process (``local``) without that setting gets a folder of its own, removed at exit; on a
    cluster, where other machines could not read it, the setting is demanded.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="stratacode_"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return "file://" + _OWN_DIR[0]


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: the plan starts anew there, and a lost executor costs nothing.

    What was shuffled for it goes as soon as it is written; otherwise those files stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = os.path.join(work_dir(spark), f"cut_{uuid.uuid4().hex}")
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    _CUTS.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def drop_cut(df: DataFrame) -> None:
    """Deletes what :func:`cut` wrote for ``df``; for the rounds of a loop that no later plan reads."""
    path = getattr(df, "_cut_path", None)
    if path is not None:
        _delete(df.sparkSession, path)
        _CUTS.remove(path)


def clear_cuts(spark: SparkSession) -> None:
    """Deletes all that :func:`cut` wrote in this process; results that are not yet written out can no longer be read."""
    while _CUTS:
        _delete(spark, _CUTS.pop())


@atexit.register
def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            clear_cuts(spark)
        except Exception:  # the JVM may be gone before us
            pass


def is_empty(df: DataFrame) -> bool:
    """True if ``df`` has no row; reads at most one."""
    return not df.limit(1).count()


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
