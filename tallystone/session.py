"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and single-node runs; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallystone")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        java_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = java_dir.get() if java_dir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="tallystone-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_given: list[str] = []  # scratch paths of this driver that are not released yet


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch folder."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _given.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Remove all that this driver has written below scratch paths; returns how many there were.

    Results that are not yet consumed read from there, so call it when they are, or
    before the session stops. Paths of other drivers in the same folder stay.
    """
    removed = 0
    while _given:
        path = spark._jvm.org.apache.hadoop.fs.Path(_given.pop())
        removed += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several consumers would otherwise each recompute an expensive
    plan, and where a lost executor must not force that plan to run again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scan_in_small_tasks(spark: SparkSession, each: int = 16 << 20) -> None:
    """Let a scan task read ``each`` bytes at most, for rows that grow many times wider before a sort.

    A task then sorts them in memory; scan tasks of the usual size spill them. The
    setting stays for the session.
    """
    name = "spark.sql.files.maxPartitionBytes"
    now = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    spark.conf.set(name, str(min(now, each)))


def finished_numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """N of every finished subfolder ``name=N``, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    done = [p for p in found if p.getName().startswith(f"{name}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)
