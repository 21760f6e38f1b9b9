"""Session settings and the shared folder that jobs may write work files to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # Nominal times, partition values and event times are all UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # An overwrite of a partitioned table replaces the slots it has rows for, not the table.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Target size of a written file after a rebalance.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
}


def build_session(app_name: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with this package's settings; ``settings`` (dots as ``__``) win over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError("nominal times are UTC: set spark.sql.session.timeZone to UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, readable by every executor.

    Only a local master may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="slotwise-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, deleted when the driver's JVM ends."""
    hadoop_path, fs = _hadoop(spark, f"{shared_dir(spark)}/slotwise/{label}-{uuid.uuid4().hex}")
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return fs.makeQualified(hadoop_path).toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _hadoop(spark, path)
    return fs.exists(hadoop_path)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, for others to see that something has been done."""
    hadoop_path, fs = _hadoop(spark, path)
    fs.create(hadoop_path, True).close()


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders right below a path; none if it is not there."""
    hadoop_path, fs = _hadoop(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(hadoop_path) if s.isDirectory())


def delete_path(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _hadoop(spark, path)
    return fs.delete(hadoop_path, True)


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
