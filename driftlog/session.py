"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_ROOT = "driftlog.scratch.dir"
_OWN_FOLDERS: set[str] = set()


def build_session(master: str = "local[8]", app: str = "driftlog", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    A cluster keeps its own shuffle-partition count; locally eight is enough.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master.startswith("local"):
        builder = builder.config("spark.sql.shuffle.partitions", "8").config(
            "spark.driver.memory", "12g"
        )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if master.startswith("local"):
        name_shared_root(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, named in ``spark.checkpoint.dir``.

    Spark takes that setting only when a session starts, so the folder that
    ``name_shared_root`` gives a local session stands in ``OWN_ROOT``.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_ROOT, None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return named.rstrip("/")


def name_shared_root(spark: SparkSession) -> str:
    """``shared_root`` for entry points: a local session that names no folder
    gets one of its own, which is deleted when the process ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_ROOT, None)
    if not named and spark.sparkContext.master.startswith("local["):
        own = tempfile.mkdtemp(prefix="driftlog-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set(OWN_ROOT, own)
    return shared_root(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing exists there yet.

    All paths of an application lie in one folder, which the driver deletes when
    it ends; executors never do.
    """
    own = os.path.join(shared_root(spark), "driftlog", spark.sparkContext.applicationId)
    if own not in _OWN_FOLDERS:
        where = spark._jvm.org.apache.hadoop.fs.Path(own)
        # An instance of its own, which nobody else closes before the end.
        system = spark._jvm.org.apache.hadoop.fs.FileSystem.newInstance(where.toUri(), spark._jsc.hadoopConfiguration())
        system.mkdirs(where)
        system.deleteOnExit(where)
        _OWN_FOLDERS.add(own)
    return os.path.join(own, f"{name}-{uuid.uuid4().hex}")


def save_and_reload(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where one expensive result feeds several branches; the written table
    survives lost executors, unlike a cached or locally checkpointed one.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
