"""Session, table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "evidex") -> SparkSession:
    """A UTC session with adaptive execution; an existing session is reused."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only on one machine (tests) an own one is made where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = made.get() if made.isDefined() else None
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="evidex-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_RUN = uuid.uuid4().hex


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, in the folder of this run."""
    return f"{scratch_dir(spark)}/evidex/{_RUN}/{tag}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all that this run staged. To be called when no result that was built on it is read any more."""
    home = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/evidex/{_RUN}")
    home.getFileSystem(spark._jsc.hadoopConfiguration()).delete(home, True)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back. release() deletes it."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """df in enough partitions to keep every core busy in a Python stage; large inputs have them already."""
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
