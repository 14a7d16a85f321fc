"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "lectern", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution)."""
    b = SparkSession.builder.master(master).appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Where it is unset, a folder of our own in local mode only, as in tests; on a cluster
    that would be another folder on each machine, so it raises RuntimeError.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        d = "file://" + os.path.join(tempfile.gettempdir(), "lectern-shared")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it back.

    The files outlive lost executors, are compressed and column-pruned when read
    again. They are removed by release, or when the application's JVM ends.
    """
    spark = df.sparkSession
    path = f"{_app_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application; results that are still to be computed must not depend on them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_app_dir(spark))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores, before costly work row by row.

    Only a scan of fewer pieces (one small file, or few large row groups) is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
