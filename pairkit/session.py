"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pairkit", master: str | None = None,
                  shuffle_partitions: int | None = None, driver_memory: str | None = None,
                  scratch: str | None = None) -> SparkSession:
    """Session with the settings the library relies on.

    AQE coalesces small shuffle partitions and splits skewed join partitions, so
    `shuffle_partitions` may be set for the largest shuffle. `scratch` is for sessions whose
    cluster names no shared folder in `spark.checkpoint.dir`, as in tests.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings for text work, whose cost per byte is high.

    AQE may keep partitions as small as 64 KB, so small inputs still use all cores.
    Large ones are unaffected: their partitions are far bigger than that.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared folder named by `spark.checkpoint.dir`.

    A local temporary folder is used only when the session names none and runs in
    local mode; on a cluster executors could not read it back, so that is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = spark.conf.get("spark.checkpoint.dir", root)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = os.path.join(tempfile.gettempdir(), "pairkit-scratch")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the scratch folder and read it back.

    The written table cuts lineage, survives the loss of executors and gives the
    optimizer its real size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that `materialize` wrote and nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
