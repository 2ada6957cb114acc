"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def get_spark(app: str = "turnwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for: UTC, adaptive execution, zstd Parquet."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A session on one machine (``local[...]``) that names none gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = os.environ.get("TURNWISE_TEST_SHARED") or tempfile.mkdtemp(prefix="turnwise-shared-")
    os.environ["TURNWISE_TEST_SHARED"] = made
    return f"file://{made}"


def stash(df: DataFrame, what: str = "stage") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts the lineage and survives lost executors.

    The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, what: str) -> str:
    """A new place in the shared folder; what is written there is removed when the driver ends."""
    path = f"{shared_dir(spark)}/turnwise/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with this package on the Python path of the workers, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores where the session asks for it with ``turnwise.spread``; as they are otherwise, whatever their size.

    For files of few row groups on one machine, before operators that spend far more on a row than it costs to move it.
    """
    spark = df.sparkSession
    return df.repartition(spark.sparkContext.defaultParallelism) if spark.conf.get("turnwise.spread", "false") == "true" else df


def small(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, which is checked by reading it; as it is otherwise."""
    spark = df.sparkSession
    rows = df.limit(limit + 1).collect()
    return broadcast(spark.createDataFrame(rows, df.schema)) if len(rows) <= limit else df


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the gateway may be gone; the folder is the cluster's to clean then
        pass
