"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "exprstudy", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and single-node runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the session names; only a local master without one gets its own."""
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    if spark.sparkContext.getCheckpointDir() is not None:
        return spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a shared folder before running this job")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read that copy from then on.

    This cuts the lineage with files that outlive any executor, and gives later
    joins a table of known size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/exprstudy/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
