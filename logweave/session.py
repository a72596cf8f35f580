"""Session building and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "logweave", cores: int | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the queries are tested under. On a cluster, use the cluster's own."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder. It is the cluster's ``spark.checkpoint.dir``; a folder of our own is set
    only where that is unset and the master is local."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; a machine's own folder would not be shared")
        named = tempfile.mkdtemp(prefix="logweave-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and go on from there: short lineage that survives a lost executor, in columns that
    are packed and can be read one by one. The files go when the session's JVM ends; ``drop`` removes them before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cuts-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop.getParent())
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove what ``cut`` wrote for df, once nothing reads it any more; for the rounds of an iteration."""
    if path := getattr(df, "_cut_path", None):
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
