"""Written tables in the shared folder of the cluster: a plan is cut there, and survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a local master without it, a folder of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, base, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{base}")
    return f"file://{base}"


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut_in_buckets(df: DataFrame, *keys: str) -> DataFrame:
    """cut(), dealt by the keys into buckets: joins and groups by these keys then move no rows of it."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"tidemark_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", new_path(spark)).saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files stay where they are, and the plan knows them
    return written


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: it is computed once, its
    lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
