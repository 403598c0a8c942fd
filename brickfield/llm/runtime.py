"""Session facts that operators need: partition count, the shared folder, bounded broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a folder of this session."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        named = "/tmp/checkpoints" if sc.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder, so a lost executor does not bring the whole chain back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, what: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back."""
    path = fresh_dir(df.sparkSession, what)
    df.write.parquet(path)
    until_the_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def until_the_end(spark: SparkSession, path: str) -> None:
    """Marks a written folder of intermediate files for removal when the driver's JVM ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
