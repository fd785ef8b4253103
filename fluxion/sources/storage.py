"""Where intermediate files go: a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own, if all runs on one machine as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.fluxion.files", None)
        if not found:
            found = tempfile.mkdtemp(prefix="fluxion-")
            spark.conf.set("spark.fluxion.files", found)
    return found.rstrip("/")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, by the file system that the path names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(conf).create(at)
    out.write(bytearray(data))
    out.close()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
