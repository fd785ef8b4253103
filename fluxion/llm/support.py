"""What the operators share: shared-folder tables, input columns, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own, if all runs on one machine as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.fluxion.scratch", None)
        if not found:
            found = tempfile.mkdtemp(prefix="fluxion-")
            spark.conf.set("spark.fluxion.scratch", found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df as a Parquet table in the shared folder and reads it back.

    Written by Spark's committer, so that it survives lost executors; later readers prune its columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sampled(column: str, salt: int, sample: int, count: int) -> F.Column:
    """True for about `sample` of `count` rows, by a hash of the column; for all if there are no more."""
    return F.lit(True) if count <= sample else F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1 << 62)) < F.lit(share(sample, count))


def share(sample: int, count: int) -> int:
    """sample / count in parts of 2**62, one part at least."""
    return max(1, (sample << 62) // max(1, count))


def id_type(df: DataFrame, name: str = "doc_id") -> T.DataType:
    return df.schema[name].dataType


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """Applies f to every Arrow batch. Select the columns before: nothing is pruned through Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return df.mapInArrow(run, schema)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets), pa.int32()), pa.array(values))


def fields(*of: tuple[str, T.DataType | str]) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t) if isinstance(t, str) else t) for n, t in of])


def crc32_text(column) -> F.Column:
    return F.crc32(column.cast("string").cast("binary"))
