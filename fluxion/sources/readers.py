"""Readers: one entry for tables and array files, and what can be told of their columns.

Parquet, ORC, CSV and JSON go through Spark's own readers. NPZ, NPY and MATLAB v5 files are read by a task for each file (binaryFile), so that
inputs may lie in any store Spark reads; their arrays come out in long form. HDF5 (and MATLAB v7.3) needs h5py and raises where it is absent.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {".csv": ",", ".tsv": "\t", ".txt": None, ".dat": None}
ARRAYS = (".npz", ".npy", ".mat")


class UnsupportedFormat(ValueError):
    """No reader for the extension."""


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A table, by extension; tables keep the order of their file in `_ordinal`. Arrays: name, shape, position (row-major), value."""
    ext = extension(path)
    if ext in TABLES:
        return read_delimited(spark, path)
    if ext in (".json", ".jsonl", ".ndjson"):
        return read_json(spark, path)
    if ext in ARRAYS:
        return read_arrays(spark, path)
    if ext in (".parquet", ".orc"):
        return getattr(spark.read, ext[1:])(path)
    if not ext:  # a folder written by write_dataset
        return load_dataset(spark, path)[0]
    if ext in (".h5", ".hdf5"):
        raise UnsupportedFormat(f"{path}: HDF5 needs h5py, which is not installed")
    raise UnsupportedFormat(f"{path}: unknown extension {ext!r}; known are {', '.join([*TABLES, '.json', *ARRAYS, '.parquet', '.orc'])}")


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """CSV, TSV or blanks, told from the first line; a first line of numbers only is no header (columns c0, c1, ...)."""
    head = [r["value"] for r in spark.read.text(path).limit(1).collect()]
    line = head[0] if head else ""
    sep = next((s for s in ("\t", ";", ",") if s in line), None)
    names = [n.strip().strip('"') for n in (line.split(sep) if sep else line.split())]
    bare = bool(names) and all(_numeric(n) for n in names)
    if sep:
        df = spark.read.csv(path, sep=sep, header=not bare, inferSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="", nanValue="nan")
        df = df.toDF(*([f"c{i}" for i in range(len(df.columns))] if bare else [c.strip() for c in df.columns]))
    else:
        rows = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("v"), F.monotonically_increasing_id().alias("_i"))
        rows = rows if bare else rows.where(F.col("_i") > 0)
        df = rows.select(*[F.expr(f"try_cast(v[{i}] as double)").alias(f"c{i}" if bare else n) for i, n in enumerate(names)])
    return nan_to_null(df).withColumn("_ordinal", F.monotonically_increasing_id())


def _numeric(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records, records under `data`, or one object of columns of equal length."""
    lines = extension(path) != ".json"
    df = spark.read.json(path, multiLine=not lines)
    if df.columns == ["data"] and isinstance(df.schema["data"].dataType, T.ArrayType):
        df = df.select(F.inline("data"))
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    if lists and len(lists) == len(df.columns):
        df = df.select(F.inline(F.arrays_zip(*lists)))
    return nan_to_null(df).withColumn("_ordinal", F.monotonically_increasing_id())


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema])


# --- arrays


def parse_mat5(data: bytes) -> dict[str, np.ndarray]:
    """Numeric and text arrays of a MATLAB v5 file; structs, cells and objects are skipped."""
    if data[:4] == b"\x89HDF" or data[:19].startswith(b"MATLAB 7.3"):
        raise UnsupportedFormat("MATLAB v7.3 files are HDF5, which needs h5py; it is not installed")
    order = "<" if data[126:128] == b"IM" else ">"
    kinds = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
    out: dict[str, np.ndarray] = {}

    def element(buf: bytes, at: int) -> tuple[int, bytes, int]:
        kind, size = struct.unpack_from(order + "II", buf, at)
        if kind >> 16:  # small element
            return kind & 0xFFFF, buf[at + 4 : at + 4 + (kind >> 16)], at + 8
        return kind, buf[at + 8 : at + 8 + size], at + 8 + size + (-size % 8 if kind != 15 else 0)

    def matrix(buf: bytes) -> None:
        _, flags, at = element(buf, 0)
        cls, complex_ = flags[0] if order == "<" else flags[3], bool((flags[1] if order == "<" else flags[2]) & 8)
        _, dims, at = element(buf, at)
        _, name, at = element(buf, at)
        shape = np.frombuffer(dims, order + "i4")
        if cls not in (4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15) or at >= len(buf):
            return
        kind, raw, at = element(buf, at)
        text = kind in (16, 17, 18)
        values = np.frombuffer(raw, order + kinds.get({16: 2, 17: 4, 18: 6}.get(kind, kind), "u1")).reshape(shape, order="F")
        if cls == 4 or text:
            values = np.array(["".join(map(chr, row)).rstrip() for row in np.atleast_2d(values)])
        elif complex_:
            return
        out[name.decode("latin-1")] = values

    at = 128
    while at + 8 <= len(data):
        kind, raw, at = element(data, at)
        if kind == 15:
            kind, raw, _ = element(zlib.decompress(raw), 0)
        if kind == 14:
            matrix(raw)
    return out


def load_arrays(path: str, data: bytes) -> dict[str, np.ndarray]:
    ext = extension(path)
    if ext == ".npy":
        return {"data": np.load(io.BytesIO(data), allow_pickle=False)}
    if ext == ".npz":
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            return {k: z[k] for k in z.files}
    return parse_mat5(data)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """path, name, shape, position, value of every numeric array of the files, a task for each file; nan as null."""
    schema = "path string, name string, shape array<int>, position long, value double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                for name, a in load_arrays(p, bytes(raw)).items():
                    if a.dtype.kind not in "fiub":
                        continue
                    flat = np.ascontiguousarray(a, float).ravel()
                    for lo in range(0, len(flat), 1 << 18):
                        part = flat[lo : lo + (1 << 18)]
                        yield pd.DataFrame({"path": p, "name": name, "shape": [list(a.shape)] * len(part), "position": np.arange(lo, lo + len(part)), "value": part})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return nan_to_null(files.repartition(max(1, files.rdd.getNumPartitions())).mapInPandas(run, schema))


def array_table(arrays: DataFrame, name: str, time: str | None, dt: float, axes: str) -> DataFrame:
    """Long rows of one array by its axis letters: r (trajectory), t, x, y, v (variable). Missing letters are one. Time from a named array, or dt."""
    own = arrays.where(F.col("name") == name)
    shape = own.select("shape").first()[0]
    size = dict(zip(axes, shape, strict=True))
    stride, left = {}, 1
    for a in reversed(axes):
        stride[a] = left
        left *= size[a]
    at = {a: (F.floor(F.col("position") / stride[a]) % size[a]).cast("int") if a in stride else F.lit(0) for a in "rtxyv"}
    rows = own.select(*[at[a].alias(n) for a, n in (("r", "traj"), ("t", "step"), ("x", "ix"), ("y", "iy"), ("v", "variable"))], "value")
    if time is None:
        return rows.withColumn("t", F.col("step") * dt)
    return rows.join(F.broadcast(arrays.where(F.col("name") == time).select(F.col("position").cast("int").alias("step"), F.col("value").alias("t"))), "step")


def array_headers(arrays: DataFrame) -> dict[str, np.ndarray]:
    """The arrays of read_arrays as the driver needs them to tell their roles: vectors with their values, others as blanks of their shape."""
    out = {r["name"]: np.broadcast_to(np.nan, tuple(r["shape"])) for r in arrays.select("name", "shape").distinct().collect()}
    vectors = [n for n, a in out.items() if a.size == max(a.shape, default=0)]
    for r in arrays.where(F.col("name").isin(vectors)).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("position", F.coalesce("value", F.lit(float("nan"))).alias("v")))).alias("z")).collect():
        out[r["name"]] = np.array([x["v"] for x in r["z"]])
    return out


# --- inspection


def inspect(df: DataFrame) -> DataFrame:
    """A row for each column: type, rows, nulls, distinct values, least and most of numbers (as doubles), an example of others.

    Each column is grouped by itself, so that no row is made once for each distinct count."""
    return reduce(DataFrame.unionAll, [_inspected(df, f) for f in df.schema])


def _inspected(df: DataFrame, f: T.StructField) -> DataFrame:
    number = isinstance(f.dataType, (T.NumericType, T.BooleanType))
    own, c = df.select(F.col(f"`{f.name}`").alias("c")), F.col("c")
    apart = not isinstance(f.dataType, T.MapType)
    own = own.groupBy("c").count() if apart else own.withColumn("count", F.lit(1).cast("long"))
    return own.agg(
        F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(c.isNull(), F.col("count"))), F.lit(0)).alias("nulls"),
        F.count(c).alias("n_unique") if apart else F.lit(None).cast("long").alias("n_unique"),
        (F.min(c.cast("double")) if number else F.lit(None).cast("double")).alias("least"), (F.max(c.cast("double")) if number else F.lit(None).cast("double")).alias("most"),
        (F.lit(None).cast("string") if number else F.min(c.cast("string"))).alias("example"),
    )


def is_monotone(df: DataFrame, value: str, order: str, key: tuple[str, ...] = ()) -> DataFrame:
    """For each key: whether value never falls, and whether it always rises."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(order)
    d = df.select(*key, (F.col(value) - F.lag(value).over(w)).alias("_d"))
    return d.groupBy(*key).agg(F.coalesce(F.bool_and(F.col("_d") >= 0), F.lit(True)).alias("never_falls"), F.coalesce(F.bool_and(F.col("_d") > 0), F.lit(True)).alias("rises"))


_RESERVED = frozenset("and as assert break class continue def del elif else except for from global if import in is lambda not or pass raise return try while with yield None True False".split())
_TAKEN = frozenset("sin cos tan cot exp log sqrt sinh cosh tanh asin acos atan atan2 abs sign Max Min pi E t x y".split())


def sanitize_names(names: list[str], coordinates: tuple[str, ...] = ("t", "x", "y"), keep: tuple[str, ...] = ()) -> list[str]:
    """Identifiers that expressions can use: no keywords, functions, coordinates, parameter-like (p0, z1) or derivative-like (u_x) names; unique."""
    out: list[str] = []
    for n in names:
        own = re.sub(r"\W+", "_", n.strip()).strip("_") or "v"
        own = f"v{own}" if own[0].isdigit() else own
        if (own in _RESERVED or own in _TAKEN and own not in keep and (own in coordinates or own not in ("t", "x", "y")) or re.fullmatch(r"[pz]\d+", own)):
            own += "_"
        own = re.sub(r"_(?=[xyt]+$)", "", own)
        while own in out:
            own += "_"
        out.append(own)
    return out


def write_dataset(df: DataFrame, path: str, meta: dict) -> None:
    """Parquet, each file in the order of trajectories, and meta.json beside it, written by Spark so that any store will do. Files are as many as tasks,
    however many trajectories there are."""
    df.sortWithinPartitions(*[c for c in ("traj", "step") if c in df.columns]).write.mode("overwrite").parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/data"), json.loads(spark.read.text(f"{path}/meta").first()[0])
