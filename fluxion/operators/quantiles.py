"""Exact quantiles without sorting a column in one place.

Values are counted in bins between the least and the most; the bins that hold a wanted rank are cut into bins again, until few rows are left
in them, whose distinct values come to the driver. Tasks count Arrow batches into a table of bounded size, and each pass keeps one row in
some hundreds, so that three or four passes do for any table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a pass over all intervals of a column, and rows that may come to the driver.
BINS, FEW = 8192, 100_000
_SCHEMA = "c int, k int, n long, a double, z double"


def _counted(df: DataFrame, held: dict[int, list[tuple]], n: int) -> DataFrame:
    """c, k, n, a, z: rows, least and most of bin k (interval * n + bin) of the columns' closed, disjoint, ascending intervals."""
    edges = {i: (np.array([h[0] for h in own]), np.array([h[1] for h in own])) for i, own in held.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {i: np.zeros(len(lo) * n, np.int64) for i, (lo, _) in edges.items()}
        least = {i: np.full(len(lo) * n, np.inf) for i, (lo, _) in edges.items()}
        most = {i: np.full(len(lo) * n, -np.inf) for i, (lo, _) in edges.items()}
        for batch in batches:
            for i, (lo, hi) in edges.items():
                column = batch.column(i)
                x = (column.drop_null() if column.null_count else column).to_numpy(zero_copy_only=False)
                j = np.searchsorted(lo, x, "right") - 1
                inside = (j >= 0) & (x <= hi[j])
                x, j = x[inside], j[inside]
                width = hi[j] - lo[j]
                k = j * n + np.minimum(np.divide((x - lo[j]) * n, width, out=np.zeros(len(x)), where=width > 0), n - 1).astype(np.int64)
                count[i] += np.bincount(k, minlength=len(count[i]))
                np.minimum.at(least[i], k, x)
                np.maximum.at(most[i], k, x)
        for i in edges:
            at = np.flatnonzero(count[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(at, pa.int32()), pa.array(count[i][at]), pa.array(least[i][at]), pa.array(most[i][at])], names=["c", "k", "n", "a", "z"])

    return df.mapInArrow(run, _SCHEMA).groupBy("c", "k").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("z").alias("z"))


def _inside(df: DataFrame, held: dict[int, list[tuple]]) -> DataFrame:
    """c, x: the values within the columns' intervals."""
    edges = {i: (np.array([h[0] for h in own]), np.array([h[1] for h in own])) for i, own in held.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (lo, hi) in edges.items():
                column = batch.column(i)
                x = (column.drop_null() if column.null_count else column).to_numpy(zero_copy_only=False)
                j = np.searchsorted(lo, x, "right") - 1
                x = x[(j >= 0) & (x <= hi[j])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i), pa.int32()), pa.array(x)], names=["c", "x"])

    return df.mapInArrow(run, "c int, x double")


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], few: int = FEW, bins: int = BINS) -> dict[str, list[float | None]]:
    """{column: quantiles}, linear between neighbours, nulls left out; None for a column without values."""
    x = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    ends = x.agg(*[a for c in x.columns for a in (F.min(c).alias(f"a{c}"), F.max(c).alias(f"z{c}"), F.count(c).alias(f"n{c}"))]).first()
    size = {i: ends[f"nx{i}"] for i in range(len(columns)) if ends[f"nx{i}"]}
    # intervals of each column: least, most, rows below, rows inside
    held = {i: [(ends[f"ax{i}"], ends[f"zx{i}"], 0, n)] for i, n in size.items()}
    ranks = {i: np.unique([min(int(s * (n - 1)) + d, n - 1) for s in shares for d in (0, 1)]) for i, n in size.items()}
    while sum(h[3] for own in held.values() for h in own if h[0] < h[1]) > few:
        n = max(2, bins // max(len(own) for own in held.values()))
        found = _counted(x, held, n).toPandas().sort_values(["c", "k"])
        for i, own in found.groupby("c"):
            j = own["k"].to_numpy() // n
            first = np.array([h[2] for h in held[i]])[j] + own.groupby(j)["n"].cumsum().to_numpy() - own["n"].to_numpy()
            last = first + own["n"].to_numpy()
            wanted = np.searchsorted(ranks[i], first, "left") < np.searchsorted(ranks[i], last, "left")
            held[i] = list(zip(own["a"][wanted], own["z"][wanted], first[wanted].tolist(), (last - first)[wanted].tolist(), strict=True))
    own = _inside(x, held).groupBy("c", "x").count().toPandas() if held else None
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    for i, n in size.items():
        part = own[own["c"] == i].sort_values("x")
        v, count = part["x"].to_numpy(), part["count"].to_numpy()
        j = np.searchsorted([h[0] for h in held[i]], v, "right") - 1
        upto = np.array([h[2] for h in held[i]])[j] + part["count"].groupby(j).cumsum().to_numpy()
        value = lambda r, v=v, u=upto: float(v[np.searchsorted(u, r, "right")])
        for k, s in enumerate(shares):
            at = s * (n - 1)
            a, b = value(int(at)), value(min(int(at) + 1, n - 1))
            out[columns[i]][k] = a + (b - a) * (at - int(at))
    return out


def median(df: DataFrame, value: str | Column) -> float | None:
    own = df.select((F.col(value) if isinstance(value, str) else value).alias("_v"))
    return quantiles(own, ["_v"], [0.5])["_v"][0]
