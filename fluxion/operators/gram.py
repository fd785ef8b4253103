"""Normal equations of a term library, as one pass over the rows.

Every Arrow batch contributes its own small Gram matrix (BLAS in the task), a partition one array per group, and the driver adds them up:
the p x p result is all that leaves the scan, however many rows there are. Groups (folds, blocks, train / validation) come out of the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Gram:
    """Sums over rows of products of terms (p) and targets (q)."""

    terms: list[str]
    targets: list[str]
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    n: float
    _cache: dict = field(default_factory=dict, repr=False)

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.terms, self.targets, self.xx + other.xx, self.xy + other.xy, self.yy + other.yy, self.n + other.n)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.terms, self.targets, self.xx - other.xx, self.xy - other.xy, self.yy - other.yy, self.n - other.n)

    def times(self, w: float) -> Gram:
        return Gram(self.terms, self.targets, self.xx * w, self.xy * w, self.yy * w, self.n * w)

    def keep(self, at: Sequence[int]) -> Gram:
        at = list(at)
        return Gram([self.terms[i] for i in at], self.targets, self.xx[np.ix_(at, at)], self.xy[at], self.yy, self.n)

    def error(self, c: np.ndarray, target: int) -> float:
        """Root of the residual sum of squares over that of the target. Cancels near exact fits; see regression.second_pass."""
        y = self.yy[target]
        return float(np.sqrt(max(0.0, y - 2 * c @ self.xy[:, target] + c @ self.xx @ c) / max(y, 1e-300)))

    def rss(self, c: np.ndarray, target: int) -> float:
        return float(max(0.0, self.yy[target] - 2 * c @ self.xy[:, target] + c @ self.xx @ c))

    @staticmethod
    def empty(terms: list[str], targets: list[str]) -> Gram:
        p, q = len(terms), len(targets)
        return Gram(terms, targets, np.zeros((p, p)), np.zeros((p, q)), np.zeros(q), 0.0)


def of_arrays(theta: np.ndarray, y: np.ndarray, terms: list[str], targets: list[str]) -> Gram:
    return Gram(terms, targets, theta.T @ theta, theta.T @ y, (y * y).sum(axis=0), float(len(theta)))


def _pack(theta: np.ndarray, y: np.ndarray) -> np.ndarray:
    both = np.concatenate([theta, y, np.ones((len(theta), 1))], axis=1)
    return both.T @ both


#: Groups of blocks whose matrices come to the driver: blocks are dealt to them by hash, so that their number doesn't grow with the data.
GROUPS = 512


def grouped(*keys: str | Column, groups: int = GROUPS) -> Column:
    """The group of a block, from a hash of what names it."""
    return F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")


def _partial(df: DataFrame, terms: dict[str, Column], targets: dict[str, Column], key: Column) -> DataFrame:
    """key, i, v: entry i of the matrix of products of terms, targets and 1, added up over the key's rows."""
    p, q = len(terms), len(targets)
    rows = df.select(key.cast("string").alias("_key"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(terms.values())], *[c.cast("double").alias(f"y{i}") for i, c in enumerate(targets.values())])
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("m", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).astype(float)
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            names, place = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            good = np.isfinite(table).all(axis=1)
            table, place = table[good], place[good]
            order = np.argsort(place, kind="stable")
            table, place = table[order], place[order]
            cuts = np.flatnonzero(np.diff(place, prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(place)], strict=True):
                k = names[place[lo]]
                sums[k] = sums.get(k, 0.0) + _pack(table[lo:hi, :p], table[lo:hi, p : p + q])
            if len(sums) > 4096:  # bounded memory with many keys
                yield packed(sums)
                sums = {}
        if sums:
            yield packed(sums)

    def packed(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64()))], names=["key", "m"])

    # partial matrices of equal groups are added by position before they leave the executors
    return rows.mapInArrow(run, schema).select("key", F.posexplode("m").alias("i", "v")).groupBy("key", "i").agg(F.sum("v").alias("v"))


def _gram(m: np.ndarray, terms: list[str], targets: list[str]) -> Gram:
    p, q = len(terms), len(targets)
    return Gram(terms, targets, m[:p, :p], m[:p, p : p + q], np.diag(m)[p : p + q].copy(), float(m[-1, -1]))


def grams(df: DataFrame, terms: dict[str, Column], targets: dict[str, Column], by: Column | str | None = None) -> dict:
    """Gram matrices by group (None: one group). Rows with a null or non-finite term or target are left out.

    Groups are few (folds, train and validation, `grouped` blocks): one matrix for each comes to the driver.
    """
    size = len(terms) + len(targets) + 1
    found: dict = {}
    for r in _partial(df, terms, targets, F.lit("") if by is None else F.col(by) if isinstance(by, str) else by).toLocalIterator():
        found.setdefault(r["key"], np.zeros(size * size))[r["i"]] = r["v"]
    out = {k: _gram(flat.reshape(size, size), list(terms), list(targets)) for k, flat in found.items()}
    return out if by is not None else {None: out.get("", Gram.empty(list(terms), list(targets)))}


def added(rows: DataFrame, terms: list[str], targets: list[str]) -> dict[str, Gram]:
    """{label: Gram} of rows (label, m): packed matrices, added up by position on the executors."""
    size = len(terms) + len(targets) + 1
    found: dict = {}
    for r in rows.select("label", F.posexplode("m").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v")).toLocalIterator():
        found.setdefault(r["label"], np.zeros(size * size))[r["i"]] = r["v"]
    return {k: _gram(flat.reshape(size, size), terms, targets) for k, flat in found.items()}


def packed_gram(theta: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What `added` adds up, of the rows of a task."""
    return _pack(theta, y).ravel()


def within(df: DataFrame, terms: dict[str, Column], by: Column) -> tuple[Gram, np.ndarray]:
    """The Gram matrix of all rows with a leading term of ones, and the scatter of the terms around their means within each group of `by`. A group's
    matrix stays on the executors, however many groups there are; only sums reach the driver."""
    terms = {"1": F.lit(1.0)} | terms
    p, size = len(terms), len(terms) + 1
    each = _partial(df, terms, {}, by).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("z")).select(F.col("z.v").alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, inner = np.zeros((size, size)), np.zeros((size, size))
        for batch in batches:
            m = batch.column(0).values.to_numpy()[batch.column(0).offsets.to_numpy()[0] :][: batch.num_rows * size * size].reshape(-1, size, size)
            mean = m[:, :p, -1] / m[:, -1, -1][:, None]
            whole += m.sum(axis=0)
            inner[:p, :p] += m[:, :p, :p].sum(axis=0) - np.einsum("ki,kj,k->ij", mean, mean, m[:, -1, -1])
        yield pa.RecordBatch.from_arrays([pa.array(["all", "within"]), pa.array([whole.ravel(), inner.ravel()], pa.list_(pa.float64()))], names=["label", "m"])

    found = added(each.mapInArrow(run, "label string, m array<double>"), list(terms), [])
    every = found.get("all", Gram.empty(list(terms), []))
    return every, found["within"].xx if "within" in found else np.zeros((p, p))


def wide_gram(df: DataFrame, terms: dict[str, Column], targets: dict[str, Column]) -> DataFrame:
    """The same sums as one native aggregate with a named column each, for up to ten or so terms: xx_i_j (i <= j), xy_i_k, yy_k, n."""
    x, y = list(terms.values()), list(targets.values())
    out = [F.sum(x[i] * x[j]).alias(f"xx_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    out += [F.sum(a * b).alias(f"xy_{i}_{k}") for i, a in enumerate(x) for k, b in enumerate(y)]
    return df.agg(*out, *[F.sum(b * b).alias(f"yy_{k}") for k, b in enumerate(y)], F.count("*").alias("n"))


def from_wide(row, terms: list[str], targets: list[str]) -> Gram:
    p, q = len(terms), len(targets)
    g = Gram.empty(terms, targets)
    for i in range(p):
        for j in range(i, p):
            g.xx[i, j] = g.xx[j, i] = row[f"xx_{i}_{j}"]
        for k in range(q):
            g.xy[i, k] = row[f"xy_{i}_{k}"]
    g.yy[:] = [row[f"yy_{k}"] for k in range(q)]
    g.n = float(row["n"])
    return g
