"""Data sets: made from known systems with a hidden part, extended by experiments, or brought to natural units."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import parse
from ..sources.readers import load_dataset, write_dataset
from . import scoring
from .library import derivative_symbols
from .simulate import blind, simulate
from .systems import SYSTEMS, System
from .windows import append_trajectories, subsample


def public_meta(system: System, noise: float, trajectories: int, every: int = 1) -> dict:
    """What a fit may know: names, steps, grid; nothing of the equations, and of blinded systems no name."""
    out = {"name": system.name, "kind": system.kind, "variables": system.variables, "dt": system.dt * every, "n_traj": trajectories}
    if system.kind == "ode":
        return out | {"allowed_symbols": [*system.variables, "t"]}
    grid = {d: {"n": n, "L": length, "x0": origin} for d, (n, length, origin) in system.grid.items()}
    return out | {"allowed_symbols": derivative_symbols(system.variables, system.dims), "spatial_dims": list(system.dims), "boundary": system.boundary, "grid": grid}


def generate(spark: SparkSession, name: str, path: str, noise: float = 0.01, kind: str = "gaussian", train: int | None = None, test: int | None = None, every: int = 1, seed: int = 0, blinded: bool = False, t_end: float | None = None) -> dict:
    """Writes noisy trajectories to path/public and clean ones from other starts, with the equations, to path/hidden, which fits never open."""
    system = SYSTEMS[name]
    if blinded:
        system, _ = blind(system, seed)
    train, test = train or (4 if system.kind == "ode" else 3), test or (4 if system.kind == "ode" else 2)
    meta = public_meta(system, noise, train, every)
    write_dataset(simulate(spark, system, train, seed, noise, kind, t_end, every), f"{path}/public", meta)
    write_dataset(simulate(spark, system, test, seed, t_end=t_end, first=1000), f"{path}/hidden", {"rhs": system.rhs, "horizon": system.horizon})
    return meta


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The public part of a generated data set."""
    return load_dataset(spark, f"{path}/public")


def request_experiment(df: DataFrame, system: System, start: Sequence[float], noise: float, seed: int = 0) -> DataFrame:
    """df with one more trajectory, from a chosen start, put in front so that the validation trajectory stays last."""
    spark = df.sparkSession
    first_traj = df.agg(F.min("traj")).first()[0]
    t = np.array([r["t"] for r in df.where(F.col("traj") == first_traj).select("t").orderBy("step").collect()])
    first = spark.createDataFrame([(0, *map(float, start))], "traj int, " + ", ".join(f"{v} double" for v in system.variables))
    run = scoring.rollout(first, system.rhs, t).drop("model")
    scale = run.agg(*[F.stddev_pop(v).alias(v) for v in system.variables]).first()
    for i, v in enumerate(system.variables):  # normal draws from hashes of (step, variable), so that a task run again draws the same
        unit = lambda salt, i=i: (F.pmod(F.xxhash64("step", F.lit(i), F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        run = run.withColumn(v, F.col(v) + noise * (scale[v] or 0.0) * F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * np.pi * unit(2)))
    return append_trajectories(df.select("traj", "step", "t", *system.variables), run)


def scaled_orbit(df: DataFrame, length: float, mu: float, time: str, position: Sequence[str], velocity: Sequence[str], every: int = 1) -> DataFrame:
    """Orbit rows in units of a radius and sqrt(radius^3 / mu), every k-th row: traj, step, t, positions and velocities as x.. and v.. columns."""
    from pyspark.sql import Window

    unit_t = float(np.sqrt(length**3 / mu))
    w = Window.partitionBy("traj").orderBy(time)
    own = df if "traj" in df.columns else df.withColumn("traj", F.lit(0))
    rows = own.select(
        "traj", (F.row_number().over(w) - 1).cast("int").alias("step"), ((F.col(time) - F.first(time).over(w)) / unit_t).alias("t"),
        *[(F.col(c) / length).alias(n) for c, n in zip(position, "xyz", strict=False)], *[(F.col(c) * unit_t / length).alias(f"v{n}") for c, n in zip(velocity, "xyz", strict=False)],
    )
    return subsample(rows, every)


def judge(candidate: Mapping[str, str], truth: Mapping[str, str], names: Sequence[str], tolerance: float = 0.05) -> str:
    """The worst of the variables' verdicts: equal, close, undecided, different."""
    from ..functions.expressions import equivalent

    order = ("equal", "close", "undecided", "different")
    return max((equivalent(candidate.get(v, "0"), e, names, tolerance) for v, e in truth.items()), key=order.index)


def each_once(one: Callable[[str | None, str | None], str], batches: Iterator[tuple[pd.Series, pd.Series]], most: int = 1 << 16) -> Iterator[pd.Series]:
    """one(a, b) of every row, called once for equal rows of a task (until `most` different ones are known, which are then forgotten)."""
    known: dict[tuple, str] = {}
    for a, b in batches:
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in known:
                if len(known) >= most:
                    known.clear()
                known[pair] = one(*pair)
            out.append(known[pair])
        yield pd.Series(out, dtype=object)


def judged(pairs: DataFrame, names: Sequence[str], tolerance: float = 0.05) -> DataFrame:
    """pairs with the column verdict of their columns a and b (`unreadable` where one of them is null or no expression); a task judges equal pairs once."""
    from ..functions.expressions import ExpressionError, equivalent

    names = list(names)

    def one(a: str | None, b: str | None) -> str:
        try:
            return "unreadable" if a is None or b is None else equivalent(a, b, names, tolerance)
        except ExpressionError:
            return "unreadable"

    @F.pandas_udf("string")
    def verdict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return each_once(one, batches)

    return pairs.withColumn("verdict", verdict("a", "b"))


def check_symbols(rhs: Mapping[str, str], allowed: Sequence[str]) -> None:
    for e in rhs.values():
        parse(e, allowed)
