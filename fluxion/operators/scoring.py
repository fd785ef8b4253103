"""Scores of models: against the data they come from, and against the truth."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import parse
from .simulate import integrate_ode, integrate_pde
from .sindy import features
from .systems import System


def count_terms(rhs: Mapping[str, str], names: Sequence[str]) -> int:
    return sum(max(1, len(parse(e, names).terms)) for e in rhs.values())


def nrmse(predicted: Column, observed: Column, cap: float = 10.0) -> Column:
    """Root mean squared error over the root mean square of what is observed, capped; an aggregate."""
    return F.least(F.sqrt(F.avg((predicted - observed) * (predicted - observed))) / (F.sqrt(F.avg(observed * observed)) + F.lit(1e-12)), F.lit(cap))


def derivative_errors(rows: DataFrame, rhs: Mapping[str, str]) -> DataFrame:
    """One row: for each variable, the error of the model's derivative against `<v>_t`; rows come from sindy.features."""
    names = [*rhs, "t"]
    return rows.agg(*[nrmse(parse(e, names).column(), F.col(f"{v}_t")).alias(v) for v, e in rhs.items()])


def rollout(starts: DataFrame, rhs: Mapping[str, str] | Mapping[str, Mapping[str, str]], t: np.ndarray, system: System | None = None) -> DataFrame:
    """Runs models from initial states: traj, model, step, t and variables. starts: traj and the variables (arrays for a PDE system).
    rhs: one model, or {name: model}. A task for each (trajectory, model)."""
    models = {"model": dict(rhs)} if all(isinstance(e, str) for e in rhs.values()) else {k: dict(v) for k, v in rhs.items()}
    variables = system.variables if system else list(next(iter(models.values())))
    kind = "array<double>" if system and system.kind == "pde" else "double"
    t = np.asarray(t, float)
    jobs = starts.select("traj", *variables).crossJoin(F.broadcast(starts.sparkSession.createDataFrame([(k,) for k in models], "model string")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                model = models[row.model]
                if kind == "double":
                    u = integrate_ode(model, np.array([getattr(row, v) for v in variables]), t)
                else:
                    shape = [system.grid[d][0] for d in system.dims]
                    u = integrate_pde(model, system, np.stack([np.asarray(getattr(row, v)).reshape(shape) for v in variables], axis=-1), t)
                out = {"traj": np.int32(row.traj), "model": row.model, "step": np.arange(len(t), dtype=np.int32), "t": t}
                for i, v in enumerate(variables):
                    out[v] = u[:, i] if kind == "double" else list(u[..., i].reshape(len(t), -1))
                yield pd.DataFrame(out)

    return jobs.repartition("traj", "model").mapInPandas(run, "traj int, model string, step int, t double, " + ", ".join(f"{v} {kind}" for v in variables))


def step_errors(predicted: DataFrame, observed: DataFrame, variables: Sequence[str], by: Sequence[str] = ("traj",)) -> DataFrame:
    """For each step: error over all variables relative to the size of what is observed; infinite where the model blew up."""
    keys = list(dict.fromkeys([*by, "step"]))
    common = [k for k in keys if k in observed.columns]
    seen = observed.select(*common, *[F.col(v).alias(f"_o_{v}") for v in variables])
    joined = predicted.join(seen, common)
    square = sum(((F.col(v) - F.col(f"_o_{v}")) * (F.col(v) - F.col(f"_o_{v}")) for v in variables), F.lit(0.0))
    size = sum((F.col(f"_o_{v}") * F.col(f"_o_{v}") for v in variables), F.lit(0.0))
    error = F.sqrt(square) / (F.sqrt(size) + F.lit(1e-12))
    return joined.select(*keys, "t", F.when(F.isnan(error) | error.isNull(), F.lit(float("inf"))).otherwise(error).alias("error"))


def valid_time(errors: DataFrame, by: Sequence[str] = ("traj",), limit: float = 0.3) -> DataFrame:
    """Time until the error first exceeds the limit (the whole horizon if it never does), horizon and mean error capped at 10."""
    return errors.groupBy(*by).agg(
        (F.coalesce(F.min(F.when(F.col("error") > limit, F.col("t"))), F.max("t")) - F.min("t")).alias("valid_time"),
        (F.max("t") - F.min("t")).alias("horizon"),
        F.least(F.avg(F.least("error", F.lit(1e6))), F.lit(10.0)).alias("nrmse"),
        F.max(F.isnan("error") | (F.col("error") == float("inf"))).alias("blew_up"),
    )


def validate(df: DataFrame, variables: Sequence[str], rhs: Mapping[str, str], dt: float, window: int = 9) -> dict:
    """Without any truth: on the last trajectory, error of derivatives, and of a rollout from its smoothed first state."""
    last = df.agg(F.max("traj")).first()[0]
    own = df.where(F.col("traj") == last)
    smooth = features(own, variables, dt, window, edge=0)
    trimmed = features(own, variables, dt, window)
    errors = derivative_errors(trimmed, rhs).first()
    t = np.array([r["t"] for r in own.select("t").orderBy("step").collect()])
    run = rollout(smooth.where("step = 0"), rhs, t)
    r = valid_time(step_errors(run, smooth, variables)).first()
    return {
        "n_terms": count_terms(rhs, [*variables, "t"]), "deriv_nrmse": {v: errors[v] for v in variables}, "rollout_valid_time": r["valid_time"],
        "rollout_horizon": r["horizon"], "rollout_nrmse": r["nrmse"], "rollout_blew_up": bool(r["blew_up"]),
    }


def score_value(field_error: float, rollout_error: float, valid: float, terms: int) -> float:
    """Half of the digits of both errors (6 at most), half of the valid share, less 0.02 a term; -10 for what can't be run."""
    if not np.isfinite(field_error) or not np.isfinite(rollout_error):
        return -10.0
    digits = lambda e: min(-np.log10(max(e, 1e-12)), 6.0)
    return float(0.5 * digits(field_error) + 0.5 * digits(rollout_error) + 0.5 * valid - 0.02 * terms)


def score_column(field_error: Column, rollout_error: Column, valid: Column, terms: Column) -> Column:
    digits = lambda e: F.least(-F.log10(F.greatest(e, F.lit(1e-12))), F.lit(6.0))
    return 0.5 * digits(field_error) + 0.5 * digits(rollout_error) + 0.5 * valid - 0.02 * terms


def evaluate(truth: DataFrame, system: System, candidate: Mapping[str, str]) -> dict:
    """Against hidden clean trajectories of a known system: error of the vector field on its states, rollouts, valid share, score."""
    names = [*system.variables, "t"]
    try:
        own = {v: parse(candidate.get(v, "0"), names) for v in system.variables}
    except ValueError as e:
        return {"score": -10.0, "error": str(e)}
    parts = [nrmse(own[v].column(), parse(system.rhs[v], names).column()).alias(v) for v in system.variables]
    field_error = float(np.mean(list(truth.agg(*parts).first().asDict().values())))
    t = _times(truth)
    t = t[t <= t[0] + system.horizon + 1e-9]
    runs = rollout(truth.where("step = 0"), {v: candidate.get(v, "0") for v in system.variables}, t)
    r = valid_time(step_errors(runs, truth, system.variables)).agg(F.avg("nrmse").alias("e"), F.avg(F.col("valid_time") / F.col("horizon")).alias("v")).first()
    terms = sum(max(1, len(e.terms)) for e in own.values())
    return {"vf_nrmse": field_error, "rollout_nrmse": r["e"], "valid_frac": r["v"], "n_terms": terms, "score": score_value(field_error, r["e"], r["v"], terms)}


def _times(df: DataFrame) -> np.ndarray:
    first = df.agg(F.min("traj")).first()[0]
    return np.array([r["t"] for r in df.where(F.col("traj") == first).select("t").orderBy("step").collect()])


def rank(df: DataFrame, by: Sequence[Column], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group in the given order, numbered from 1."""
    if not by:  # k rows only are numbered in one place
        return df.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)
