"""Arms against data sets: every way to a model on every case, scored on hidden trajectories."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.expressions import structure_metrics
from ..operators import diagnostics, scoring, sindy
from ..operators.simulate import simulate
from ..operators.systems import SYSTEMS
from .discover import auto_fit

Arm = Callable[[DataFrame, Sequence[str], float], Mapping[str, str]]

#: Arms without a language model: a plain fit, and the fit that intuition recommends.
ARMS: dict[str, Arm] = {
    "plain": lambda df, variables, dt: sindy.run_sindy(df, variables, dt)["rhs"],
    "auto": lambda df, variables, dt: auto_fit(df, variables, dt, diagnostics.intuit(df, variables, dt)["config"])["rhs"],
}


def run_arms(spark: SparkSession, cases: Sequence[Mapping], arms: Mapping[str, Arm] = ARMS, seed: int = 0, t_end: float | None = None) -> DataFrame:
    """arm, system, noise, score, f1 (of the structure), model or error; cases as in SUITES, of ordinary equations. An arm that fails scores -10."""
    out = []
    for case in cases:
        s = SYSTEMS[case["system"]]
        if s.kind != "ode":
            continue
        every = case.get("every", 1)
        df = simulate(spark, s, 4, seed, case["noise"], case.get("kind", "gaussian"), t_end, every).persist()
        truth = simulate(spark, s, 2, seed, t_end=t_end, first=1000).persist()
        for name, arm in arms.items():
            try:
                rhs = dict(arm(df, s.variables, s.dt * every))
                score, f1, text = scoring.evaluate(truth, s, rhs)["score"], structure_metrics(rhs, s.rhs, [*s.variables, "t"])["f1"], str(rhs)
            except ValueError as e:
                score, f1, text = -10.0, 0.0, f"error: {e}"
            out.append((name, s.name, float(case["noise"]), float(score), float(f1), text))
        df.unpersist()
        truth.unpersist()
    return spark.createDataFrame(out, "arm string, system string, noise double, score double, f1 double, model string")
