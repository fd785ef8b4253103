"""Sparse identification of ordinary differential equations from trajectories."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import linear_combination
from . import regression
from .gram import Gram, grams
from .library import build_library, columns, split_rows
from .windows import smooth_and_differentiate


def features(df: DataFrame, variables: Sequence[str], dt: float, window: int = 9, order: int = 3, method: str = "savgol", edge: int = 3) -> DataFrame:
    """Smoothed variables (under their own names) and derivatives `<v>_t`, ends trimmed."""
    rest = [c for c in df.columns if c not in variables]
    out = smooth_and_differentiate(df, variables, dt, window, order, method)
    out = out.select(*rest, *[F.col(f"{v}_s").alias(v) for v in variables], *[f"{v}_t" for v in variables])
    if not edge:
        return out
    span = df.groupBy("traj").agg(F.min("step").alias("_lo"), F.max("step").alias("_hi"))  # of the input: nothing is smoothed twice
    return out.join(span, "traj").where((F.col("step") >= F.col("_lo") + edge) & (F.col("step") <= F.col("_hi") - edge)).drop("_lo", "_hi")


def train_and_held(rows: DataFrame, variables: Sequence[str], library: dict, targets: Sequence[str] | None = None) -> tuple[Gram, Gram]:
    """Both Gram matrices in one pass."""
    rows, held = split_rows(rows)
    wanted = {v: F.col(f"{v}_t") for v in (targets or variables)}
    found = grams(rows, columns(library), wanted, F.when(held, "held").otherwise("train"))
    blank = Gram.empty(list(library), list(wanted))
    return found.get("train", blank), found.get("held", blank)


def run_sindy(
    df: DataFrame, variables: Sequence[str], dt: float, degree: int = 3, trig: bool = False, custom: Iterable[str] = (), exclude: Iterable[str] = (),
    thresholds: Sequence[float] = regression.THRESHOLDS, ridge: float = 1e-6, window: int = 9, order: int = 3, method: str = "savgol",
    tolerance: float = 0.05, targets: Sequence[str] | None = None, library_vars: Sequence[str] | None = None, refit: bool = True,
) -> dict:
    """{rhs: {variable: text}, path: {variable: [threshold, n_terms, val_err, model]}, library_size}. refit: the chosen threshold is applied to
    training and validation rows together; otherwise validation rows stay out."""
    library = build_library(variables, degree, trig, custom, exclude, library_vars=library_vars)
    train, held = train_and_held(features(df, variables, dt, window, order, method), variables, library, targets)
    rhs, paths, coefs = {v: "0" for v in variables}, {}, {}
    for k, v in enumerate(train.targets):
        best, path = regression.sweep(train, held, k, thresholds, ridge, tolerance)
        c = regression.stlsq(train + held, k, best["threshold"], ridge) if refit else best["coef"]
        rhs[v], coefs[v] = linear_combination(c, train.terms), c
        paths[v] = [{**{n: r[n] for n in ("threshold", "n_terms", "val_err")}, "model": linear_combination(r["coef"], train.terms, 4)} for r in path]
    return {"rhs": rhs, "coefficients": coefs, "terms": train.terms, "path": paths, "library_size": len(library)}


def as_rows(spark, result: dict) -> DataFrame:
    """variable, term, coef of the fitted model, zeros left out."""
    rows = [(v, t, float(x)) for v, c in result["coefficients"].items() for t, x in zip(result["terms"], c, strict=True) if x]
    return spark.createDataFrame(rows, "variable string, term string, coef double")
