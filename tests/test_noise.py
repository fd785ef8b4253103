"""Noise through test functions and filters: predicted floors against noise that is really drawn, and what acceptance by the floor chooses."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxion.functions.expressions import parse
from fluxion.operators import regression, uncertainty, weakform
from fluxion.operators.gram import grams, of_arrays
from fluxion.operators.simulate import simulate
from fluxion.operators.systems import SYSTEMS


def oscillator(noise, n=400, trajectories=3, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(trajectories):
        t = np.arange(n) * 0.05
        a, p = 1 + 0.5 * k, 0.7 * k
        x, y = a * np.sin(t + p), a * np.cos(t + p)
        out.append(pd.DataFrame({"traj": k, "step": np.arange(n), "x": x + noise * rng.normal(size=n), "y": y + noise * rng.normal(size=n)}))
    return pd.concat(out)


SCHEMA = "traj int, step int, x double, y double"


def test_predicted_floor_is_what_noise_leaves(spark):
    """The true model's residual on noisy data against the floor of its coefficients, nonlinear terms included."""
    library = {t: parse(t, ["x", "y"]) for t in ("1", "x", "y", "x*x", "x*y")}
    c = np.array([0.0, 0.0, 1.0, 0.3, 0.0])  # dx/dt = y, and a term that only noise can't explain
    held = F.col("traj") == 2
    ratios = []
    for seed in range(3):
        noisy, clean = (spark.createDataFrame(oscillator(s, seed=seed), SCHEMA) for s in (0.05, 0.0))
        x = [f"x{i}" for i in range(len(library))]
        a, b = (weakform.weak_ode_rows(d, ["x", "y"], library, 0.05, 12).where(held).orderBy("step").toPandas() for d in (noisy, clean))
        left = (a["y0"] - a[x].to_numpy() @ c) - (b["y0"] - b[x].to_numpy() @ c)
        noise = weakform.noise_grams(noisy, ["x", "y"], library, 0.05, 12, held)
        ratios.append(np.sqrt((left**2).sum()) / weakform.residual_floor(noise, {"x": 0.05, "y": 0.05}, 0)(c))
    assert 0.7 < np.mean(ratios) < 1.4


@pytest.mark.parametrize("chunk", [37, 100_000])
def test_weak_rows_and_noise_do_not_depend_on_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(weakform, "CHUNK", chunk)
    pdf = oscillator(0.05, 150)
    df, library = spark.createDataFrame(pdf, SCHEMA), {t: parse(t, ["x", "y"]) for t in ("1", "x", "x*y")}
    got = weakform.weak_ode_rows(df, ["x", "y"], library, 0.05, 6).toPandas().sort_values(["traj", "step"]).reset_index(drop=True)
    phi, dphi = (w[1:-1] for w in (weakform.bump(6, 8) * 0.05, -weakform.bump(6, 8, 1)))  # 0 at both ends
    want = []
    for k, g in pdf.groupby("traj"):
        x, y = g["x"].to_numpy(), g["y"].to_numpy()
        want += [(k, s, phi.sum(), phi @ x[s - 5 : s + 6], phi @ (x * y)[s - 5 : s + 6], dphi @ x[s - 5 : s + 6], dphi @ y[s - 5 : s + 6]) for s in range(6, 145, 3)]
    assert np.allclose(got.to_numpy(float), np.array(want, float))
    noise = weakform.noise_grams(df, ["x", "y"], library, 0.05, 6, F.col("traj") == 1)
    y = pdf[pdf.traj == 1]["y"].to_numpy()
    rows = range(6, 145, 3)
    assert np.isclose(noise["x"].yy[0], len(rows) * (dphi**2).sum()) and np.isclose(noise["x"].xx[1, 2], sum((phi**2 * y[s - 5 : s + 6]).sum() for s in rows))
    assert np.isclose(noise["x"].xy[2, 0], sum((phi * dphi * y[s - 5 : s + 6]).sum() for s in rows)) and noise["x"].xx[0].any() == 0 and noise["y"].xx[1].any() == 0


def test_acceptance_by_the_floor_prefers_fewer_terms():
    """Two columns share their noise with the target: the dense fit wins on held-out rows, but its error is no more below the floor than the sparse one's."""
    rng = np.random.default_rng(0)
    z, e = rng.normal(size=(400, 4)), rng.normal(0, 0.3, 400)
    y = z[:, :1] + e[:, None]
    theta = z + 0.15 * e[:, None] * np.array([0, 1, 1, 1])
    train, held = (of_arrays(theta[s], y[s], list("abcd"), ["y"]) for s in (slice(0, 200), slice(200, 400)))
    dense, _ = regression.accepted(train, held, 0, None, 0.0)
    sparse, path = regression.accepted(train, held, 0, lambda c: 0.3 * np.sqrt(200), 0.0)
    assert np.count_nonzero(dense) > 1 and np.flatnonzero(sparse).tolist() == [0] and {"n_terms", "val_err", "noise_floor", "loss"} <= set(path[0])


def test_choice_by_loss():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(300, 6))
    y = z[:, [1]] * 2 - z[:, [4]] + 0.05 * rng.normal(size=(300, 1))
    train, held = (of_arrays(z[s], y[s], list("abcdef"), ["y"]) for s in (slice(0, 200), slice(200, 300)))
    c, _ = regression.accepted(train, held, 0, rule="loss")
    assert np.flatnonzero(c).tolist() == [1, 4] and np.allclose(c[[1, 4]], [2, -1], atol=0.02)


def test_true_terms_at_five_per_cent(spark):
    s = SYSTEMS["vanderpol"]
    out = weakform.weak_sindy_ode(simulate(spark, s, 4, noise=0.05), s.variables, s.dt, 3)
    terms = {v: set(parse(e, [*s.variables, "t"]).terms) for v, e in out["rhs"].items()}
    assert terms == {v: set(parse(e, [*s.variables, "t"]).terms) for v, e in {"x": "y", "y": "-x + 2*y - 2*x*x*y"}.items()}
    assert all(0.02 < f < 0.4 for f in out["val_noise_floor"].values())


def test_floor_of_fields(spark):
    s = SYSTEMS["burgers"]
    out = weakform.weak_sindy(simulate(spark, s, 3, noise=0.05), s, s.dt)
    assert set(parse(out["rhs"]["u"], ["u", "u_x", "u_xx"]).terms) == set(parse("u_xx - u*u_x", ["u", "u_x", "u_xx"]).terms)
    assert 0.001 < out["val_noise_floor"]["u"] < 0.3


def test_seeded_normals(spark):
    df = spark.range(0, 40_000).selectExpr("id % 7 AS traj", "id AS step")
    r = df.repartition(5).select(uncertainty.white_noise(3, "traj", "step").alias("z")).agg(F.avg("z").alias("m"), F.stddev("z").alias("s"), F.kurtosis("z").alias("k")).first()
    assert abs(r["m"]) < 0.03 and abs(r["s"] - 1) < 0.03 and abs(r["k"]) < 0.2
    one = lambda d: sorted(x[0] for x in d.select(uncertainty.white_noise(3, "traj", "step")).collect())
    assert one(df.limit(500)) == one(df.limit(500).repartition(9))


def test_calibrated_floor_is_the_error_that_noise_makes(spark):
    pdf, clean = oscillator(0.05, 2000, 1), oscillator(0.0, 2000, 1)
    df = spark.createDataFrame(pdf, SCHEMA)
    r = uncertainty.calibrated_floor(df, ["x", "y"], 0.05, 9)["x"]
    from fluxion.operators.windows import smooth_and_differentiate

    slope = lambda p: smooth_and_differentiate(spark.createDataFrame(p, SCHEMA), ["x"], 0.05, 9, ends=False).where("x_t is not null").orderBy("step").toPandas()["x_t"].to_numpy()
    error = np.sqrt(((slope(pdf) - slope(clean)) ** 2).mean()) / np.sqrt((slope(pdf) ** 2).mean())
    assert abs(r["noise"] / 0.05 - 1) < 0.1 and abs(r["floor"] / error - 1) < 0.15


def test_no_held_rows_is_no_floor(spark):
    df = spark.createDataFrame(oscillator(0.0, 50, 1), SCHEMA)
    noise = weakform.noise_grams(df, ["x", "y"], {"x": parse("x", ["x", "y"])}, 0.05, 6, F.lit(False))
    assert weakform.residual_floor(noise, {"x": 1.0, "y": 1.0}, 0)(np.array([1.0])) == 0.0
    assert grams(df, {"x": F.col("x")}, {"y": F.col("y")})[None].n == 50
