"""Recovery of known systems, and accuracy of the numerical parts."""

from __future__ import annotations

import numpy as np
import pytest

from fluxion.functions.expressions import parse, structure_metrics
from fluxion.operators import scoring
from fluxion.operators.simulate import blind, integrate_pde, simulate, trajectory
from fluxion.operators.sindy import run_sindy
from fluxion.operators.systems import SYSTEMS


def test_lorenz_is_recovered(spark):
    s = SYSTEMS["lorenz"]
    df = simulate(spark, s, 3, noise=0.0, t_end=6).cache()
    out = run_sindy(df, s.variables, s.dt, degree=2, window=5)
    m = structure_metrics(out["rhs"], s.rhs, s.variables)
    assert m["f1"] == 1.0 and m["coef_rel_err"] < 0.02
    v = scoring.validate(df, s.variables, out["rhs"], s.dt)
    assert max(v["deriv_nrmse"].values()) < 0.05 and not v["rollout_blew_up"]
    truth = simulate(spark, s, 2, seed=9, t_end=2)
    assert scoring.evaluate(truth, s, s.rhs)["score"] > 6.2
    assert scoring.evaluate(truth, s, {"x": "q"})["score"] == -10.0
    df.unpersist()


def test_pendulum_needs_the_sine(spark):
    s = SYSTEMS["pendulum"]
    df = simulate(spark, s, 4, noise=0.001)
    out = run_sindy(df, s.variables, s.dt, degree=1, trig=True)
    e = parse(out["rhs"]["omega"], s.variables).coefficients()
    assert abs(e["sin(theta)"] + 9.81) < 0.1 and abs(e["omega"] + 0.1) < 0.05 and len(e) <= 3


@pytest.mark.parametrize("name", sorted(SYSTEMS))
def test_every_system_runs(name):
    s = SYSTEMS[name]
    t, clean, noisy = trajectory(s, 0, 0, noise=0.02, t_end=min(s.t_end, 10 * s.dt))
    assert np.isfinite(clean).all() and clean.shape == noisy.shape and len(t) == len(clean) == 11


def test_heat_equation_against_the_exact_solution():
    s = SYSTEMS["advection_diffusion"]
    x = s.axis("x")
    t = np.arange(11) * 0.1
    u = integrate_pde(s.rhs, s, np.sin(2 * x)[:, None], t)
    want = np.exp(-0.05 * 4 * t)[:, None] * np.sin(2 * (x[None] - t[:, None]))
    assert np.abs(u[..., 0] - want).max() < 1e-8
    d = SYSTEMS["advection_diffusion_dirichlet"]
    x = d.axis("x")
    v = integrate_pde({"u": "0.2*u_xx"}, d, np.sin(np.pi * x / 10)[:, None], t)
    assert np.abs(v[..., 0] - np.exp(-0.2 * (np.pi / 10) ** 2 * t)[:, None] * np.sin(np.pi * x / 10)).max() < 1e-5


def test_blinding_tells_nothing():
    for s in SYSTEMS.values():
        hidden, _ = blind(s, 3)
        assert s.name not in hidden.name and not set(hidden.variables) & set(s.variables)


def test_kdv_strong_and_weak(spark):
    from fluxion.operators.fields import run_field_sindy
    from fluxion.operators.weakform import weak_sindy

    s = SYSTEMS["kdv"]
    frames = simulate(spark, s, 3, noise=0.01).cache()
    weak = weak_sindy(frames, s, s.dt, degree=2)
    assert structure_metrics(weak["rhs"], s.rhs, ["u", "u_x", "u_xx", "u_xxx", "u_xxxx", "x"])["f1"] == 1.0, weak
    clean = simulate(spark, s, 2)
    strong = run_field_sindy(clean, s, s.dt, degree=2, window=5, fraction=None)
    assert structure_metrics(strong["rhs"], s.rhs, ["u", "u_x", "u_xx", "u_xxx", "u_xxxx", "x"])["recall"] == 1.0, strong
    frames.unpersist()


def test_weak_ode_under_noise(spark):
    from fluxion.operators.weakform import weak_sindy_ode

    s = SYSTEMS["lorenz"]
    df = simulate(spark, s, 4, noise=0.02)
    out = weak_sindy_ode(df, s.variables, s.dt, degree=2, half=10)
    assert structure_metrics(out["rhs"], s.rhs, s.variables)["recall"] >= 6 / 7, out


def test_field_symmetries_from_data(spark):
    import numpy as np

    from fluxion.operators.field_symmetry import detect_field_symmetries, field_maps
    from fluxion.operators.systems import System

    assert set(field_maps(["u", "v"])) == {"u -> -u", "v -> -v", "u -> -u, v -> -v", "u <-> v"}
    # u_t = -(1 + sin(x) / 2) u_x keeps u along characteristics; frames are made by integrating it
    s = System("placed", {"u": "-u_x - 0.5*sin(x)*u_x + 0.1*u_xx"}, ("fourier", 1.0, 3, 0.0, None), 0.02, 1.0, 1.0, ("x",), "periodic", {"x": (64, 2 * np.pi, 0.0)}, dt_sim=1e-3)
    found = detect_field_symmetries(simulate(spark, s, 2), s, s.dt, degree=1, max_derivative=2, window=5, fraction=None)
    assert not found["translation"] and found["gain"]["u"] > 0.05
    # a field that never changes: nothing to measure against
    still = spark.createDataFrame([(0, k, 0.1 * k, [1.0] * 64) for k in range(20)], "traj int, step int, t double, u array<double>")
    none = detect_field_symmetries(still, s, 0.1, degree=1, max_derivative=2, window=5, fraction=None)
    assert none["maps"] == {} and none["generators"] == [] and none["translation"]


def test_field_symmetries_under_noise(spark):
    from fluxion.operators.field_symmetry import detect_field_symmetries

    s = SYSTEMS["burgers"]
    found = detect_field_symmetries(simulate(spark, s, 3, noise=0.01, t_end=1.0), s, s.dt, max_derivative=2, fraction=0.2)
    assert found["translation"] and found["maps"]["x -> -x"] != "symmetry" and found["maps"]["u -> -u"] != "symmetry"
    assert found["maps"]["x -> -x, u -> -u"] in ("symmetry", "inconclusive")
