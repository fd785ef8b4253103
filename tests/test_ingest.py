"""Readers and layout inference on the kinds of tables that laboratories write."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from fluxion.operators.diagnostics import intuit
from fluxion.operators.simulate import simulate
from fluxion.operators.systems import SYSTEMS
from fluxion.sources import ingest as I
from fluxion.sources import readers as R


def curve(n=60, dt=0.1, shift=0.0):
    t = np.arange(n) * dt
    return t, np.sin(t + shift), np.cos(t + shift)


def test_shuffled_table_with_runs(spark, tmp_path):
    rows = [pd.DataFrame(dict(zip(("t", "a", "b"), curve(shift=r), strict=True))).assign(run=r) for r in range(3)]
    pd.concat(rows).sample(frac=1, random_state=1).to_csv(tmp_path / "runs.csv", index=False)
    obs, meta, card = I.ingest(spark, str(tmp_path / "runs.csv"))
    assert meta["variables"] == ["a", "b"] and abs(meta["dt"] - 0.1) < 1e-9 and obs.count() == 180
    assert {a["what"] for a in card.assumptions} >= {"time column", "trajectory column"}
    got = obs.where("traj = 1").orderBy("step").toPandas()
    assert np.abs(got["a"] - curve(shift=1)[1]).max() < 1e-9


def test_time_resets_make_trajectories(spark, tmp_path):
    pd.concat([pd.DataFrame(dict(zip(("t", "x1", "y1"), curve(20), strict=True)))] * 2).to_csv(tmp_path / "r.tsv", index=False, sep="\t")
    obs, meta, _ = I.ingest(spark, str(tmp_path / "r.tsv"))
    assert obs.select("traj").distinct().count() == 2 and obs.count() == 40


def test_irregular_times_missing_values_and_parameters(spark, tmp_path):
    rng = np.random.default_rng(0)
    parts = []
    for case in range(2):
        t = np.sort(rng.uniform(0, 6, 200))
        t[0] = 0
        v = np.sin(t)
        v[[50, 51]] = np.nan
        parts.append(pd.DataFrame({"case": case, "time": t, "v": v, "omega": 1.0 + case, "const": 3.0}))
    pd.concat(parts).to_csv(tmp_path / "i.csv", index=False)
    obs, meta, _ = I.ingest(spark, str(tmp_path / "i.csv"))
    assert meta["variables"] == ["v"] and meta["layout"]["parameters"] == ["omega"] and meta["layout"]["constants"] == ["const"]
    got = obs.where("traj = 0").orderBy("step").toPandas()
    assert np.abs(got["v"] - np.sin(got["t"])).max() < 2e-2


def test_constants_table_is_refused(spark, tmp_path):
    pd.DataFrame({"G": [6.67], "R": [1.0]}).to_csv(tmp_path / "c.csv", index=False)
    with pytest.raises(ValueError, match="constants"):
        I.ingest(spark, str(tmp_path / "c.csv"))


def test_long_field_becomes_frames(spark, tmp_path):
    x, t = np.linspace(0, 1, 16, endpoint=False), np.arange(10) * 0.1
    g = [(0, a, b, np.sin(2 * np.pi * (b - a))) for a in t for b in x]
    pd.DataFrame(g, columns=["traj", "t", "x", "u"]).to_csv(tmp_path / "f.csv", index=False)
    frames, meta, _ = I.ingest(spark, str(tmp_path / "f.csv"))
    assert meta["kind"] == "pde" and frames.count() == 10 and len(frames.first()["u"]) == 16
    assert np.abs(np.array(frames.where("step = 3").first()["u"]) - np.sin(2 * np.pi * (x - 0.3))).max() < 1e-9


def test_names():
    assert R.sanitize_names(["I", "lambda", "S(t) [mol]", "sin", "p1", "I"]) == ["I", "lambda_", "S_t_mol", "sin_", "p1_", "I_"]


def test_array_files(spark, tmp_path):
    a = np.arange(24.0).reshape(2, 4, 3)
    np.savez(tmp_path / "d.npz", u=a, t=np.arange(4) * 0.5)
    arrays = R.read_file(spark, str(tmp_path / "d.npz"))
    rows = R.array_table(arrays, "u", "t", 1.0, "rtv").toPandas()
    assert len(rows) == 24 and rows[(rows.traj == 1) & (rows.step == 2) & (rows.variable == 1)]["value"].item() == a[1, 2, 1]
    assert set(rows["t"]) == {0.0, 0.5, 1.0, 1.5}
    with pytest.raises(R.UnsupportedFormat):
        R.read_file(spark, str(tmp_path / "d.xyz"))


def test_mat5(spark, tmp_path):
    """A file written by hand after the published layout: a 2 x 3 matrix of doubles and a text."""
    import struct

    def element(kind, raw):
        return struct.pack("<II", kind, len(raw)) + raw + bytes(-len(raw) % 8)

    def matrix(name, cls, shape, kind, raw):
        return element(14, element(6, bytes([cls, 0, 0, 0, 0, 0, 0, 0])) + element(5, struct.pack("<ii", *shape)) + element(1, name) + element(kind, raw))

    a = np.arange(6.0).reshape(2, 3)
    data = b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + matrix(b"Y", 6, (2, 3), 9, a.tobytes(order="F")) + matrix(b"s", 4, (1, 2), 2, b"ab")
    got = R.parse_mat5(data)
    assert (got["Y"] == a).all() and got["s"].tolist() == ["ab"]
    (tmp_path / "m.mat").write_bytes(data)
    assert R.read_file(spark, str(tmp_path / "m.mat")).count() == 6


def test_intuition(spark):
    s = SYSTEMS["pendulum"]
    out = intuit(simulate(spark, s, 4, noise=0.001), s.variables, s.dt)
    assert out["config"]["method"] == "strong" and {x["shape"] for x in out["facts"]["shapes"] if x["of"] == "theta"} <= {"sin", "cubic"}
    s = SYSTEMS["lotka_volterra"]
    out = intuit(simulate(spark, s, 3), s.variables, s.dt)
    assert out["config"]["degree"] == 2 and any("products" in h["hypothesis"] for h in out["hypotheses"])
    s = SYSTEMS["sir"]
    assert any("conserved" in h["hypothesis"] for h in intuit(simulate(spark, s, 2), s.variables, s.dt)["hypotheses"])


# --- array files and fields from end to end


def wave(n=32, nt=24, runs=1, seed=0):
    x, t = np.linspace(0, 2 * np.pi, n, endpoint=False), np.arange(nt) * 0.1
    return x, t, np.stack([np.sin(x[None, :] - t[:, None] + r) + 0.3 * np.cos(2 * (x[None, :] - t[:, None])) for r in range(runs)])


def test_npz_trajectories(spark, tmp_path):
    t = np.arange(40) * 0.05
    u = np.stack([np.stack([np.sin(t + r), np.cos(t + r)], axis=1) for r in range(3)])
    np.savez(tmp_path / "d.npz", Y=u, time=t)
    obs, meta, card = I.ingest(spark, str(tmp_path / "d.npz"))
    assert meta["kind"] == "ode" and meta["variables"] == ["Y0", "Y1"] and abs(meta["dt"] - 0.05) < 1e-12 and obs.count() == 120
    got = obs.where("traj = 2").orderBy("step").toPandas()
    assert np.allclose(got["Y1"], u[2, :, 1]) and any(a["what"] == "axes" for a in card.assumptions)
    np.save(tmp_path / "a.npy", u[0])
    obs, meta, _ = I.ingest(spark, str(tmp_path / "a.npy"), {"dt": 0.05, "axes": "tv"})
    assert obs.count() == 40 and abs(meta["dt"] - 0.05) < 1e-9


@pytest.mark.parametrize("noise", [0.0, 0.002])
def test_repeated_end_node_is_dropped_even_under_noise(spark, tmp_path, noise):
    x, t, u = wave()
    closed = np.concatenate([u, u[:, :, :1]], axis=2) + noise * np.random.default_rng(1).normal(size=(1, 24, 33))
    np.savez(tmp_path / "f.npz", u=closed[0], x=np.append(x, 2 * np.pi), t=t)
    frames, meta, _ = I.ingest(spark, str(tmp_path / "f.npz"))
    assert meta["boundary"] == "periodic" and meta["grid"]["x"]["n"] == 32 and abs(meta["grid"]["x"]["L"] - 2 * np.pi) < 1e-9
    assert frames.count() == 24 and len(frames.first()["u"]) == 32


def test_cut_window_is_not_periodic(spark, tmp_path):
    x, t, u = wave(64)
    np.savez(tmp_path / "f.npz", u=u[0][:, :41], x=x[:41], t=t)
    _, meta, _ = I.ingest(spark, str(tmp_path / "f.npz"))
    assert meta["boundary"] == "unknown" and meta["grid"]["x"]["n"] == 41
    _, meta, _ = I.ingest(spark, str(tmp_path / "f.npz"), {"boundary": "dirichlet"})
    assert meta["boundary"] == "dirichlet"


def test_two_dimensional_field(spark, tmp_path):
    x, y, t = np.linspace(0, 1, 16, endpoint=False), np.linspace(0, 2, 12, endpoint=False), np.arange(10) * 0.2
    u = np.sin(2 * np.pi * x)[None, :, None] * np.cos(np.pi * y)[None, None, :] * np.exp(-t)[:, None, None]
    np.savez(tmp_path / "g.npz", u=u, x=x, y=y, t=t)
    frames, meta, _ = I.ingest(spark, str(tmp_path / "g.npz"))
    assert meta["boundary"] == "periodic" and meta["spatial_dims"] == ["x", "y"] and [meta["grid"][d]["n"] for d in "xy"] == [16, 12]
    assert np.allclose(np.array(frames.where("step = 3").first()["u"]).reshape(16, 12), u[3])


def test_table_of_a_field_to_an_equation(spark, tmp_path):
    """Advection u_t = -u_x from a long table with a hole, through ingest, fit and rollout."""
    from fluxion.plans.discover import discover

    x, t, u = wave(32, 40)
    g = [(0, a, b, u[0, i, j]) for i, a in enumerate(t) for j, b in enumerate(x) if (i, j) != (7, 3)]
    pd.DataFrame(g, columns=["traj", "t", "x", "u"]).to_csv(tmp_path / "f.csv", index=False)
    out = discover(spark, str(tmp_path / "f.csv"))
    from fluxion.functions.expressions import parse

    assert out["verdict"]["status"] == "CONFIDENT IN PREDICTIONS" and abs(parse(out["rhs"]["u"]).coefficients()["u_x"] + 1) < 0.05
    assert any("missing" in w for w in out["card"].warnings)


def test_dates_as_text_are_time(spark, tmp_path):
    rows = pd.DataFrame({"when": [f"2024-01-{d:02d}T06:00:00" for d in range(1, 31)], "level": np.sin(np.arange(30) / 3)})
    rows.to_json(tmp_path / "d.json", orient="records")
    obs, meta, card = I.ingest(spark, str(tmp_path / "d.json"))
    assert abs(meta["dt"] - 86400) < 1e-6 and obs.count() == 30 and next(a for a in card.assumptions if a["what"] == "time column")["value"] == "when"


@pytest.mark.parametrize(("name", "base"), [("u_x", "u"), ("uxx", "u"), ("u_dot", "u"), ("uprime", "u"), ("u_deriv1", "u"), ("dudx", "u"), ("du_dt", "u"), ("ddu", "u"), ("dvel", "vel"), ("vel_t", "vel"), ("u", None), ("w", None)])
def test_names_of_derivatives(name, base):
    from fluxion.sources.arrays import derivative_of

    assert derivative_of(name, {"u", "vel", name}) == base
