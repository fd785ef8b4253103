"""Generated data sets, field scores, array inference, the way from a file to a verdict."""

from __future__ import annotations

import json

import numpy as np
import pytest

from fluxion.operators import assess, datasets, fields, symmetry, uncertainty
from fluxion.operators.simulate import simulate
from fluxion.operators.systems import SYSTEMS
from fluxion.plans.discover import discover, insights, to_json
from fluxion.sources import arrays
from fluxion.sources.ingest import Card
from fluxion.sources.readers import load_dataset


def test_generated_data_hide_the_truth(spark, tmp_path):
    meta = datasets.generate(spark, "lorenz", str(tmp_path), 0.01, train=2, test=1, t_end=1, blinded=True)
    df, seen = datasets.load(spark, str(tmp_path))
    assert seen == json.loads(json.dumps(meta)) and "lorenz" not in json.dumps(seen) and df.count() == 202
    assert load_dataset(spark, str(tmp_path / "hidden"))[1]["rhs"]


def test_experiment_goes_in_front(spark):
    s = SYSTEMS["lotka_volterra"]
    df = simulate(spark, s, 2, t_end=1)
    more = datasets.request_experiment(df, s, [5.0, 2.0], 0.0)
    assert more.select("traj").distinct().count() == 3 and abs(more.where("traj = 0 and step = 0").first()["x"] - 5.0) < 1e-9
    assert datasets.judge({"x": "1.1*x - 0.4*x*y", "y": "0.1*x*y - 0.41*y"}, s.rhs, ["x", "y"]) == "close"


def test_field_scores(spark):
    s = SYSTEMS["burgers"]
    frames = simulate(spark, s, 2, t_end=1)
    good = fields.evaluate_fields(frames, s, s.rhs)
    bad = fields.evaluate_fields(frames, s, {"u": "-u*u_x"})
    assert good["score"] > 5 > bad["score"] and fields.evaluate_fields(frames, s, {"u": "q"})["score"] == -10.0
    v = fields.validate_fields(frames, s, s.rhs, s.dt, 5, None)
    assert v["deriv_nrmse"] < 0.05 and not v["rollout_blew_up"]
    d = SYSTEMS["burgers_dirichlet"]
    v = fields.validate_fields(simulate(spark, d, 1, t_end=0.6), d, d.rhs, d.dt, 5, None)
    assert v["rollout_nrmse"] < 0.05
    c = fields.travelling_speed(simulate(spark, "kdv", 2, t_end=4), "u", 256, 40.0, 0.1)
    assert c["median"] > 0
    facts = fields.periodicity(frames, "u", 256)
    assert fields.decide_boundary(facts)["boundary"] == "periodic" and fields.spectrum(frames, s)["u"]["x"]["k_max"] > 2


def test_uneven_nodes(spark):
    x = np.linspace(0, 1, 30) ** 1.3
    df = spark.createDataFrame([(0, 0, 0.0, np.sin(3 * x).tolist())], "traj int, step int, t double, u array<double>")
    out, even = fields.uniform_space(df, x, ["u"])
    assert np.abs(np.array(out.first()["u"]) - np.sin(3 * even)).max() < 1e-4


def test_array_inference():
    t, x = np.arange(40) * 0.1, np.linspace(0, 1, 16, endpoint=False)
    u = np.sin(2 * np.pi * (x[None, :] - t[:, None]))
    card = Card()
    got = arrays.infer_arrays({"t": t[None, :], "x": x[:, None], "u": u.T[..., None] * np.ones(3), "u_x": u.T}, card)
    assert got["field"] == "u" and got["axes"] == "xtv" or got["axes"] == "xtr"
    assert arrays.canonical(np.zeros((3, 40, 16)), "rtx").shape == (3, 40, 16, 1)
    assert arrays.match_derivatives(u, 1 / 16, 0.1, {"a": np.gradient(u, 1 / 16, axis=1)})["a"][0] == "u_x"
    with pytest.raises(ValueError):
        arrays.infer_arrays({"t": t}, card)


def test_small_operators(spark):
    floor = uncertainty.noise_floor(["x"], {"x": 0.1}, 0.5)
    rng = np.random.default_rng(0)
    from fluxion.functions.numerics import savgol

    assert abs(savgol(0.1 * rng.normal(size=4000), 9, 3, 1, 0.5)[10:-10].std() - floor["x"]) < 0.01
    states = np.concatenate([rng.normal(0, 0.1, (400, 2)), rng.normal(5, 2, (40, 2))])
    assert (symmetry.balanced_sample(states, 100)[:, 0] > 1).mean() > 0.3
    s = SYSTEMS["lotka_volterra"]
    starts = simulate(spark, s, 2, t_end=0.5).where("step = 0")
    info = assess.coefficient_information(starts, s.rhs, {"x": 0.1, "y": 0.1}, np.arange(20) * 0.05)
    assert info.count() == 8 and assess.sensitivity(starts, s.rhs, np.arange(20) * 0.05).count() == 4
    assert len(assess.field_candidates(np.linspace(0, 1, 32), 1.0)) == 12


def test_from_data_to_verdict(spark, tmp_path):
    s = SYSTEMS["vanderpol"]
    out = discover(spark, simulate(spark, s, 3, noise=0.002, t_end=10), s.variables, s.dt, 2, str(tmp_path / "r.html"))
    assert datasets.judge(out["rhs"], s.rhs, ["x", "y"], 0.1) in ("equal", "close"), out["rhs"]
    assert out["verdict"]["status"] != "INCONCLUSIVE" and "<h2>Terms" in (tmp_path / "r.html").read_text()
    assert insights(out) and to_json(out)
