"""Symmetries, invariants, coordinates, uncertainty, assessment, lessons, streams; and the catalogue against DuckDB."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxion import catalogue
from fluxion.functions import numerics as N
from fluxion.functions.expressions import ExpressionError, equivalent, parse
from fluxion.operators import assess, coordinates, gram, library, memory, regression, symmetry, uncertainty, windows
from fluxion.operators.simulate import simulate
from fluxion.operators.skeleton import fit_skeleton, pareto_front
from fluxion.operators.systems import SYSTEMS
from fluxion.streaming import rates


@pytest.fixture(scope="module")
def lorenz(spark):
    df = simulate(spark, "lorenz", 4, noise=0.02).cache()
    df.count()
    yield df
    df.unpersist()


# --- symmetries and invariants


def test_hopf_has_a_rotation_and_lorenz_a_flip(spark):
    s = SYSTEMS["hopf"]
    found = symmetry.detect_symmetries(simulate(spark, s, 4), s.variables, s.dt, 3, 5)
    assert len(found["generators"]) == 1 and found["generators"][0]["name"].startswith("rotation")
    s = SYSTEMS["lorenz"]
    found = symmetry.detect_symmetries(simulate(spark, s, 3, t_end=5), s.variables, s.dt, 2, 5)
    assert not found["generators"] and [d["map"] for d in found["discrete"]] == ["(-x, -y, z)"]
    s = SYSTEMS["lotka_volterra"]
    found = symmetry.detect_symmetries(simulate(spark, s, 3), s.variables, s.dt, 2, 5)
    assert not found["generators"] and not found["discrete"]


def test_equivariant_dimensions(spark):
    free = lambda names, degree, gens, maps: N.null_space(symmetry.equivariance_constraints(library.build_library(names, degree), names, gens, maps)).shape[1]
    assert free(["x", "y"], 3, [symmetry.rotation_generator(0, 1, 2)], []) == 4
    assert free(["x", "y", "z"], 3, [], [np.diag([-1.0, -1.0, 1.0])]) == 30
    s = SYSTEMS["hopf"]
    out = symmetry.equivariant_sindy(simulate(spark, s, 3, noise=0.01), s.variables, s.dt, 3, [symmetry.rotation_generator(0, 1, 2)])
    assert out["free_parameters"] == 4 and max(out["error"].values()) < 0.2
    assert symmetry.field_symmetries({"u": "-6*u*u_x - u_xxx"}, ["u", "u_x", "u_xxx"]) == {"translation": True, "reflections": ["x -> -x"], "galilean": 6.0} or symmetry.field_symmetries({"u": "-6*u*u_x - u_xxx"}, ["u", "u_x", "u_xxx"])["galilean"] == 6.0


def test_sir_conserves_its_sum(spark):
    s = SYSTEMS["sir"]
    found = coordinates.find_invariants(simulate(spark, s, 4), s.variables, s.dt, degree=1, logs=False, window=5)["invariants"]
    first = parse(found[0]["H"], s.variables)
    got = first.coefficients()
    assert found[0]["kind"] == "constraint" and {"S", "I", "R"} == set(got) and np.ptp([got[v] for v in "SIR"]) < 0.02


def test_coordinates_there_and_back(spark):
    c = coordinates.make_coords("log", {"a": "log(x)", "b": "log(y)"}, ["x", "y"])
    s = SYSTEMS["lotka_volterra"]
    moved, error = coordinates.transform_data(simulate(spark, s, 1, t_end=5), c)
    assert error < 1e-9 and set(moved.columns) == {"traj", "step", "t", "a", "b"}
    back = coordinates.map_back(c, coordinates.map_forward(c, s.rhs))
    assert all(equivalent(back[v], s.rhs[v], ["x", "y"]) == "equal" for v in ("x", "y"))
    with pytest.raises(ValueError):
        coordinates.make_coords("mix", {"a": "x + y", "b": "x - y"}, ["x", "y"])
    p = coordinates.make_coords("polar", {"r": "sqrt(x**2 + y**2)", "q": "atan2(y, x)"}, ["x", "y"], {"x": "r*cos(q)", "y": "r*sin(q)"})
    moved, error = coordinates.transform_data(simulate(spark, "hopf", 1), p)
    turns = moved.agg(F.max("q") - F.min("q")).first()[0]
    assert error < 1e-9 and turns > 4 * np.pi


# --- uncertainty and assessment


def test_ensemble_keeps_true_terms(spark, lorenz):
    out = uncertainty.ensemble(lorenz, ["x", "y", "z"], 0.01, 2, 30, 9)
    truth = {("x", "x"), ("x", "y"), ("y", "x"), ("y", "y"), ("y", "x*z"), ("z", "x*y"), ("z", "z")}
    assert sum(out[v].get(t, {"inclusion": 0})["inclusion"] >= 0.9 for v, t in truth) >= 6
    assert all(r["inclusion"] < 0.3 for v in out for t, r in out[v].items() if (v, t) not in truth | {("z", "1")})


def test_the_truth_is_preferred(spark, lorenz):
    from fluxion.operators.sindy import features

    rows = features(lorenz, ["x", "y", "z"], 0.01)
    truth = SYSTEMS["lorenz"].rhs
    more = {**truth, "x": "10*(y - x) + 0.0001*x*y*z"}
    wrong = {**truth, "y": "x*(28 - z)"}
    out = uncertainty.compare_models(rows, {"wrong": wrong, "more": more, "truth": truth}, F.concat_ws("/", "traj", uncertainty.block_of("step", 1001)))
    assert out["preferred"] == "truth" and "wrong" not in out["indistinguishable"]


def test_assessment_and_verdict(spark):
    s = SYSTEMS["lotka_volterra"]
    df = simulate(spark, s, 3, noise=0.005, t_end=20)
    a = assess.assess(df, s.variables, s.dt, s.rhs, window=7)
    assert all(t["significant"] for t in a["terms"]) and len(a["terms"]) == 4
    assert assess.verdict(a)["status"] in ("CONFIDENT", "CONFIDENT IN PREDICTIONS", "COLLECT MORE DATA")
    assert assess.verdict({})["status"] == "INCONCLUSIVE"
    lesser = assess.assess(df, s.variables, s.dt, {**s.rhs, "y": "-0.4*y"}, window=7)
    assert any(m["term"] == "x*y" and m["var"] == "y" for m in lesser["missing_term_evidence"])


def test_repair_adds_what_is_missing():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = (2 * x[:, 0] - 3 * x[:, 3])[:, None] + 0.01 * rng.normal(size=(2000, 1))
    g = gram.of_arrays(x, y, list("abcde"), ["y"])
    assert uncertainty.repair(g, 0, [0, 1]) == [0, 3]
    assert [t for t in np.flatnonzero(regression.stlsq(g, 0, 0.05))] == [0, 3]
    assert next(iter(regression.forward_path(g, 0)))[0] == [3]


def test_skeleton_of_michaelis_menten(spark):
    s = SYSTEMS["michaelis_menten"]
    out = fit_skeleton(simulate(spark, s, 4), s.variables, {"s": "p0 - p1*s/(p2 + s)"}, s.dt, 5, 4000, 3)
    assert out["linear"] == ["p0", "p1"] and np.allclose([out["params"][p] for p in ("p0", "p1", "p2")], [0.6, 1.5, 0.3], rtol=0.05)
    front = pareto_front(spark.createDataFrame([("a", 1, 3.0), ("b", 2, 1.0), ("c", 3, 2.0), ("d", 4, 0.5)], "equation string, complexity int, loss double"))
    assert {r["equation"] for r in front.collect()} == {"a", "b", "d"}


# --- windows, lessons, streams


def test_smoothing_agrees_with_numpy(spark):
    rng = np.random.default_rng(1)
    u = rng.normal(size=(2, 40)).cumsum(axis=1)
    df = spark.createDataFrame([(k, i, float(u[k, i])) for k in range(2) for i in range(40)], "traj int, step int, u double")
    got = windows.smooth_and_differentiate(df, ["u"], 0.5, 9).orderBy("traj", "step").toPandas()
    for k in range(2):
        own = got[got.traj == k]
        assert np.allclose(own["u_s"], N.savgol(u[k], 9, 3)) and np.allclose(own["u_t"], N.savgol(u[k], 9, 3, 1, 0.5))


def test_fill_unwrap_append_halo(spark):
    df = spark.createDataFrame([(0, 0, None), (0, 1, 1.0), (0, 2, None), (0, 3, 3.0), (0, 4, None), (1, 0, None)], "traj int, step int, u double")
    assert [r["u"] for r in windows.fill_gaps(df, ["u"]).orderBy("traj", "step").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0, 0.0]
    angle = np.linspace(0, 30, 200)
    a = spark.createDataFrame([(0, i, float(np.angle(np.exp(1j * x)))) for i, x in enumerate(angle)], "traj int, step int, q double")
    got = windows.unwrap(a, "q", 2 * math.pi).orderBy("step").toPandas()["q"]
    assert np.allclose(got, np.unwrap(np.angle(np.exp(1j * angle))))
    joined = windows.append_trajectories(df.where("traj = 0"), spark.createDataFrame([(0, 0, 9.0), (0, 1, 9.0)], "traj int, step int, u double"))
    assert joined.count() == 4 and joined.where("traj = 0").first()["u"] == 9.0
    halo = windows.with_halo(df.where("traj = 0"), 2, 1)
    assert halo.where("own").count() == 5 and halo.count() == 9


def test_lessons(spark):
    kept = memory.add_lessons([], ["use the weak form for noisy data", "use the weak form for very noisy data", "smooth first"])
    assert kept == ["use the weak form for noisy data", "smooth first"]
    rows = spark.createDataFrame([("a", "ode", 3, 0.01, 0, None, True), ("b", "pde", 1, 0.01, 1, "periodic", False)], "lesson string, kind string, n_vars int, noise double, dims int, boundary string, good boolean")
    assert memory.retrieve(rows, memory.fingerprint("ode", 3, 0.01), 1).first()["lesson"] == "a"


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    events = spark.read.parquet(str(tmp_path / "in"))
    q = rates.start(rates.tumbling(rates.read_stream(spark, str(tmp_path / "in"), events, 1), "1 day", "ts", ["event_type"], "value", "400 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(60)
    assert rates.sessions(events, "1 hour", "ts", ["user_id"]).agg(F.sum("n")).first()[0] == events.count()
    batch = rates.tumbling(events, "1 day", "ts", ["event_type"], "value")
    assert spark.read.parquet(str(tmp_path / "out")).count() <= batch.count()


# --- expressions


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(0, 3), st.integers(0, 2)), min_size=1, max_size=5), st.floats(0.2, 2), st.floats(0.2, 2))
def test_expressions_agree_with_python(parts, x, y):
    text = " + ".join(f"({c})*x**{i}*sin(y)**{j}" for c, i, j in parts)
    e = parse(text, ["x", "y"])
    value = float(e.numpy()({"x": np.float64(x), "y": np.float64(y)}))
    want = sum(c * x**i * math.sin(y) ** j for c, i, j in parts)
    assert math.isclose(value, want, rel_tol=1e-9, abs_tol=1e-9)
    assert parse(e.text(), ["x", "y"]) == e
    h = 1e-6
    slope = (float(e.numpy()({"x": x + h, "y": y})) - float(e.numpy()({"x": x - h, "y": y}))) / (2 * h)
    assert math.isclose(float(e.diff("x").numpy()({"x": x, "y": y})), slope, rel_tol=1e-4, abs_tol=1e-4)


@pytest.mark.parametrize("text", ["__import__('os')", "x.y", "[x]", "lambda: x", "q + 1", "open('f')", "x if y else x", "x @ y"])
def test_expressions_refuse_code(text):
    with pytest.raises(ExpressionError):
        parse(text, ["x", "y"])


@settings(max_examples=20, deadline=None)
@given(st.integers(2, 6), st.integers(1, 40))
def test_gram_does_not_depend_on_partitions(p, seed):
    rng = np.random.default_rng(seed)
    a, y = rng.normal(size=(50, p)), rng.normal(size=(50, 1))
    whole = gram.of_arrays(a, y, list("abcdef")[:p], ["y"])
    cut = rng.integers(1, 49)
    both = gram.of_arrays(a[:cut], y[:cut], whole.terms, ["y"]) + gram.of_arrays(a[cut:], y[cut:], whole.terms, ["y"])
    assert np.allclose(whole.xx, both.xx, rtol=1e-9) and np.allclose((whole - both).xy, 0, atol=1e-9)


# --- catalogue


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    assert sorted(a.columns) == sorted(b.columns)
    text = lambda v: "None" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = lambda d: sorted(tuple(text(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    return rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_catalogue_against_duckdb(spark, data, name):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    assert same(catalogue.queries()[name](spark, data).toPandas(), c.sql(catalogue.oracle_sql()[name]).df())


# --- what caps used to hide


def test_dominant_mode_beyond_64(spark):
    from fluxion.operators.diagnostics import diagnose

    n, k = 1000, 200
    df = spark.createDataFrame([(0, i, i * 0.1, float(np.sin(2 * np.pi * k * i / n))) for i in range(n)], "traj int, step int, t double, u double")
    found = diagnose(df, ["u"], 0.1)["oscillation"]["u"]
    assert abs(found["period"] - n * 0.1 / k) < 1e-9 and found["share"] > 0.99


def test_predictability_looks_at_the_whole_span(spark):
    """Two models that part only after 300 of 500 steps."""
    start = spark.createDataFrame([(0, 1.0)], "traj int, x double")
    t = np.arange(500) * 0.1
    out = assess.predictability(start, {"a": {"x": "0.0*x"}, "b": {"x": "0.001"}}, {"x": 0.005}, t)
    assert 29 < out["horizon"] < 31 and not out["horizon_is_full_data_span"]
    short = simulate(spark, "lotka_volterra", 2, t_end=15)
    a = assess.assess(short, ["x", "y"], 0.05, SYSTEMS["lotka_volterra"].rhs, {"near": {"x": "1.1*x - 0.4001*x*y", "y": "-0.4*y + 0.1*x*y"}}, window=7)
    assert a["predictability"]["horizon"] > 200 * 0.05 or not a["predictability"]["horizon_is_full_data_span"]


def test_quantiles_agree_with_numpy(spark):
    from fluxion.operators.quantiles import median, quantiles

    rng = np.random.default_rng(3)
    x, y = rng.lognormal(0, 4, 5000), rng.integers(0, 3, 5000).astype(float)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y, strict=True)] + [(None, 1.0, None)], "x double, y double, z double").repartition(3)
    shares = [0, 0.01, 0.25, 0.5, 0.9, 1]
    for few, bins in ((100_000, 8192), (50, 64)):
        got = quantiles(df, ["x", "y", "z"], shares, few, bins)
        assert np.allclose(got["x"], np.quantile(x, shares)) and np.allclose(got["y"], np.quantile([*y, 1.0], shares)) and got["z"] == [None] * 6
    assert median(df, F.col("x") * 2) == pytest.approx(2 * np.median(x))


def test_many_trajectories_reach_the_driver_as_one_matrix(spark, monkeypatch):
    """Ten thousand trajectories: what comes to the driver doesn't grow with them."""
    rows = spark.range(40_000).selectExpr("cast(id div 4 as int) as traj", "cast(id % 4 as int) as step", "cast(id div 4 as double) % 7 as a", "cast(id % 4 as double) as b")
    every, inner = gram.within(rows, {"a": F.col("a"), "b": F.col("b")}, F.col("traj"))
    assert every.n == 40_000 and abs(inner[1, 1]) < 1e-6 and inner[2, 2] == pytest.approx(10_000 * 5.0)
    found = gram.grams(rows, {"a": F.col("a")}, {"b": F.col("b")}, gram.grouped("traj", "step"))
    assert len(found) <= gram.GROUPS and sum(g.n for g in found.values()) == 40_000


def test_chunks_with_halo_change_nothing(spark):
    rng = np.random.default_rng(4)
    u = rng.normal(size=200).cumsum()
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(u)], "traj int, step int, u double")
    for method in ("savgol", "fd"):
        whole, cut = (windows.smooth_and_differentiate(df, ["u"], 0.5, 9, method=method, chunk=c).orderBy("step").toPandas() for c in (1 << 16, 16))
        assert np.allclose(whole, cut)


def test_shapes_are_told_apart(spark):
    from fluxion.operators.diagnostics import shape_in, shape_of

    x = np.linspace(0.1, 5, 40)
    for name, y in {"linear": 2 * x - 1, "quadratic": x**2, "cubic": x**3 - x, "sin": np.sin(x), "saturating": 3 * x / (0.5 + x)}.items():
        assert shape_of(x, y)["shape"] == name, name
    df = spark.createDataFrame([(float(a), float(3 * a / (0.5 + a))) for a in x], "x double, y double")
    assert shape_in(df, "x", "y")["shape"] == "saturating"


def test_assessment_turns_to_the_weak_form_under_noise(spark):
    s = SYSTEMS["lotka_volterra"]
    df = simulate(spark, s, 3, noise=0.05, t_end=20)
    a = assess.assess(df, s.variables, s.dt, s.rhs)
    assert a["basis"] == "weak form" and sum(t["significant"] for t in a["terms"]) >= 3 and len(a["removal_evidence"]) == 4
    text = assess.brief_markdown(a)
    assert text.startswith(f"# {assess.verdict(a)['status']}") and "| x | `x` |" in text
    assert assess.refit_disagreement([{"coef": 1.0, "given": 2.0}, {"coef": 3.0, "given": None}]) == pytest.approx(0.5)
    assert assess.use_weak({"noise_rel": {"u": 0.01}, "change_per_step": {"u": 0.1}}, "pde") and not assess.use_weak({"noise_rel": {"u": 0.01}, "change_per_step": {"u": 0.1}})


def test_cross_validation_modes_refuse_what_is_missing():
    g = {k: gram.of_arrays(np.eye(2) + k, np.ones((2, 1)), ["a", "b"], ["y"]) for k in range(2)}
    for mode in ("fitter", "other"):
        with pytest.raises(ValueError):
            uncertainty.cross_validate(g, 0, mode)


def test_arms_against_cases(spark):
    from fluxion.plans.benchmark import ARMS, run_arms

    def fails(df, variables, dt):
        raise ValueError("nothing found")

    got = {r["arm"]: r for r in run_arms(spark, [{"system": "lotka_volterra", "noise": 0.0}, {"system": "kdv", "noise": 0.0}], {"plain": ARMS["plain"], "fails": fails}, t_end=10).collect()}
    assert set(got) == {"plain", "fails"} and got["fails"]["score"] == -10.0 and got["plain"]["f1"] > 0.5


def test_ways_follow_the_facts():
    from fluxion.plans.discover import pick_ways

    facts = {"ranges": {"x": (-1.0, 1.0)}, "noise_rel": {"x": 0.001}}
    assert pick_ways({"facts": facts, "config": {"custom": []}}, 2) == ["terms", "functions"]
    assert pick_ways({"facts": facts, "config": {"custom": ["sin(x)"]}}, 1) == ["functions"]
    assert pick_ways({"facts": facts | {"sum_variation": 0.0}, "config": {"custom": []}}, 1) == ["coordinates"]
