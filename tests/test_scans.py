"""Long trajectories in chunks against one window or spline over everything, fields over two axes, and facts that are no registered queries."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from tests.test_models import same

from fluxion import catalogue
from fluxion.functions import numerics as N
from fluxion.operators import fields, windows
from fluxion.sources import ingest as I
from fluxion.sources import readers as R


@pytest.mark.parametrize("name", sorted(catalogue.FACTS))
def test_facts(spark, data, name):
    f, sql = catalogue.FACTS[name]
    got = f(spark, data).toPandas()
    c = duckdb.connect()
    for t in ("nation", "events", "orders", "lineitem", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    assert same(got, c.sql(sql).df()) if sql else len(got)


def test_every_registered_query_reads_a_table(spark, data):
    assert not set(catalogue.FACTS) & set(catalogue.queries())


def rows_of(spark, n=5000, keys=2):
    rng = np.random.default_rng(3)
    out = []
    for k in range(keys):
        angle = np.cumsum(rng.normal(0, 90, n))
        u = np.where(rng.random(n) < 0.02, rng.normal(0, 1, n), np.nan)
        u[: n // 3] = np.nan
        out.append(pd.DataFrame({"traj": k, "step": np.arange(n), "angle": angle % 360, "u": u, "v": np.nan if k else 1.0, "t": np.sort(rng.random(n)) * 7}))
    return pd.concat(out), spark.createDataFrame(pd.concat(out).sample(frac=1, random_state=1).replace({np.nan: None}), "traj int, step int, angle double, u double, v double, t double")


@pytest.mark.parametrize("chunk", [7, 100, 100_000])
def test_unwrap_by_chunks(spark, chunk):
    pdf, df = rows_of(spark)
    got = windows.unwrap(df, "angle", 360.0, chunk=chunk).toPandas().sort_values(["traj", "step"])
    for k, g in got.groupby("traj"):
        assert np.allclose(g["angle"], np.unwrap(pdf[pdf.traj == k]["angle"], period=360.0), atol=1e-8)
    assert list(got.columns) == df.columns


@pytest.mark.parametrize("by", ["step", "t"])
@pytest.mark.parametrize("chunk", [7, 100_000])
def test_fill_gaps_by_chunks(spark, by, chunk):
    pdf, df = rows_of(spark, 800)
    got = windows.fill_gaps(df, ["u", "v"], by=by, chunk=chunk).toPandas().sort_values(["traj", "step"])
    for k, g in got.groupby("traj"):
        own = pdf[pdf.traj == k]
        known = own["u"].notna()
        assert np.allclose(g["u"], np.interp(own[by], own[by][known], own["u"][known]))
        assert (g["v"] == (0.0 if k else 1.0)).all()
    assert windows.without_values(df, ["u", "v"]) == {"u": 0, "v": 1}


def test_rows_numbered_by_chunks(spark):
    pdf, df = rows_of(spark, 900)
    got = windows.numbered(df.drop("step"), "t", chunk=13).toPandas().sort_values(["traj", "t"])
    assert (got.groupby("traj")["step"].apply(list).apply(lambda x: x == list(range(900)))).all() and len(got) == 1800


def test_elapsed_by_parts(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet").select("user_id", "ts", "event_id")
    whole, parts = (windows.elapsed(e, "ts", ("ts", "event_id"), 60.0, ("user_id",), salts=s).toPandas().set_index("event_id")["t"].sort_index() for s in (0, 5))
    assert np.allclose(whole, parts) and windows.elapsed(e, "ts", ("ts",)).agg({"t": "min"}).first()[0] == 0


def test_long_trajectory_is_many_tasks(spark):
    df = spark.range(0, 300_000, 1, 8).selectExpr("0 AS traj", "cast(id AS int) AS step", "cast(id * 97 % 360 AS double) AS angle", "if(id % 1000 = 0, cast(id AS double), null) AS u")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = windows.unwrap(df, "angle", 360.0, chunk=10_000).rdd.glom().map(len).collect()
        assert sum(parts) == 300_000 and max(parts) < 200_000 and sum(p > 0 for p in parts) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("chunk", [50, 64, 777])
def test_spline_in_chunks_is_the_whole_spline(spark, chunk):
    rng = np.random.default_rng(4)
    out = []
    for k, n in ((0, 1000), (1, 1501), (2, 30), (3, 2)):
        t = np.cumsum(rng.choice([0.01, 0.1, 0.5], n)) - 3
        out.append(pd.DataFrame({"traj": k, "t": t, "u": np.sin(t), "v": rng.normal(0, 1, n)}))
    pdf = pd.concat(out)
    got = I.splined(spark.createDataFrame(pdf, "traj int, t double, u double, v double"), ["u", "v"], 0.07, chunk).toPandas().sort_values(["traj", "step"])
    for k, g in got.groupby("traj"):
        own = pdf[pdf.traj == k]
        t = own["t"].to_numpy()
        at = t[0] + 0.07 * np.arange(int((t[-1] - t[0]) / 0.07 + 1e-9) + 1)
        assert g["step"].tolist() == list(range(len(at)))
        for v in "uv":
            assert np.abs(g[v].to_numpy() - N.not_a_knot(t, own[v].to_numpy())(at)).max() < 1e-9


def plane(tmp_path, holes=False, uneven=False, again=False):
    """A file of 2 trajectories x 20 times x 8 x 6 nodes, rows shuffled: u = waves, w = an index that tells cells apart."""
    x, y = np.linspace(0, 1, 8, endpoint=False), np.linspace(0, 3, 6, endpoint=False)
    if uneven:
        y = y + 0.2 * np.sin(y)
    rows = [(r, s * 0.1, a, b, np.sin(2 * np.pi * a - s * 0.1) * np.cos(2 * np.pi * b / 3) + r, 1000.0 * s + 10 * i + j + 1e5 * r) for r in range(2) for s in range(20) for i, a in enumerate(x) for j, b in enumerate(y)]
    df = pd.DataFrame(rows, columns=["run", "t", "x", "y", "u", "w"]).sample(frac=1, random_state=2)
    if holes:
        df = df.drop(df.index[(df.t == 0.5) & (df.x == x[3]) & (df.run == 1)])
    if again:
        df = pd.concat([df, df.iloc[:5]])
    df.to_csv(tmp_path / "p.csv", index=False)
    return str(tmp_path / "p.csv"), x, y


def test_two_axes_of_a_long_table(spark, tmp_path):
    path, x, y = plane(tmp_path)
    frames, meta, card = I.ingest(spark, path)
    assert meta["spatial_dims"] == ["x", "y"] and meta["grid"]["x"]["n"] == 8 and meta["grid"]["y"]["n"] == 6 and frames.count() == 40
    for r in frames.collect():
        assert np.allclose(np.reshape(r["w"], (8, 6)), 1000.0 * r["step"] + 10 * np.arange(8)[:, None] + np.arange(6) + 1e5 * r["traj"])
    assert not any("cells" in w or "rows share" in w for w in card.warnings)


def test_two_axes_with_holes_and_doubled_rows(spark, tmp_path):
    frames, _, card = I.ingest(spark, plane(tmp_path, holes=True)[0])
    w = np.reshape(frames.where("traj = 1 and step = 5").first()["w"], (8, 6))
    assert np.allclose(w, 5000.0 + 10 * np.arange(8)[:, None] + np.arange(6) + 1e5) and any("12 missing cells" in x for x in card.warnings)
    _, _, card = I.ingest(spark, plane(tmp_path, again=True)[0])
    assert any(x.startswith("5 rows share") for x in card.warnings)


def test_two_axes_uneven(spark, tmp_path):
    _, x, y = plane(tmp_path)
    nodes = [x + 0.02 * np.sin(6 * x), y + 0.1 * np.cos(y)]
    cubic = lambda a, b: a[:, None] ** 3 - 2 * a[:, None] * b + b**2
    frames = spark.createDataFrame([(0, 0, cubic(*nodes).ravel().tolist())], "traj int, step int, u array<double>")
    out, even = fields.uniform_plane(frames, nodes, ["u"])
    assert np.allclose(np.reshape(out.first()["u"], (8, 6)), cubic(*even))


def test_three_axes_are_refused(spark, tmp_path):
    rows = [(t, a, b, c, t + a + b + c) for t in range(4) for a in range(3) for b in range(3) for c in range(3)]
    pd.DataFrame(rows, columns=["t", "x", "y", "z", "u"]).to_csv(tmp_path / "v.csv", index=False)
    with pytest.raises(ValueError, match="two axes at most"):
        I.ingest(spark, str(tmp_path / "v.csv"))


def test_fields_that_differ_in_boundary_make_it_unknown():
    yes, no = {"boundary": "periodic", "drop_end": False, "confidence": "high", "why": ""}, {"boundary": "dirichlet", "drop_end": False, "confidence": "high", "why": ""}
    assert I._common_boundary([yes, no])["boundary"] == "unknown" and I._common_boundary([yes, yes | {"confidence": "low"}])["confidence"] == "low"


def test_dataset_folders_are_read(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 0.0, 1.5)], "traj int, step int, t double, u double")
    R.write_dataset(df, str(tmp_path / "set"), {"kind": "ode"})
    assert R.read_file(spark, str(tmp_path / "set")).first()["u"] == 1.5


def test_files_of_a_dataset_do_not_grow_with_its_trajectories(spark, tmp_path):
    df = spark.range(600).selectExpr("id div 2 as traj", "cast(id % 2 as int) as step", "id * 0.5 as u").repartition(3)
    R.write_dataset(df, str(tmp_path / "set"), {"kind": "ode"})
    assert len(list((tmp_path / "set" / "data").rglob("*.parquet"))) <= 3
    back, meta = R.load_dataset(spark, str(tmp_path / "set"))
    assert meta == {"kind": "ode"} and sorted(map(tuple, back.select("traj", "step", "u").collect())) == [(i // 2, i % 2, i * 0.5) for i in range(600)]


def test_gaps_are_filled_without_frames_to_the_end(spark):
    """A frame that ends at the last row is filled anew for every row, which is quadratic in a chunk."""
    rows = [(k, i, None if (i * 7 + k) % 5 else float(i * i)) for k in (0, 1) for i in range(40)] + [(2, i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "traj int, step int, u double")
    filled = windows.fill_gaps(df, ["u"], chunk=8)
    assert "unboundedfollowing" not in filled._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {(r["traj"], r["step"]): r["u"] for r in filled.collect()}
    for k in (0, 1):
        known = [(i, u) for t, i, u in rows if t == k and u is not None]
        want = np.interp(range(40), *zip(*known, strict=True))
        assert np.allclose([got[k, i] for i in range(40)], want)
    assert got[2, 1] == 0.0


def test_inspection_makes_no_row_for_each_distinct_count(spark):
    df = spark.createDataFrame([(1, 0.0, "b", [1], {"k": 1}), (None, -0.0, "a", [1], None), (1, float("nan"), None, None, {"k": 2})], "n int, `x.y` double, s string, l array<int>, m map<string,int>")
    found = R.inspect(df)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["name"]: (r["type"], r["rows"], r["nulls"], r["n_unique"], r["least"], r["example"]) for r in found.collect()}
    assert list(got) == df.columns and got["n"] == ("int", 3, 1, 1, 1.0, None) and got["x.y"] == ("double", 3, 0, 2, 0.0, None)
    assert got["s"] == ("string", 3, 1, 2, None, "a") and got["l"][:4] == ("array<int>", 3, 1, 1) and got["m"][:4] == ("map<string,int>", 3, 1, None)
    assert [r["rows"] for r in R.inspect(df.where("false")).collect()] == [0] * 5
