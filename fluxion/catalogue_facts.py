"""Operators whose results are known from elsewhere: closed forms, exact solutions, facts of the mathematics, round trips. Those that read the
given tables are registered queries; facts on fixed or simulated input are run by the tests only.

Every SQL text states the expected result on its own; none is made by the code under test.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import OBS, W, fact, query, table, trajectories
from .functions import expressions as X
from .functions import numerics as N
from .operators import assess, coordinates, datasets, diagnostics, field_symmetry, fields, gram, library, memory, regression, scoring, symmetry, systems, uncertainty, weakform, windows
from .operators.simulate import blind, derivatives, simulate
from .operators.systems import SYSTEMS, System
from .sources import arrays, ingest, readers
from .sources.storage import shared_folder, write_bytes


def rows(spark: SparkSession, schema: str, values: list[tuple]) -> DataFrame:
    return spark.createDataFrame(values, schema)


# --- readers and sinks: what is written comes back


def _scratch(spark: SparkSession) -> str:
    """A new folder, in the shared one if the session names it."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _written(df: DataFrame, how: str, name: str | None = None, **options) -> str:
    path = f"{_scratch(df.sparkSession)}/{name or f'part.{how}'}"
    df.coalesce(1).write.options(**options).format("csv" if how == "tsv" else how).save(path)
    return path


_NATION = "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation"


def _nation(df: DataFrame) -> DataFrame:
    return df.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("read_csv", _NATION)
def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation(readers.read_file(spark, _written(_nation(table(spark, sf_dir, "nation")), "csv", header=True)))


@query("read_tsv", _NATION)
def read_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation(readers.read_file(spark, _written(_nation(table(spark, sf_dir, "nation")), "tsv", header=True, sep="\t")))


@query("read_json", _NATION)
def read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation(readers.read_file(spark, _written(_nation(table(spark, sf_dir, "nation")), "json", name="part.jsonl")))


@query("read_npz", "SELECT CAST(n_nationkey AS INTEGER) AS traj, CAST(k AS INTEGER) AS step, CAST(k * 0.5 AS DOUBLE) AS t, CAST(n_nationkey * 10 + k AS DOUBLE) AS value FROM nation, (SELECT unnest(range(0, 4)) AS k)")
def read_npz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' keys as an array of trajectories, saved as NPZ, read by tasks and put into long form by its axes."""
    keys = sorted(r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect())  # 25 nations
    path, data = f"{_scratch(spark)}/d.npz", io.BytesIO()
    np.savez(data, u=np.array(keys)[:, None] * 10.0 + np.arange(4), t=np.arange(4) * 0.5)
    write_bytes(spark, path, data.getvalue())
    return readers.array_table(readers.read_file(spark, path), "u", "t", 1.0, "rt").select("traj", "step", "t", "value")


@query("dataset_round_trip", f"WITH {OBS} SELECT traj, CAST(step AS INTEGER) AS step, round(u, 6) AS u FROM obs")
def dataset_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_scratch(spark)}/set"
    readers.write_dataset(trajectories(spark, sf_dir), path, {"kind": "ode"})
    back, meta = readers.load_dataset(spark, path)
    assert meta == {"kind": "ode"}
    return back.select(F.col("traj").cast("long").alias("traj"), F.col("step").cast("int").alias("step"), F.round("u", 6).alias("u"))


# --- layout of tables and arrays


@query("numeric_coercion", "SELECT CAST(o_orderkey AS DOUBLE) AS digits, o_orderstatus AS letters, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) END AS mostly FROM orders")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that reads as numbers in 98 % of the rows is a number; letters stay."""
    o = table(spark, sf_dir, "orders")
    text = o.select(F.col("o_orderkey").cast("string").alias("digits"), F.col("o_orderstatus").alias("letters"), F.when(F.col("o_orderkey") % 50 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("mostly"))
    return ingest.numeric_columns(text)


@query(
    "table_layout",
    "SELECT * FROM (VALUES ('kind', 'ode'), ('time', 'stamp'), ('trajectory', 'run'), ('variable', 'value'), ('parameter', 'size'), ('constant', 'always')) AS v(role, name)",
)
def table_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "value", F.lit(7).alias("always"), (F.col("user_id") % 5).alias("size"), "event_type")
    _, found = ingest.detect_layout(e, ingest.Card(), {"rename": {"user_id": "run", "ts": "stamp"}, "drop": ["event_type"]})
    many = [("variable", v) for v in found.variables] + [("parameter", v) for v in found.parameters] + [("constant", v) for v in found.constants] + [("space", v) for v in found.space]
    return rows(spark, "role string, name string", [("kind", found.kind), ("time", found.time), ("trajectory", found.trajectory), *many])


@query(
    "table_to_trajectories",
    "WITH d AS (SELECT user_id AS traj, date_trunc('day', ts) AS day, avg(value) AS u FROM events GROUP BY 1, 2) "
    "SELECT CAST(traj AS INTEGER) AS traj, CAST(row_number() OVER (PARTITION BY traj ORDER BY day) - 1 AS INTEGER) AS step, round(u, 6) AS u FROM d",
)
def table_to_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as time, several rows of a day averaged, steps numbered."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6).cast("double").alias("time"), F.col("value").alias("u"))
    df, found = ingest.detect_layout(e, ingest.Card())
    return ingest.to_trajectories(df, found).select("traj", "step", F.round("u", 6).alias("u"))


@query(
    "regular_resample",
    f"""WITH {OBS}, s AS (SELECT traj, t - lag(t) OVER w AS d FROM obs {W}), m AS (SELECT traj, median(d) AS m FROM s WHERE d IS NOT NULL GROUP BY 1), h AS (SELECT median(m) AS dt FROM m),
n AS (SELECT traj, CAST(floor((max(t) - min(t)) / dt + 1e-9) AS BIGINT) + 1 AS n, dt FROM obs, h GROUP BY traj, dt), k AS (SELECT min(n) AS k FROM n)
SELECT CAST(traj AS INTEGER) AS traj, CAST(step AS INTEGER) AS step, round(step * dt, 5) AS t, round(2 * step * dt + 1, 4) AS u FROM n, k, LATERAL (SELECT unnest(range(0, k)) AS step)""",
)
def regular_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uneven times, values on a line: a spline through them gives the line at even times."""
    line = trajectories(spark, sf_dir).select(F.col("traj").cast("int").alias("traj"), "step", "t", (2 * F.col("t") + 1).alias("u"))
    return ingest.regular_time(line, ["u"])[0].select("traj", "step", F.round("t", 5).alias("t"), F.round("u", 4).alias("u"))


@fact("names_sanitized", "SELECT * FROM (VALUES (0, 'I'), (1, 'lambda_'), (2, 'S_t_mol'), (3, 'sin_'), (4, 'p1_'), (5, 'I_'), (6, 'v2nd')) AS v(place, name)")
def names_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "place int, name string", list(enumerate(readers.sanitize_names(["I", "lambda", "S(t) [mol]", "sin", "p1", "I", "2nd"]))))


@fact("derivative_names", "SELECT * FROM (VALUES ('u_x', 'u'), ('uxx', 'u'), ('u_dot', 'u'), ('uprime', 'u'), ('dudx', 'u'), ('ddu', 'u'), ('vel_t', 'vel'), ('w', NULL)) AS v(name, base)")
def derivative_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["u_x", "uxx", "u_dot", "uprime", "dudx", "ddu", "vel_t", "w"]
    return rows(spark, "name string, base string", [(n, arrays.derivative_of(n, {"u", "vel", n})) for n in names])


@fact("array_roles", "SELECT * FROM (VALUES ('runs', 'Y', 'time', 'rtv'), ('field', 'u', 't', 'tx'), ('turned', 'u', 't', 'xtr'), ('plane', 'u', 't', 'txy')) AS v(case_, field, time, axes)")
def array_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, x, y, a = np.arange(40.0), np.linspace(0, 1, 32), np.linspace(0, 2, 24), np.zeros
    cases = {
        "runs": {"Y": a((9, 40, 3)), "time": t}, "field": {"u": a((40, 32)), "u_x": a((40, 32)), "t": t, "x": x}, "turned": {"u": a((32, 40, 9)), "t": t[None], "x": x[:, None]},
        "plane": {"u": a((40, 32, 24)), "t": t, "x": x, "y": y},
    }
    found = {k: arrays.infer_arrays(v, ingest.Card()) for k, v in cases.items()}
    return rows(spark, "case_ string, field string, time string, axes string", [(k, r["field"], r["time"], r["axes"]) for k, r in found.items()])


@fact("canonical_shapes", "SELECT * FROM (VALUES ('tx', '1,4,5,1'), ('xtr', '6,5,4,1'), ('vt', '1,5,4')) AS v(axes, shape)")
def canonical_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = {"tx": (4, 5), "xtr": (4, 5, 6), "vt": (4, 5)}
    return rows(spark, "axes string, shape string", [(k, ",".join(map(str, arrays.canonical(np.zeros(s), k).shape))) for k, s in shapes.items()])


@fact("given_derivatives", "SELECT * FROM (VALUES ('a', 'u_x'), ('b', 'u_t'), ('c', 'u_xx'), ('d', NULL)) AS v(name, what)")
def given_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of sin(x - t): its derivatives by hand, and an array that is none."""
    x, t = np.linspace(0, 2 * np.pi, 200)[None, :], np.linspace(0, 1, 100)[:, None]
    u = np.sin(2 * x - t)
    given = {"a": 2 * np.cos(2 * x - t), "b": -np.cos(2 * x - t), "c": -4 * u, "d": np.cos(7 * x) + 0 * t}
    found = arrays.match_derivatives(u, float(x[0, 1]), float(t[1, 0]), given)
    return rows(spark, "name string, what string", [(k, found[k][0] if k in found else None) for k in given])


# --- grids, seams, boundaries

_WAVE = "(SELECT n_nationkey AS s, i, sin(2 * pi() * i / 16 + n_nationkey) + 0.1 * i AS u FROM nation, (SELECT unnest(range(0, 16)) AS i))"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj, step, t, u (16 nodes) of every nation: a wave on a ramp."""
    u = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.sin(2 * np.pi * i / 16 + F.col("n_nationkey")) + 0.1 * i)
    return table(spark, sf_dir, "nation").select(F.lit(0).alias("traj"), F.col("n_nationkey").cast("int").alias("step"), F.col("n_nationkey").cast("double").alias("t"), u.alias("u"))


@query(
    "seam_facts",
    f"""WITH r AS {_WAVE}, p AS (SELECT a.s, a.i, a.u, b.u AS n, c.u AS nn FROM r a LEFT JOIN r b ON a.s = b.s AND b.i = a.i + 1 LEFT JOIN r c ON a.s = c.s AND c.i = a.i + 2),
e AS (SELECT s, max(u) FILTER (i = 0) AS a0, max(u) FILTER (i = 1) AS a1, max(u) FILTER (i = 14) AS z1, max(u) FILTER (i = 15) AS z0 FROM r GROUP BY 1),
q AS (SELECT sqrt(avg((n - u) ** 2)) AS d1, sqrt(avg((nn - 2 * n + u) ** 2)) AS d2 FROM p)
SELECT round(sqrt(avg(((z1 - 2 * z0 + a0) ** 2 + (z0 - 2 * a0 + a1) ** 2) / 2)) / max(d2), 8) AS wrap, round(sqrt(avg((z0 - a0) ** 2)) / max(d1), 8) AS end_difference,
round(sqrt(avg((a1 - 2 * a0 + z1) ** 2)) / max(d2), 8) AS end_bend, round(sqrt(avg(((a1 - a0) ** 2 + (z0 - z1) ** 2) / 2)) / max(d1), 8) AS edge_activity FROM e, q""",
)
def seam_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields.periodicity(_frames(spark, sf_dir), "u")
    names = ("wrap", "end_difference", "end_bend", "edge_activity")
    return rows(spark, ", ".join(f"{n} double" for n in names), [tuple(round(f[n], 8) for n in names)])


@fact(
    "boundary_kinds",
    "SELECT * FROM (VALUES (0, 'periodic', true, 'high'), (1, 'periodic', false, 'high'), (2, 'periodic', false, 'medium'), (3, 'periodic', false, 'medium'), (4, 'unknown', false, 'medium'), (5, 'neumann', false, 'high')) AS v(k, boundary, dropped, confidence)",
)
def boundary_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = {"wrap": 1.0, "end_difference": 1.0, "end_bend": 1.0, "leakage": 1.0, "edge_activity": 1.0}
    cases = [base | {"end_difference": 0.01}, base, base | {"wrap": 2.0}, base | {"edge_activity": 0.01}, base | {"leakage": 9.0}, base]
    found = [fields.decide_boundary(f, "neumann" if k == 5 else None) for k, f in enumerate(cases)]
    return rows(spark, "k int, boundary string, dropped boolean, confidence string", [(k, f["boundary"], f["drop_end"], f["confidence"]) for k, f in enumerate(found)])


@query("uniform_nodes", "SELECT CAST(n_nationkey AS INTEGER) AS step, CAST(i AS INTEGER) AS ix, round(n_nationkey + 3 * (i * 0.5), 6) AS u FROM nation, (SELECT unnest(range(0, 9)) AS i)")
def uniform_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes in falling order, unevenly spaced, with values on a line: turned, and read from a spline at even nodes."""
    x = 4 * (np.linspace(0, 1, 9) ** 1.5)[::-1]
    u = F.transform(F.array(*[F.lit(float(v)) for v in x]), lambda v: F.col("n_nationkey") + 3 * v)
    frames = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("step"), u.cast("array<double>").alias("u"))
    even, _ = fields.uniform_space(frames, x, ["u"])
    return even.select("step", F.posexplode("u").alias("ix", "u")).select("step", "ix", F.round("u", 6).alias("u"))


@query("field_cells", f"SELECT CAST(s AS INTEGER) AS step, CAST(i AS INTEGER) AS ix, round(1 + i * 0.25, 6) AS x, round(u, 8) AS u FROM {_WAVE}")
def field_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = System("w", {"u": "0"}, (), 1.0, 0.0, 0.0, ("x",), "periodic", {"x": (16, 4.0, 1.0)})
    return fields.cells(_frames(spark, sf_dir), s).select("step", "ix", F.round("x", 6).alias("x"), F.round("u", 8).alias("u"))


def _mapped(frames: DataFrame, f) -> DataFrame:
    def run(batches):
        for pdf in batches:
            u = f(np.stack([np.asarray(a, float) for a in pdf["u"]]))
            yield pd.DataFrame({"step": np.repeat(pdf["step"].to_numpy(), u.shape[1]), "ix": np.tile(np.arange(u.shape[1]), len(u)), "u": u.ravel()})

    return frames.mapInPandas(run, "step int, ix int, u double").select("step", "ix", F.round("u", 6).alias("u"))


@query(
    "lowpass_filter",
    f"""WITH r AS {_WAVE}, k AS (SELECT unnest(range(0, 9)) AS k), c AS (SELECT s, k, sum(u * cos(2 * pi() * k * i / 16)) AS a, sum(u * sin(2 * pi() * k * i / 16)) AS b FROM r, k GROUP BY 1, 2)
SELECT CAST(c.s AS INTEGER) AS step, CAST(i AS INTEGER) AS ix, round(sum(exp(-power(k / 2.7, 4)) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END * (a * cos(2 * pi() * k * i / 16) + b * sin(2 * pi() * k * i / 16))) / 16, 6) AS u
FROM c, (SELECT unnest(range(0, 16)) AS i) GROUP BY 1, 2""",
)
def lowpass_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exp(-(k / 2.7)^4): 0.3 of nine modes."""
    return _mapped(_frames(spark, sf_dir), lambda u: N.lowpass(u, 0.3, 1))


@query(
    "spectral_derivative",
    f"""WITH r AS {_WAVE}, k AS (SELECT unnest(range(1, 8)) AS k), c AS (SELECT s, k, sum(u * cos(2 * pi() * k * i / 16)) AS a, sum(u * sin(2 * pi() * k * i / 16)) AS b FROM r, k GROUP BY 1, 2)
SELECT CAST(c.s AS INTEGER) AS step, CAST(i AS INTEGER) AS ix, round(sum(2 * (pi() * k / 2) * (b * cos(2 * pi() * k * i / 16) - a * sin(2 * pi() * k * i / 16))) / 16, 6) AS u FROM c, (SELECT unnest(range(0, 16)) AS i) GROUP BY 1, 2""",
)
def spectral_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d/dx on a circle of length 4; the highest mode has no first derivative."""
    s = System("w", {"u": "0"}, (), 1.0, 0.0, 0.0, ("x",), "periodic", {"x": (16, 4.0, 0.0)})
    return _mapped(_frames(spark, sf_dir), lambda u: derivatives(u[..., None], ["u"], s, {"u_x"})["u_x"])


@query(
    "difference_matrix",
    """WITH r AS (SELECT n_nationkey AS s, i, power(i * 0.5, 3) + n_nationkey AS u FROM nation, (SELECT unnest(range(0, 12)) AS i)) SELECT CAST(s AS INTEGER) AS step, CAST(i AS INTEGER) AS ix, round(3 * power(i * 0.5, 2), 6) AS u FROM r""",
)
def difference_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of fourth order are exact for cubics, one-sided ends included."""
    u = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.pow(i * 0.5, F.lit(3)) + F.col("n_nationkey"))
    frames = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("step"), u.alias("u"))
    return _mapped(frames, lambda u: u @ N.difference_matrix(12, 0.5, 1).T)


@fact(
    "stencil_weights",
    "SELECT kind, i, round(a / 12::DOUBLE, 10) AS w FROM (VALUES ('central', 0, 1), ('central', 1, -8), ('central', 2, 0), ('central', 3, 8), ('central', 4, -1), ('end', 0, -25), ('end', 1, 48), ('end', 2, -36), ('end', 3, 16), ('end', 4, -3)) AS v(kind, i, a)",
)
def stencil_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {"central": (-2.0, -1.0, 0.0, 1.0, 2.0), "end": (0.0, 1.0, 2.0, 3.0, 4.0)}
    return rows(spark, "kind string, i int, w double", [(k, i, round(float(w), 10) + 0.0) for k, o in own.items() for i, w in enumerate(N.stencil(o, 1))])


@fact("derivative_symbols", "SELECT * FROM (VALUES (0, 'u'), (1, 'v'), (2, 'u_x'), (3, 'u_y'), (4, 'u_xx'), (5, 'u_xy'), (6, 'u_yy'), (7, 'v_x'), (8, 'v_y'), (9, 'v_xx'), (10, 'v_xy'), (11, 'v_yy'), (12, 'x'), (13, 'y')) AS v(place, symbol)")
def derivative_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "place int, symbol string", list(enumerate(library.derivative_symbols(["u", "v"], ("x", "y"), 2))))


# --- expressions

_FUNCTIONS = {
    "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "exp": "exp(-x)", "log": "log(x)", "sqrt": "sqrt(x)", "sinh": "sinh(x/10)", "cosh": "cosh(x/10)", "tanh": "tanh(x/10)", "asin": "asin(y)", "acos": "acos(y)",
    "atan": "atan(x)", "abs_": "abs(y - x)", "sign_": "sign(x - 25)", "most": "Max(x, 20*y)", "least": "Min(x, 20*y)", "cot": "cot(x)", "angle": "atan2(y, x)", "power_": "x**2*y**3",
}
_IN_SQL = {
    "sinh": "(exp(x/10) - exp(-x/10)) / 2", "cosh": "(exp(x/10) + exp(-x/10)) / 2", "tanh": "(exp(x/5) - 1) / (exp(x/5) + 1)", "log": "ln(x)", "most": "greatest(x, 20*y)", "least": "least(x, 20*y)",
    "cot": "cos(x) / sin(x)", "sign_": "CASE WHEN x > 25 THEN 1.0 WHEN x < 25 THEN -1.0 ELSE 0.0 END", "power_": "x * x * y * y * y", "tan": "sin(x) / cos(x)",
}


@query(
    "function_means",
    "SELECT grp, " + ", ".join(f"round(avg({_IN_SQL.get(n, e)}), 6) AS {n}" for n, e in _FUNCTIONS.items()) + " FROM (SELECT l_returnflag AS grp, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS y FROM lineitem) GROUP BY 1",
)
def function_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function of expressions, as columns."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"))
    return df.groupBy("grp").agg(*[F.round(F.avg(X.parse(e, ["x", "y"]).column()), 6).alias(n) for n, e in _FUNCTIONS.items()])


@fact("structure_scores", "SELECT model, p / 2::DOUBLE AS precision_, r / 2::DOUBLE AS recall, e / 10::DOUBLE AS error FROM (VALUES ('same', 2, 2, 0), ('missing', 2, 1, 0), ('extra', 1, 2, 1)) AS v(model, p, r, e)")
def structure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = {"x": "x*y - 2*y"}
    models = {"same": "y*(x - 2)", "missing": "-2*y", "extra": "1.1*x*y - 1.8*y + x + x**2"}
    out = [(k, X.structure_metrics({"x": e}, truth, ["x", "y"])) for k, e in models.items()]
    return rows(spark, "model string, precision_ double, recall double, error double", [(k, m["precision"], m["recall"], round(m["coef_rel_err"], 10)) for k, m in out])


@fact("combinations_as_text", "SELECT * FROM (VALUES (0, '0'), (1, '2*x - 0.5*x*y'), (2, '1.5')) AS v(k, text)")
def combinations_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [([0.0, 0.0, 0.0], 0), ([0.0, 2.0, -0.5], 1), ([1.5, 0.0, 0.0], 2)]
    return rows(spark, "k int, text string", [(k, X.linear_combination(c, ["1", "x", "x*y"])) for c, k in cases])


@fact("judged_pairs", "SELECT * FROM (VALUES ('(x + y)**2', 'x**2 + 2*x*y + y**2', 'equal'), ('1.02*x', 'x', 'close'), ('x*y', 'x + y', 'different')) AS v(a, b, verdict)")
def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("(x + y)**2", "x**2 + 2*x*y + y**2"), ("1.02*x", "x"), ("x*y", "x + y")]
    return rows(spark, "a string, b string, verdict string", [(a, b, datasets.judge({"x": a}, {"x": b}, ["x", "y"])) for a, b in pairs])


@fact("parameters_split", "SELECT * FROM (VALUES ('p0', 'linear'), ('p1', 'linear'), ('p2', 'curved')) AS v(name, kind)")
def parameters_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    linear, curved = X.split_parameters({"s": X.parse("p0 - p1*s/(p2 + s)")}, ["p0", "p1", "p2"])
    return rows(spark, "name string, kind string", [(p, "linear") for p in linear] + [(p, "curved") for p in curved])


@fact("linear_part", "SELECT symbol, CAST(-1 AS DOUBLE) AS coef FROM (VALUES ('u_xx'), ('u_xxxx')) AS v(symbol)")
def linear_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, rest = X.split_linear_part(X.parse("-u*u_x - u_xx - u_xxxx"), "u")
    assert rest == X.parse("-u*u_x")
    return rows(spark, "symbol string, coef double", [(k, float(c)) for k, c in own.items()])


# --- diagnostics


@query(
    "fft_spectrum",
    f"""WITH {OBS}, m AS (SELECT traj, avg(u) AS m, count(*) AS n FROM obs GROUP BY 1), r AS (SELECT traj, step AS j, u - m AS u, n, unnest(range(1, n // 2 + 1)) AS k FROM obs JOIN m USING (traj)),
s AS (SELECT traj, k, sum(u * cos(2 * pi() * j * k / n)) AS c, sum(u * sin(2 * pi() * j * k / n)) AS s FROM r GROUP BY 1, 2) SELECT CAST(k AS INTEGER) AS k, round(avg(c * c + s * s), 3) AS power FROM s GROUP BY 1""",
)
def fft_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.spectra(trajectories(spark, sf_dir), ["u"]).where("k > 0").select("k", F.round("power", 3).alias("power"))


@query(
    "shape_choice",
    """WITH r AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) / (7 + l_quantity) + 0.001 * l_linenumber AS y FROM lineitem), e AS (SELECT max(x) - min(x) + 1e-12 AS span FROM r),
k AS (SELECT 0.05 * power(100.0, i / 11.0) * span AS k FROM e, (SELECT unnest(range(0, 12)) AS i)),
z AS (SELECT 'quadratic' AS shape, NULL::DOUBLE AS k, 0.0 AS pen, x, y, x * x AS z FROM r UNION ALL SELECT 'cubic', NULL, 0.0, x, y, x * x * x FROM r UNION ALL SELECT 'sin', NULL, 0.1, x, y, sin(x) FROM r UNION ALL SELECT 'cos', NULL, 0.1, x, y, cos(x) FROM r
 UNION ALL SELECT 'saturating', k, 0.3, x, y, x / (k + x) FROM r, k UNION ALL SELECT 'exp', k, 0.3, x, y, exp(x / k) FROM r, k WHERE k * 30 >= (SELECT max(x) FROM r) UNION ALL SELECT 'tanh', k, 0.3, x, y, 1 - 2 / (exp(2 * x / k) + 1) FROM r, k),
c AS (SELECT shape, k, max(pen) AS pen, covar_pop(z, y) - covar_pop(z, x) * covar_pop(y, x) / var_pop(x) AS zy, var_pop(z) - covar_pop(z, x) ** 2 / var_pop(x) AS zz, var_pop(y) - covar_pop(y, x) ** 2 / var_pop(x) AS yy FROM z GROUP BY 1, 2)
SELECT shape, round(k, 6) AS scale, round(ln(1 - zy * zy / (zz * yy)) + pen, 4) AS score FROM c ORDER BY ln(1 - zy * zy / (zz * yy)) + pen LIMIT 1""",
)
def shape_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saturating dependence is told from forty templates by one matrix of moments."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_quantity") / (7 + F.col("l_quantity")) + 0.001 * F.col("l_linenumber")).cast("double").alias("y"))
    s = diagnostics.shape_in(df, "x", "y")
    return rows(spark, "shape string, scale double, score double", [(s["shape"], round(s["K"], 6) if s["K"] else None, round(s["score"], 4))])


@query(
    "amplitude_period",
    f"""WITH {OBS}, m AS (SELECT traj, avg(u) AS m, stddev_pop(u) AS a FROM obs GROUP BY 1), s AS (SELECT traj, step, a, u >= m AND lag(u) OVER w < m AS up FROM obs JOIN m USING (traj) {W}),
e AS (SELECT traj, a, (max(step) - min(step)) * 0.5 / (count(*) - 1) AS p FROM s WHERE up GROUP BY 1, 2 HAVING count(*) > 1)
SELECT CAST(count(*) AS BIGINT) AS trajectories, round(covar_pop(a, p) / (stddev_pop(a) * stddev_pop(p)), 8) AS correlation, round(stddev_pop(p) / avg(p), 8) AS spread FROM e""",
)
def amplitude_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = diagnostics.amplitude_period(trajectories(spark, sf_dir), "u", 0.5)
    return rows(spark, "trajectories long, correlation double, spread double", [(r["trajectories"], round(r["correlation"], 8), round(r["spread"], 8))])


@query(
    "interaction_share",
    "SELECT variable, CAST(left_ AS DOUBLE) AS below FROM (VALUES ('x', 0), ('y', 1)) AS v(variable, left_)",
)
def interaction_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dx/dt = x y needs the product, dy/dt = y**2 doesn't: what products leave of the residual, as all or nothing."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("y")).withColumn("x_t", F.col("x") * F.col("y")).withColumn("y_t", F.col("y") ** 2 + F.col("x") * F.lit(0.0) + F.sin("x"))
    found = diagnostics.interactions(df, ["x", "y"])
    return rows(spark, "variable string, below double", [(v, float(s > 0.7)) for v, s in found.items()])


@fact("noise_gain", "SELECT 'u' AS variable, round(0.02 * sqrt(130.0) / 12 / 0.5, 10) AS noise")
def noise_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cubic over five samples differentiates with (1, -8, 0, 8, -1) / 12."""
    return rows(spark, "variable string, noise double", [(v, round(x, 10)) for v, x in uncertainty.noise_floor(["u"], {"u": 0.02}, 0.5, 5, 3).items()])


@fact("corner_modes", "SELECT mode, 1 AS most FROM (VALUES (3), (10), (25)) AS v(mode)")
def corner_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corner of a single tapered mode lies within four modes of it."""
    t, noise = np.arange(256) / 256, 1e-3 * np.random.default_rng(0).standard_normal(256)
    tone = lambda k: (np.sin(2 * np.pi * k * t) + noise)[:, None]
    return rows(spark, "mode int, most int", [(k, int(abs(weakform.corner_mode(tone(k)) - k) <= 4)) for k in (3, 10, 25)])


# --- regression on matrices

_PAIR = "SELECT sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy, sum(y * y) AS yy, count(*) AS n FROM (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS z, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem)"
_SOLVED = f"s AS ({_PAIR}), c AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b FROM s)"


def _pair(spark: SparkSession, sf_dir: str) -> gram.Gram:
    df = table(spark, sf_dir, "lineitem")
    return gram.grams(df, {"x": F.col("l_quantity"), "z": F.col("l_discount")}, {"y": F.col("l_extendedprice")})[None]


@query(
    "stlsq_two_terms",
    f"""WITH {_SOLVED}, t AS (SELECT unnest([0.001, 0.1, 0.5]) AS threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, round(CASE WHEN abs(a) * sqrt(xx / yy) < threshold THEN 0 WHEN abs(b) * sqrt(zz / yy) < threshold THEN xy / xx ELSE a END, 3) AS x,
round(CASE WHEN abs(b) * sqrt(zz / yy) < threshold THEN 0 WHEN abs(a) * sqrt(xx / yy) < threshold THEN zy / zz ELSE b END, 1) AS z FROM c, t""",
)
def stlsq_two_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _pair(spark, sf_dir)
    found = [(th, regression.stlsq(g, 0, th, 0.0)) for th in (0.001, 0.1, 0.5)]
    return rows(spark, "threshold double, x double, z double", [(th, round(float(c[0]), 3) + 0.0, round(float(c[1]), 1) + 0.0) for th, c in found])


@query(
    "greedy_paths",
    f"""WITH {_SOLVED} SELECT 'forward' AS path, CASE WHEN xy * xy / xx > zy * zy / zz THEN 'x' ELSE 'z' END AS term, round(CASE WHEN xy * xy / xx > zy * zy / zz THEN xy / xx ELSE zy / zz END, 2) AS coef FROM c
UNION ALL SELECT 'backward', CASE WHEN xy * xy / xx > zy * zy / zz THEN 'x' ELSE 'z' END, round(CASE WHEN xy * xy / xx > zy * zy / zz THEN xy / xx ELSE zy / zz END, 2) FROM c""",
)
def greedy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one term that both greedy ways keep."""
    g = _pair(spark, sf_dir)
    forward, backward = next(iter(regression.forward_path(g, 0))), list(regression.backward_path(g, 0))[-1]
    return rows(spark, "path string, term string, coef double", [(n, g.terms[s[0]], round(float(c[s[0]]), 2)) for n, (s, c) in (("forward", forward), ("backward", backward))])


@query(
    "single_edits",
    f"""WITH {_SOLVED}, r AS (SELECT n, yy - xy * xy / xx AS one, yy - a * xy - b * zy AS two FROM c) SELECT 'add' AS edit, 'z' AS term, round(n * ln(two / one) + ln(n), 3) AS dbic FROM r""",
)
def single_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What adding the second term does to BIC."""
    found = uncertainty.local_search(_pair(spark, sf_dir), 0, [0])
    return rows(spark, "edit string, term string, dbic double", [(e["edit"], e["term"], round(float(e["dbic"]), 3)) for e in found])


@fact("library_of_fields", "SELECT * FROM (VALUES (0, '1'), (1, 'u_x'), (2, 'u_xx'), (3, 'u'), (4, 'u*u_x'), (5, 'u*u_xx')) AS v(place, term)")
def library_of_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "place int, term string", list(enumerate(library.build_library(["u"], 1, dims=("x",), max_derivative=2))))


# --- coordinates, invariants, symmetries


@query("log_coordinates", f"WITH {OBS} SELECT traj, CAST(step AS INTEGER) AS step, round(ln(u + 1), 8) AS z FROM obs")
def log_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = coordinates.make_coords("log", {"z": "log(u)"}, ["u"])
    moved, error = coordinates.transform_data(trajectories(spark, sf_dir).withColumn("u", F.col("u") + 1), c)
    assert error < 1e-9
    return moved.select("traj", F.col("step").cast("int").alias("step"), F.round("z", 8).alias("z"))


@query(
    "polar_coordinates",
    f"""WITH {OBS}, a AS (SELECT traj, step, u - 50.03125 AS x, (step % 7) - 2.5 AS y FROM obs), p AS (SELECT traj, step, sqrt(x * x + y * y) AS r, atan2(y, x) AS q FROM a), d AS (SELECT *, q - lag(q) OVER w AS d FROM p {W})
SELECT traj, CAST(step AS INTEGER) AS step, round(r, 6) AS r, round(q - 2 * pi() * sum(CASE WHEN abs(coalesce(d, 0)) < pi() THEN 0 ELSE round(d / (2 * pi())) END) OVER (PARTITION BY traj ORDER BY step ROWS UNBOUNDED PRECEDING), 5) AS q FROM d""",
)
def polar_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = coordinates.make_coords("polar", {"r": "sqrt(x**2 + y**2)", "q": "atan2(y, x)"}, ["x", "y"], {"x": "r*cos(q)", "y": "r*sin(q)"})
    df = trajectories(spark, sf_dir).select("traj", "step", "t", (F.col("u") - 50.03125).alias("x"), (F.col("step") % 7 - 2.5).cast("double").alias("y"))
    moved, _ = coordinates.transform_data(df, c)
    return moved.select("traj", F.col("step").cast("int").alias("step"), F.round("r", 6).alias("r"), F.round("q", 5).alias("q"))


@fact("models_mapped", "SELECT * FROM (VALUES ('x', 'equal'), ('y', 'equal'), ('a', 'equal')) AS v(variable, verdict)")
def models_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model in logarithms and back; d(log x)/dt by hand."""
    c = coordinates.make_coords("log", {"a": "log(x)", "b": "log(y)"}, ["x", "y"])
    rhs = SYSTEMS["lotka_volterra"].rhs
    there = coordinates.map_forward(c, rhs)
    back = coordinates.map_back(c, there)
    out = [(v, X.equivalent(back[v], rhs[v], ["x", "y"])) for v in rhs] + [("a", X.equivalent(there["a"], "1.1 - 0.4*exp(b)", ["a", "b"]))]
    return rows(spark, "variable string, verdict string", out)


@fact("conserved_sum", "SELECT 'constraint' AS kind, 3 AS terms, true AS equal_weights")
def conserved_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S + I + R = 1 of an epidemic."""
    s = SYSTEMS["sir"]
    found = coordinates.find_invariants(simulate(spark, s, 4), s.variables, s.dt, degree=1, logs=False, window=5)["invariants"][0]
    c = X.parse(found["H"], s.variables).coefficients()
    return rows(spark, "kind string, terms int, equal_weights boolean", [(found["kind"], len(c), bool(np.ptp(list(c.values())) < 0.02))])


@fact("vector_field_symmetries", "SELECT * FROM (VALUES ('hopf', 'generator', 'rotation'), ('lorenz', 'map', '(-x, -y, z)')) AS v(system, kind, what)")
def vector_field_symmetries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known facts: one rotation, one flip, and none of predator and prey."""
    out = []
    for name, degree, end in (("hopf", 3, None), ("lorenz", 2, 5), ("lotka_volterra", 2, None)):
        s = SYSTEMS[name]
        found = symmetry.detect_symmetries(simulate(spark, s, 4, t_end=end), s.variables, s.dt, degree, 5)
        out += [(name, "generator", g["name"].split()[0]) for g in found["generators"]] + [(name, "map", d["map"]) for d in found["discrete"] if name != "hopf"]
    return rows(spark, "system string, kind string, what string", out)


@fact("equivariant_dimensions", "SELECT * FROM (VALUES ('plane cubic, rotation', 4), ('space cubic, flip of two axes', 30)) AS v(model, free)")
def equivariant_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = lambda names, gens, maps: N.null_space(symmetry.equivariance_constraints(library.build_library(names, 3), names, gens, maps)).shape[1]
    out = [("plane cubic, rotation", free(["x", "y"], [symmetry.rotation_generator(0, 1, 2)], [])), ("space cubic, flip of two axes", free(["x", "y", "z"], [], [np.diag([-1.0, -1.0, 1.0])]))]
    return rows(spark, "model string, free int", out)


@fact("generators", "SELECT kind, i, j, CAST(a AS DOUBLE) AS a FROM (VALUES ('rotation', 0, 1, -1), ('rotation', 1, 0, 1), ('scaling', 0, 0, 2), ('scaling', 1, 1, -1)) AS v(kind, i, j, a)")
def generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {"rotation": symmetry.rotation_generator(0, 1, 2), "scaling": symmetry.scaling_generator([2.0, -1.0])}
    return rows(spark, "kind string, i int, j int, a double", [(k, int(i), int(j), float(m[i, j])) for k, m in own.items() for i, j in zip(*np.nonzero(m), strict=True)])


@fact("field_symmetries", "SELECT true AS translation, CAST(NULL AS VARCHAR) AS reflection, CAST(6 AS DOUBLE) AS galilean")
def field_symmetries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Korteweg-de Vries: a boost u -> u + c goes with x -> x + 6 c t; no mirror image in space alone."""
    f = symmetry.field_symmetries({"u": "-6*u*u_x - u_xxx"}, ["u", "u_x", "u_xxx"])
    return rows(spark, "translation boolean, reflection string, galilean double", [(f["translation"], ", ".join(f["reflections"]) or None, float(f["galilean"]))])


@fact(
    "field_symmetries_measured",
    "SELECT * FROM (VALUES ('burgers', 'translation', 'x', CAST(NULL AS DOUBLE)), ('burgers', 'symmetry', 'x -> -x, u -> -u', NULL), ('burgers', 'boost', 'u', 1.0), "
    "('advection_diffusion', 'translation', 'x', NULL), ('advection_diffusion', 'symmetry', 'u -> -u', NULL), ('advection_diffusion', 'shift', 'u', NULL), "
    "('advection_diffusion', 'generator', 'scaling', NULL)) AS v(system, kind, what, velocity)",
)
def field_symmetries_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From frames alone: Burgers' equation has the mirror image with a change of sign and boosts; a linear equation has shifts and scalings."""
    found: list[tuple] = []
    for name in ("burgers", "advection_diffusion"):
        s = SYSTEMS[name]
        r = field_symmetry.detect_field_symmetries(simulate(spark, s, 2, t_end=1.0), s, s.dt, window=5, fraction=None)
        found += [(name, "translation", "x", None)] if r["translation"] else []
        found += [(name, v, k, None) for k, v in r["maps"].items() if v != "no"]
        found += [(name, v["kind"], k, round(v["velocity"]["x"], 3) if "velocity" in v else None) for k, v in r["shifts"].items() if v["kind"] != "no"]
        found += [(name, "generator", "scaling" if np.allclose(a, np.eye(1)) else str(a), None) for a in r["generators"]]
    return rows(spark, "system string, kind string, what string, velocity double", found)


# --- simulation and scores


@query(
    "rollout_exact",
    "WITH s AS (SELECT n_nationkey AS traj, 1.0 + n_regionkey AS x0, n_nationkey / 10.0 AS y0, k, k * 0.25 AS t FROM nation, (SELECT unnest(range(0, 21)) AS k)) "
    "SELECT CAST(traj AS INTEGER) AS traj, CAST(k AS INTEGER) AS step, round(x0 * exp(-0.3 * t), 5) AS x, round(y0 + 0.2 * x0 * (1 - exp(-0.3 * t)) / 0.3, 5) AS y FROM s",
)
def rollout_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dx/dt = -0.3 x, dy/dt = 0.2 x from every nation's own start."""
    starts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("traj"), (1.0 + F.col("n_regionkey")).alias("x"), (F.col("n_nationkey") / 10).alias("y"))
    run = scoring.rollout(starts, {"x": "-0.3*x", "y": "0.2*x"}, np.arange(21) * 0.25)
    return run.select("traj", "step", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


def _field_run(spark: SparkSession, sf_dir: str, system: System, rhs: str, u) -> DataFrame:
    starts = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("traj"), u.alias("u"))
    run = scoring.rollout(starts, {"u": rhs}, np.arange(5) * 0.1, system)
    return run.select("traj", "step", F.posexplode("u").alias("ix", "u")).select("traj", "step", "ix", F.round("u", 4).alias("u"))


@query(
    "advection_exact",
    "SELECT CAST(r_regionkey AS INTEGER) AS traj, CAST(k AS INTEGER) AS step, CAST(i AS INTEGER) AS ix, round(exp(-0.05 * k * 0.1) * sin(2 * pi() * i / 32 - k * 0.1 + r_regionkey), 4) AS u FROM region, (SELECT unnest(range(0, 5)) AS k), (SELECT unnest(range(0, 32)) AS i)",
)
def advection_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u_t = -u_x + 0.05 u_xx on a circle: exponential time differencing."""
    s = System("a", {"u": "0"}, (), 0.1, 0.4, 0.4, ("x",), "periodic", {"x": (32, 2 * np.pi, 0.0)}, dt_sim=0.01)
    return _field_run(spark, sf_dir, s, "-u_x + 0.05*u_xx", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.sin(2 * np.pi * i / 32 + F.col("r_regionkey"))))


@query(
    "heat_with_ends_exact",
    "SELECT CAST(r_regionkey AS INTEGER) AS traj, CAST(k AS INTEGER) AS step, CAST(i AS INTEGER) AS ix, round((1 + r_regionkey) * exp(-0.2 * power(pi() / 10, 2) * k * 0.1) * sin(pi() * i / 40), 4) + 0 AS u FROM region, (SELECT unnest(range(0, 5)) AS k), (SELECT unnest(range(0, 41)) AS i)",
)
def heat_with_ends_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u_t = 0.2 u_xx with ends held at zero: method of lines."""
    s = System("h", {"u": "0"}, (), 0.1, 0.4, 0.4, ("x",), "dirichlet", {"x": (41, 10.0, 0.0)})
    out = _field_run(spark, sf_dir, s, "0.2*u_xx", F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: (1 + F.col("r_regionkey")) * F.sin(np.pi * i / 40)))
    return out.select("traj", "step", "ix", (F.col("u") + 0.0).alias("u"))


@fact("known_systems", "SELECT * FROM (VALUES ('ode', 18), ('pde', 11)) AS v(kind, n)")
def known_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [s.kind for s in SYSTEMS.values()]
    return rows(spark, "kind string, n int", [(k, kinds.count(k)) for k in ("ode", "pde")])


@fact("suite_sizes", "SELECT * FROM (VALUES ('default', 29), ('clean', 29), ('noise_ladder', 116), ('noise_types', 116), ('hard', 6)) AS v(suite, n)")
def suite_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "suite string, n int", [(k, len(v)) for k, v in systems.SUITES.items()])


@fact("blinded_systems", "SELECT CAST(29 AS BIGINT) AS n, CAST(0 AS BIGINT) AS leaks, CAST(0 AS BIGINT) AS moved_too_far")
def blinded_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names tell nothing, and coefficients of polynomial systems move by a quarter at most."""
    hidden = {s.name: blind(s, 3) for s in SYSTEMS.values()}
    leaks = sum(n in h.name or bool(set(h.variables) & set(SYSTEMS[n].variables)) for n, (h, _) in hidden.items())
    far = 0
    for v, e in SYSTEMS["lotka_volterra"].rhs.items():
        h, names = hidden["lotka_volterra"]
        own, new = X.parse(e).coefficients(), X.parse(h.rhs[names[v]]).coefficients()
        far += len(own) != len(new) or any(not 0.7499 <= b / a <= 1.2501 for a, b in zip(sorted(own.values()), sorted(new.values()), strict=True))
    return rows(spark, "n long, leaks long, moved_too_far long", [(len(hidden), leaks, far)])


@fact("score_of_truth", "SELECT CAST(4 AS INTEGER) AS n_terms, CAST(6.42 AS DOUBLE) AS score, CAST(1 AS DOUBLE) AS valid_frac")
def score_of_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true equations reach the ceiling of the score: 6.5 less 0.02 a term."""
    s = SYSTEMS["lotka_volterra"]
    r = scoring.evaluate(simulate(spark, s, 2, t_end=4), s, s.rhs)
    return rows(spark, "n_terms int, score double, valid_frac double", [(r["n_terms"], round(r["score"], 6), round(r["valid_frac"], 6))])


# --- uncertainty and assessment


@query("blocks_and_folds", f"WITH {OBS}, n AS (SELECT max(step) + 1 AS n FROM obs) SELECT traj, CAST(step AS INTEGER) AS step, CAST(least(step // 18, greatest(0, n // 18 - 1)) AS INTEGER) AS block, CAST(least(step * 4 // n, 3) AS INTEGER) AS fold FROM obs, n")
def blocks_and_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir)
    n = df.agg(F.max("step") + 1).first()[0]
    return df.select("traj", F.col("step").cast("int").alias("step"), uncertainty.block_of("step", n).alias("block"), uncertainty.fold_of(1, n).alias("fold"))


@query(
    "coefficient_intervals",
    f"""WITH {OBS}, b AS (SELECT traj % 16 AS block, u, step FROM obs), s AS (SELECT block, count(*) AS n, sum(u) AS x, sum(u * u) AS xx, sum(step) AS y, sum(u * step) AS xy FROM b GROUP BY 1),
p AS (SELECT block, row_number() OVER (ORDER BY CAST(block AS VARCHAR)) - 1 AS place FROM s),
k AS (SELECT count(*) AS k FROM s), d AS (SELECT bag, ((bag * 7919 + place * 104729) % 1000003) % k AS place FROM (SELECT unnest(range(0, 100)) AS bag) a, p, k),
e AS (SELECT bag, sum(n) AS n, sum(x) AS x, sum(xx) AS xx, sum(y) AS y, sum(xy) AS xy FROM d JOIN p USING (place) JOIN s USING (block) GROUP BY 1), f AS (SELECT (n * xy - x * y) / (n * xx - x * x) AS v FROM e)
SELECT round(quantile_cont(v, 0.05), 8) AS low, round(quantile_cont(v, 0.95), 8) AS high, quantile_cont(v, 0.05) * quantile_cont(v, 0.95) > 0 AS significant FROM f""",
)
def coefficient_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gram.grams(trajectories(spark, sf_dir).withColumn("block", F.col("traj") % 16), {"1": F.lit(1.0), "u": F.col("u")}, {"step": F.col("step")}, "block")
    r = uncertainty.coefficient_intervals(found, 0, [0, 1])[1]
    return rows(spark, "low double, high double, significant boolean", [(round(r["ci90"][0], 8), round(r["ci90"][1], 8), r["significant"])])


@query(
    "model_comparison",
    f"""WITH {OBS}, g AS (SELECT traj, step, u, coalesce((lead(u) OVER w - lag(u) OVER w) / 2, lead(u) OVER w - u, u - lag(u) OVER w) AS d FROM obs {W}), s AS (SELECT avg(d * d) AS s FROM g),
e AS (SELECT traj, step // 10 AS b, avg(d * d) / max(s) AS zero, avg((0.5 * (50 - u) - d) ** 2) / max(s) AS pull FROM g, s GROUP BY 1, 2)
SELECT 'zero' AS model, round(sqrt(avg(zero)), 8) AS nrmse, CAST(0 AS INTEGER) AS n_terms, round(CASE WHEN avg(zero) <= avg(pull) THEN 0 ELSE (avg(zero) - avg(pull)) / (stddev_samp(zero - pull) / sqrt(count(*))) END, 5) AS z FROM e
UNION ALL SELECT 'pull', round(sqrt(avg(pull)), 8), 2, round(CASE WHEN avg(pull) <= avg(zero) THEN 0 ELSE (avg(pull) - avg(zero)) / (stddev_samp(pull - zero) / sqrt(count(*))) END, 5) FROM e""",
)
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = windows.smooth_and_differentiate(trajectories(spark, sf_dir), ["u"], 1.0, method="fd")
    out = uncertainty.compare_models(r, {"zero": {"u": "0"}, "pull": {"u": "0.5*(50 - u)"}}, F.concat_ws("/", "traj", F.floor(F.col("step") / 10)))["models"]
    return rows(spark, "model string, nrmse double, n_terms int, z double", [(k, round(m["nrmse"], 8), m["n_terms"], round(float(m["z_vs_best"]), 5)) for k, m in out.items()])


@fact("term_stability", "SELECT round((0.5 + 1/3.0 + 2/3.0) / 3, 10) AS stability")
def term_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "stability double", [(round(uncertainty.term_stability([{"a"}, {"a", "b"}, {"a", "b", "c"}]), 10),)])


@query(
    "predictability_horizons",
    "WITH s AS (SELECT n_nationkey AS traj, k * 0.1 AS t, (1.0 + n_nationkey) * (exp(0.02 * k) - exp(0.01 * k)) / 2 AS spread FROM nation, (SELECT unnest(range(0, 60)) AS k)), "
    "h AS (SELECT traj, coalesce(min(CASE WHEN spread > 3 * 0.25 THEN t END), max(t)) AS h, bool_or(spread > 0.75) AS ends FROM s GROUP BY 1) SELECT round(median(h), 6) AS horizon, NOT bool_or(ends) AS whole FROM h",
)
def predictability_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth at 0.1 against growth at 0.2: where their spread passes three times the noise."""
    starts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("traj"), (1.0 + F.col("n_nationkey")).alias("x"))
    r = assess.predictability(starts, {"a": {"x": "0.1*x"}, "b": {"x": "0.2*x"}}, {"x": 0.25}, np.arange(60) * 0.1)
    return rows(spark, "horizon double, whole boolean", [(round(r["horizon"], 6), r["horizon_is_full_data_span"])])


@fact("latin_hypercube", "SELECT 'x' AS variable, CAST(i AS INTEGER) AS stratum, CAST(1 AS BIGINT) AS n FROM (SELECT unnest(range(0, 40)) AS i) UNION ALL SELECT 'y', CAST(i AS INTEGER), CAST(1 AS BIGINT) FROM (SELECT unnest(range(0, 40)) AS i)")
def latin_hypercube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate in each of the strata of each side of the widened box."""
    plan = assess.candidates(spark, {"x": (0.0, 1.0), "y": (-5.0, 5.0)})
    side = F.array(F.struct(F.lit("x").alias("variable"), ((F.col("x") + 0.35) / 1.7).alias("p")), F.struct(F.lit("y").alias("variable"), ((F.col("y") + 8.5) / 17).alias("p")))
    return plan.select(F.explode(side).alias("s")).groupBy(F.col("s.variable").alias("variable"), F.floor(F.col("s.p") * 40).cast("int").alias("stratum")).agg(F.count("*").alias("n"))


@fact("grades", "SELECT * FROM (VALUES (0, 'low'), (1, 'medium'), (2, 'medium'), (3, 'high'), (4, 'high')) AS v(held, level)")
def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "held int, level string", [(k, assess.grade({f"c{i}": i < k for i in range(4)})["level"]) for k in range(5)])


@fact("data_advice", "SELECT * FROM (VALUES ('clean', 0), ('noisy', 1), ('coarse', 1), ('all', 3)) AS v(case_, n)")
def data_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda noise, step, n: {"noise_rel": {"u": noise}, "change_per_step": {"u": step}, "n_traj": n}
    cases = {"clean": f(0.01, 0.1, 4), "noisy": f(0.06, 0.1, 4), "coarse": f(0.01, 0.4, 4), "all": f(0.06, 0.4, 1)}
    return rows(spark, "case_ string, n int", [(k, len(assess.data_advice(v))) for k, v in cases.items()])


@fact("verdicts", "SELECT * FROM (VALUES ('nothing', 'INCONCLUSIVE'), ('sure', 'CONFIDENT'), ('telling', 'COLLECT MORE DATA'), ('alike', 'CONFIDENT IN PREDICTIONS'), ('poor', 'INCONCLUSIVE')) AS v(case_, status)")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = {
        "confidence": {"level": "medium"}, "missing_term_evidence": [], "terms": [{"significant": True}], "experiments": {"ranked": []}, "model_ambiguity": {"indistinguishable": ["model", "other"]},
        "validation": {"rollout_blew_up": False}, "predictability": {"horizon_is_full_data_span": True}, "data_advice": [],
    }
    telling = {"ranked": [{"score": 4.0, "gain_vs_existing_data": 2.0, "initial_condition": [1.0]}]}
    cases = {"nothing": {}, "sure": base | {"confidence": {"level": "high"}}, "telling": base | {"experiments": telling}, "alike": base, "poor": base | {"predictability": {"horizon_is_full_data_span": False}}}
    return rows(spark, "case_ string, status string", [(k, assess.verdict(a)["status"]) for k, a in cases.items()])


@fact("open_questions", "SELECT CAST(2 AS INTEGER) AS n")
def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = assess.questions([{"term": "x*y", "var": "x", "significant": False}, {"term": "x", "var": "x", "significant": True}], ["a", "b"])
    return rows(spark, "n int", [(len(asked),)])


# --- append, subsample, orbits, lessons


@query(
    "trajectories_appended",
    f"""WITH {OBS}, a AS (SELECT traj, step, u FROM obs WHERE traj % 2 = 0), b AS (SELECT traj, step, u FROM obs WHERE traj % 2 = 1), m AS (SELECT max(traj) + 1 AS m FROM b),
c AS (SELECT traj, step, u FROM b UNION ALL SELECT traj + m, step, u FROM a, m), k AS (SELECT min(n) AS k FROM (SELECT count(*) AS n FROM c GROUP BY traj)) SELECT CAST(traj AS BIGINT) AS traj, CAST(step AS INTEGER) AS step, round(u, 6) AS u FROM c, k WHERE step < k""",
)
def trajectories_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir).drop("t")
    out = windows.append_trajectories(df.where("traj % 2 = 0"), df.where("traj % 2 = 1"))
    return out.select(F.col("traj").cast("long").alias("traj"), F.col("step").cast("int").alias("step"), F.round("u", 6).alias("u"))


@query("every_third_step", f"WITH {OBS} SELECT traj, CAST(step // 3 AS INTEGER) AS step, round(u, 6) AS u FROM obs WHERE step % 3 = 0")
def every_third_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.subsample(trajectories(spark, sf_dir), 3).select("traj", F.col("step").cast("int").alias("step"), F.round("u", 6).alias("u"))


@query(
    "orbit_units",
    "WITH o AS (SELECT o_custkey AS traj, o_orderkey AS s, o_totalprice AS p FROM orders), r AS (SELECT traj, row_number() OVER w - 1 AS k, (s - first_value(s) OVER w) / sqrt(8.0 / 2.0) AS t, p / 2.0 AS x, p * sqrt(8.0 / 2.0) / 2.0 AS vx FROM o WINDOW w AS (PARTITION BY traj ORDER BY s)) "
    "SELECT CAST(traj AS BIGINT) AS traj, CAST(k // 2 AS INTEGER) AS step, round(t, 6) AS t, round(x, 4) AS x, round(vx, 4) AS vx FROM r WHERE k % 2 = 0",
)
def orbit_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of length 2 and of time sqrt(2^3 / 2), every other row."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("traj"), F.col("o_orderkey").alias("s"), F.col("o_totalprice").cast("double").alias("p"))
    out = datasets.scaled_orbit(o, 2.0, 2.0, "s", ["p"], ["p"], 2)
    return out.select("traj", "step", F.round("t", 6).alias("t"), F.round("x", 4).alias("x"), F.round("vx", 4).alias("vx"))


@query(
    "lessons_retrieved",
    """WITH l AS (SELECT p_name AS lesson, p_brand AS kind, p_size % 5 AS n_vars, p_retailprice / 100000 AS noise, p_size % 3 AS dims, p_size % 2 = 0 AS good FROM part),
s AS (SELECT lesson, round(CASE WHEN kind = 'Brand#13' THEN 2.0 ELSE 0 END + CASE WHEN n_vars = 3 THEN 0.5 ELSE 0 END + CASE WHEN dims = 0 THEN 0.5 ELSE 0 END + 0.3 + CASE WHEN good THEN 0.3 ELSE 0 END + 1 / (1 + abs(noise - 0.0125) * 20), 8) AS score FROM l)
SELECT lesson, score FROM s ORDER BY score DESC, lesson LIMIT 8""",
)
def lessons_retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("lesson"), F.col("p_brand").alias("kind"), (F.col("p_size") % 5).cast("int").alias("n_vars"), (F.col("p_retailprice") / 100000).cast("double").alias("noise"), (F.col("p_size") % 3).cast("int").alias("dims"), F.lit(None).cast("string").alias("boundary"), (F.col("p_size") % 2 == 0).alias("good"))
    return memory.retrieve(p, memory.fingerprint("Brand#13", 3, 0.0125, 0)).select("lesson", F.round("score", 8).alias("score"))


@fact("lessons_kept", "SELECT * FROM (VALUES (0, 'use the weak form for noisy data'), (1, 'smooth first')) AS v(place, lesson)")
def lessons_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "place int, lesson string", list(enumerate(memory.add_lessons([], ["use the weak form for noisy data", "use the weak form for very noisy data", "smooth first"]))))


@query("cross_validated_modes", "SELECT mode, 1 AS in_order, CAST(1 AS DOUBLE) AS stability FROM (VALUES ('fixed'), ('refit'), ('fitter')) AS v(mode)")
def cross_validated_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ways to leave folds out agree on a model that needs both terms: a fitter is no worse than one fixed term."""
    df = table(spark, sf_dir, "lineitem")
    found = gram.grams(df, {"x": F.col("l_quantity"), "z": F.col("l_discount")}, {"y": F.col("l_extendedprice")}, F.col("l_linenumber"))
    whole = regression.solve(uncertainty.total(found), 0)
    got = {
        "fixed": uncertainty.cross_validate(found, 0, "fixed", coef=whole), "refit": uncertainty.cross_validate(found, 0, "refit", support=[0, 1]),
        "fitter": uncertainty.cross_validate(found, 0, "fitter", fitter=lambda g, k: regression.solve(g, k)),
    }
    return rows(spark, "mode string, in_order int, stability double", [(k, int(got["fixed"]["mean"] <= r["mean"] + 1e-9), r["stability"]) for k, r in got.items()])


@fact("equivariant_fit", "SELECT 4 AS free_parameters, true AS fits")
def equivariant_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = SYSTEMS["hopf"]
    r = symmetry.equivariant_sindy(simulate(spark, s, 3, noise=0.01), s.variables, s.dt, 3, [symmetry.rotation_generator(0, 1, 2)])
    return rows(spark, "free_parameters int, fits boolean", [(r["free_parameters"], max(r["error"].values()) < 0.2)])


@fact("varpro", "SELECT parameter, CAST(value AS DOUBLE) AS value FROM (VALUES ('p0', 0.6), ('p1', 1.5), ('p2', 0.3)) AS v(parameter, value)")
def varpro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constants of Michaelis and Menten from a skeleton."""
    from .operators.skeleton import fit_skeleton

    s = SYSTEMS["michaelis_menten"]
    p = fit_skeleton(simulate(spark, s, 4), s.variables, {"s": "p0 - p1*s/(p2 + s)"}, s.dt, 5, 4000, 3)["params"]
    return rows(spark, "parameter string, value double", [(k, round(p[k], 1)) for k in ("p0", "p1", "p2")])


@fact("lorenz_recovered", "SELECT * FROM (VALUES ('x', 'x'), ('x', 'y'), ('y', 'x'), ('y', 'y'), ('y', 'x*z'), ('z', 'x*y'), ('z', 'z')) AS v(variable, term)")
def lorenz_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven terms of the true equations, and no other."""
    from .operators import sindy

    s = SYSTEMS["lorenz"]
    out = sindy.run_sindy(simulate(spark, s, 3, t_end=6), s.variables, s.dt, degree=2, window=5)
    return rows(spark, "variable string, term string", [(v, t) for v, e in out["rhs"].items() for t in X.parse(e, s.variables).coefficients()])


@fact("skeleton_front", "SELECT * FROM (VALUES ('a'), ('b'), ('d')) AS v(equation)")
def skeleton_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.skeleton import pareto_front

    return pareto_front(rows(spark, "equation string, complexity int, loss double", [("a", 1, 3.0), ("b", 2, 1.0), ("c", 3, 2.0), ("d", 4, 0.5)])).select("equation")


@fact("degree_chosen", "SELECT 2 AS degree")
def degree_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predator and prey are quadratic."""
    s = SYSTEMS["lotka_volterra"]
    return rows(spark, "degree int", [(symmetry.choose_degree(simulate(spark, s, 4), s.variables, s.dt, window=5),)])


@fact("weak_statistics", "SELECT variable, term, true AS significant FROM (VALUES ('x', 'x'), ('x', 'x*y'), ('y', 'y'), ('y', 'x*y')) AS v(variable, term)")
def weak_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under 3 % of noise the true terms of predator and prey are significant on the weak form."""
    s = SYSTEMS["lotka_volterra"]
    found = assess.weak_stats(simulate(spark, s, 4, noise=0.03), s.variables, s.dt, s.rhs)["terms"]
    return rows(spark, "variable string, term string, significant boolean", [(t["var"], t["term"], t["significant"]) for t in found])
