"""Registered queries of the engine on the driver's tables, each with the same query as SQL where SQL can express it.

Trajectories of the event table are its users: `step` numbers a user's events by (ts, event_id), `t` is hours since the first of them, `u` the value.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numerics as N
from .functions.expressions import parse
from .operators import diagnostics, gram, library, memory, regression, scoring, sindy, uncertainty, weakform, windows
from .operators.simulate import simulate
from .operators.systems import SYSTEMS
from .sources import ingest, readers
from .streaming import rates

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


#: Operators on small fixed or simulated input with known results: run by the tests, not registered as queries.
FACTS: dict[str, tuple[Query, str | None]] = {}


def fact(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FACTS[name] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs(traj, step, t, u) of the event table."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("traj"), "ts", "event_id", F.col("value").cast("double").alias("u"))
    e = windows.elapsed(e, "ts", ("ts", "event_id"), 3600.0, ("traj",))
    return e.select("traj", (F.row_number().over(Window.partitionBy("traj").orderBy("ts", "event_id")) - 1).alias("step"), "t", "u")


OBS = """obs AS (SELECT user_id AS traj, row_number() OVER w - 1 AS step,
  (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 3600e6 AS t, CAST(value AS DOUBLE) AS u FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smooth, differentiate and fit a sparse equation on the event trajectories."""
    df = trajectories(spark, sf_dir)
    return sindy.as_rows(spark, sindy.run_sindy(df, ["u"], 1.0, degree=2, window=5))


def _weights(name: str, weights, offsets, over: str = "w") -> str:
    parts = [f"({x!r}) * " + (name if o == 0 else f"{'lag' if o < 0 else 'lead'}({name}, {abs(o)}) OVER {over}") for x, o in zip(map(float, weights), offsets, strict=True) if x]
    return "(" + " + ".join(parts) + ")"


W = "WINDOW w AS (PARTITION BY traj ORDER BY step)"

# --- sources and layout


@query(
    "inspect_numeric",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS nulls, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most FROM lineitem"
        for c in ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
    + ")",
)
def inspect_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return readers.inspect(df).select("name", F.col("rows").alias("n_rows"), "nulls", "n_unique", "least", "most")


@query(
    "inspect_categorical",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, CAST(count(*) - count({c}) AS BIGINT) AS nulls, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique, min({c}) AS example FROM events" for c in ("event_type", "props")) + ")",
)
def inspect_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.inspect(table(spark, sf_dir, "events").select("event_type", "props")).select("name", "nulls", "n_unique", "example")


@query(
    "traj_from_reset",
    "WITH a AS (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) "
    "SELECT event_id, CAST(sum(CASE WHEN value < p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS traj FROM a",
)
def traj_from_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.trajectories_from_resets(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "value", "event_id", ("user_id",)).select("event_id", "traj")


@query("datetime_elapsed", f"WITH {OBS} SELECT traj, CAST(step AS INTEGER) AS step, round(t, 6) AS t FROM obs")
def datetime_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories(spark, sf_dir).select("traj", F.col("step").cast("int").alias("step"), F.round("t", 6).alias("t"))


@query("dup_time_avg", "SELECT user_id AS traj, CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS t, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def dup_time_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("traj"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6).alias("t"), "value")
    return windows.average_duplicates(e, ["value"]).select("traj", "t", F.round("value", 6).alias("value"))


_COLUMNS = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


@query("constant_cols", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) <= 1 AS constant FROM lineitem" for c in _COLUMNS) + ")")
def constant_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*_COLUMNS)
    return readers.inspect(df).select("name", (F.col("n_unique") <= 1).alias("constant"))


@query(
    "param_cols",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, max(d) <= 1e-9 * max(m) AS parameter FROM (SELECT stddev_pop({c}) AS d, max(abs({c})) AS m FROM lineitem GROUP BY l_linenumber)" for c in _COLUMNS) + ")",
)
def param_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parameter_columns(table(spark, sf_dir, "lineitem"), "l_linenumber", _COLUMNS)


@query(
    "spatial_col_detect",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, min(k) > 1 AND max(g) <= max(n) / 2 AS spatial FROM (SELECT count(DISTINCT {c}) AS k FROM lineitem GROUP BY l_suppkey), (SELECT count(DISTINCT {c}) AS g, count(*) AS n FROM lineitem)" for c in _COLUMNS
    )
    + ")",
)
def spatial_col_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.space_columns(table(spark, sf_dir, "lineitem").select("l_suppkey", *_COLUMNS), ["l_suppkey"], _COLUMNS)
    return spark.createDataFrame([(c, c in found) for c in _COLUMNS], "name string, spatial boolean")


_DAILY = """d AS (SELECT user_id AS traj, CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS day, avg(value) AS u FROM events GROUP BY 1, 2),
b AS (SELECT traj, min(day) AS a, max(day) AS z FROM d GROUP BY 1),
g AS (SELECT traj, unnest(generate_series(a, z)) AS day, a FROM b),
grid AS (SELECT g.traj, g.day - g.a AS step, d.u FROM g LEFT JOIN d ON g.traj = d.traj AND g.day = d.day)"""


def daily_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("traj"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6).alias("day"), F.col("value").alias("u"))
    d = windows.average_duplicates(e, ["u"], ("traj", "day"))
    grid = d.groupBy("traj").agg(F.min("day").alias("a"), F.max("day").alias("z")).select("traj", "a", F.explode(F.sequence("a", "z")).alias("day"))
    return grid.join(d, ["traj", "day"], "left").select("traj", (F.col("day") - F.col("a")).alias("step"), "u")


@query("daily_grid", f"WITH {_DAILY} SELECT traj, CAST(step AS BIGINT) AS step, round(u, 6) AS u FROM grid")
def daily_grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_grid(spark, sf_dir).select("traj", "step", F.round("u", 6).alias("u"))


@query(
    "grid_pivot",
    """WITH e AS (SELECT CAST(floor(epoch_us(ts) / 86400e6) AS DOUBLE) AS t, CAST(user_id AS DOUBLE) AS x, value, event_id FROM events), o AS (SELECT t, x, max_by(value, event_id) AS u FROM e GROUP BY 1, 2),
s AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS step FROM (SELECT DISTINCT t FROM e)), n AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS ix FROM (SELECT DISTINCT x FROM e))
SELECT CAST(step AS INTEGER) AS step, CAST(ix AS INTEGER) AS ix, round(u, 6) AS u FROM s CROSS JOIN n LEFT JOIN o ON o.t = s.t AND o.x = n.x""",
)
def grid_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days by users: every cell, null where a user has no event that day, the last event of several."""
    e = table(spark, sf_dir, "events").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6).alias("day"), "user_id", "value", "event_id", F.lit(0).alias("_traj"))
    frames = ingest.to_grid(e, ingest.Layout("pde", "day", None, ["user_id"], ["value"], [], [], "event_id"))
    return frames.select("step", F.posexplode("value").alias("ix", "u")).select("step", "ix", F.round("u", 6).alias("u"))


@query(
    "gap_fill_linear",
    f"""WITH {_DAILY}, f AS (SELECT traj, step, u, last_value(CASE WHEN u IS NOT NULL THEN step END IGNORE NULLS) OVER b AS x0, last_value(u IGNORE NULLS) OVER b AS y0,
  first_value(CASE WHEN u IS NOT NULL THEN step END IGNORE NULLS) OVER a AS x1, first_value(u IGNORE NULLS) OVER a AS y1 FROM grid
  WINDOW b AS (PARTITION BY traj ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY traj ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT traj, CAST(step AS BIGINT) AS step, round(CASE WHEN u IS NOT NULL THEN u WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (step - x0) / (x1 - x0) END, 6) AS u FROM f""",
)
def gap_fill_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.fill_gaps(daily_grid(spark, sf_dir), ["u"]).select("traj", "step", F.round("u", 6).alias("u"))


@query(
    "longest_gap",
    f"""WITH {_DAILY}, i AS (SELECT traj, u IS NULL AS m, row_number() OVER (PARTITION BY traj ORDER BY step) - row_number() OVER (PARTITION BY traj, u IS NULL ORDER BY step) AS k FROM grid),
r AS (SELECT traj, k, count(*) AS n FROM i WHERE m GROUP BY 1, 2)
SELECT g.traj, CAST(coalesce(max(r.n), 0) AS BIGINT) AS longest_gap FROM (SELECT DISTINCT traj FROM grid) g LEFT JOIN r ON r.traj = g.traj GROUP BY 1""",
)
def longest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.longest_gap(daily_grid(spark, sf_dir), "u")


@query(
    "time_sampling",
    f"""WITH {OBS}, s AS (SELECT traj, t - lag(t) OVER w AS d FROM obs {W}), m AS (SELECT traj, median(d) AS dt FROM s WHERE d IS NOT NULL GROUP BY 1)
SELECT s.traj, round(m.dt, 6) AS dt, round(max(abs(d / dt - 1)), 6) AS deviation, CAST(count(*) FILTER (d > 3 * dt) AS BIGINT) AS gaps, CAST(count(*) + 1 AS BIGINT) AS n_rows FROM s JOIN m USING (traj) WHERE d IS NOT NULL GROUP BY s.traj, m.dt""",
)
def time_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sampling(trajectories(spark, sf_dir), order=("step",)).select("traj", F.round("dt", 6).alias("dt"), F.round("deviation", 6).alias("deviation"), "gaps", F.col("rows").alias("n_rows"))


@query("step_change", f"WITH {OBS} SELECT round(avg(d) / (stddev_pop(u) + 1e-12), 8) AS u FROM (SELECT u, abs(u - lag(u) OVER w) AS d FROM obs {W})")
def step_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.step_change(trajectories(spark, sf_dir), ["u"]).select(F.round("u", 8).alias("u"))


@query(
    "unwrap_angle",
    f"""WITH {OBS}, a AS (SELECT traj, step, u % 360 AS p FROM obs), d AS (SELECT *, p - lag(p) OVER w AS d FROM a {W}),
c AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < 180 THEN 0 ELSE (CASE WHEN d - floor((d + 180) / 360) * 360 = -180 AND d > 0 THEN 180 ELSE d - floor((d + 180) / 360) * 360 END) - d END AS f FROM d)
SELECT traj, CAST(step AS INTEGER) AS step, round(p + sum(f) OVER (PARTITION BY traj ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 5) AS angle FROM c""",
)
def unwrap_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = trajectories(spark, sf_dir).withColumn("angle", F.col("u") % 360)
    return windows.unwrap(a, "angle", 360.0).select("traj", F.col("step").cast("int").alias("step"), F.round("angle", 5).alias("angle"))


# --- smoothing and noise


def _savgol_sql(d: int) -> str:
    return _weights("u", N.savgol_weights(7, 3, d), range(-3, 4))


@query("savgol_smooth", f"WITH {OBS}, s AS (SELECT traj, step, {_savgol_sql(0)} AS v FROM obs {W}) SELECT traj, CAST(step AS INTEGER) AS step, round(v, 6) AS u_s FROM s WHERE v IS NOT NULL")
def savgol_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.smooth_and_differentiate(trajectories(spark, sf_dir), ["u"], 1.0, 7, ends=False)
    return s.where("u_s is not null").select("traj", F.col("step").cast("int").alias("step"), F.round("u_s", 6).alias("u_s"))


@query("savgol_deriv", f"WITH {OBS}, s AS (SELECT traj, step, {_savgol_sql(1)} AS v FROM obs {W}) SELECT traj, CAST(step AS INTEGER) AS step, round(v, 6) AS u_t FROM s WHERE v IS NOT NULL")
def savgol_deriv(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.smooth_and_differentiate(trajectories(spark, sf_dir), ["u"], 1.0, 7, ends=False)
    return s.where("u_t is not null").select("traj", F.col("step").cast("int").alias("step"), F.round("u_t", 6).alias("u_t"))


@query(
    "savgol_ends",
    f"WITH {OBS}, s AS (SELECT traj, step, {_weights('u', N.savgol_weights(7, 3, 0, 0), range(0, 7))} AS v FROM obs {W}) SELECT traj, round(v, 6) AS u_s FROM s WHERE step = 0",
)
def savgol_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.smooth_and_differentiate(trajectories(spark, sf_dir), ["u"], 1.0, 7)
    return s.where("step = 0").select("traj", F.round("u_s", 6).alias("u_s"))


@query(
    "central_diff",
    f"WITH {OBS} SELECT traj, CAST(step AS INTEGER) AS step, round(coalesce((lead(u) OVER w - lag(u) OVER w) / 2, lead(u) OVER w - u, u - lag(u) OVER w), 6) AS u_t FROM obs {W}",
)
def central_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.smooth_and_differentiate(trajectories(spark, sf_dir), ["u"], 1.0, method="fd")
    return s.select("traj", F.col("step").cast("int").alias("step"), F.round("u_t", 6).alias("u_t"))


@query(
    "third_diff_noise",
    f"WITH {OBS}, d AS (SELECT {_weights('u', (-1, 3, -3, 1), (-3, -2, -1, 0))} AS d FROM obs {W}), m AS (SELECT median(d) AS m FROM d) SELECT round(median(abs(d - m)) * 1.4826 / sqrt(20), 6) AS noise FROM d, m WHERE d IS NOT NULL",
)
def third_diff_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weakform.noise_level(trajectories(spark, sf_dir), "u").select(F.round("noise", 6).alias("noise"))


@query(
    "noise_rel",
    f"WITH {OBS}, s AS (SELECT u, {_savgol_sql(0)} AS v FROM obs {W}) SELECT round(stddev_pop(u - v) * 1.6 / (stddev_pop(u) + 1e-12), 8) AS noise FROM s WHERE v IS NOT NULL",
)
def noise_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.smooth_and_differentiate(trajectories(spark, sf_dir), ["u"], 1.0, 7, ends=False).where("u_s is not null")
    return s.agg(F.round(F.stddev_pop(F.col("u") - F.col("u_s")) * 1.6 / (F.stddev_pop("u") + 1e-12), 8).alias("noise"))


_STATE = ("l_quantity", "l_discount", "l_tax")


@query(
    "ranges_mean_std",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most, round(avg({c}), 8) AS mean, round(stddev_pop({c}), 8) AS std, min({c}) > 0 AS positive FROM lineitem" for c in _STATE) + ")",
)
def ranges_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in _STATE])
    return diagnostics.ranges(df, _STATE).withColumns({"mean": F.round("mean", 8), "std": F.round("std", 8)})


@query(
    "sum_invariance",
    "WITH a AS (SELECT l_suppkey AS traj, l_quantity + l_discount + l_tax AS s FROM lineitem), b AS (SELECT traj, stddev_pop(s) AS d, sum(abs(s)) AS a, count(s) AS n FROM a GROUP BY 1) SELECT round(avg(d) / (sum(a) / sum(n) + 1e-12), 8) AS sum_variation FROM b",
)
def sum_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "traj")
    return diagnostics.sum_variation(df, _STATE).select(F.round("sum_variation", 8).alias("sum_variation"))


@query(
    "per_traj_invariance",
    "SELECT l_suppkey AS traj, round(stddev_pop(l_quantity) / (abs(avg(l_quantity)) + 1e-12), 8) AS variation FROM lineitem GROUP BY 1",
)
def per_traj_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.variation(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "traj"), "l_quantity")
    return out.select("traj", F.round("variation", 8).alias("variation"))


@query(
    "power_spectrum",
    f"""WITH {OBS}, m AS (SELECT traj, avg(u) AS m, count(*) AS n FROM obs GROUP BY 1),
r AS (SELECT o.traj, step AS j, u - m AS u, n, unnest(range(1, 13)) AS k FROM obs o JOIN m USING (traj)),
s AS (SELECT traj, k, sum(u * cos(({2 * np.pi!r}) / n * j * k)) AS c, sum(u * sin(({2 * np.pi!r}) / n * j * k)) AS s FROM r GROUP BY 1, 2) SELECT traj, CAST(k AS INTEGER) AS k, round(c * c + s * s, 2) AS power FROM s""",
)
def power_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.power_spectrum(trajectories(spark, sf_dir), "u", 12).select("traj", "k", F.round("power", 2).alias("power"))


_HIST = f"""{OBS}, e AS (SELECT min(t) AS a0, max(t) AS a1, min(u) AS b0, max(u) AS b1 FROM obs),
c AS (SELECT CAST(least(floor((t - a0) / (a1 - a0) * 8), 7) AS INTEGER) AS i, CAST(least(floor((u - b0) / (b1 - b0) * 8), 7) AS INTEGER) AS j, CAST(count(*) AS BIGINT) AS n FROM obs, e GROUP BY 1, 2)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.occupied_cells(trajectories(spark, sf_dir), "t", "u")


@query("hist2d_coverage", f"WITH {_HIST} SELECT * FROM c")
def hist2d_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query(
    "empty_neighbour_cells",
    f"WITH {_HIST}, n AS (SELECT DISTINCT i + a AS i, j + b AS j FROM c, (VALUES (-1), (0), (1)) AS x(a), (VALUES (-1), (0), (1)) AS y(b)) SELECT i, j FROM n WHERE i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 7 AND NOT EXISTS (SELECT 1 FROM c WHERE c.i = n.i AND c.j = n.j)",
)
def empty_neighbour_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.empty_neighbours(_cells(spark, sf_dir))


@query(
    "additive_bins",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem), m AS (SELECT avg(l_quantity) AS m FROM lineitem),
b AS (SELECT (l_extendedprice > q[1])::INT + (l_extendedprice > q[2])::INT + (l_extendedprice > q[3])::INT AS bin, l_quantity, l_extendedprice FROM lineitem, q)
SELECT 'l_extendedprice' AS variable, bin, CAST(count(*) AS BIGINT) AS n, round(avg(l_extendedprice), 4) AS middle, round(avg(l_quantity) - max(m), 6) AS effect FROM b, m GROUP BY bin""",
)
def additive_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.additive_components(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_extendedprice"], bins=4, sweeps=1)
    return out.select("variable", "bin", "n", F.round("middle", 4).alias("middle"), F.round("effect", 6).alias("effect"))


def _moment_sql(terms: dict[str, str], y: str, source: str) -> str:
    x = list(terms.values())
    parts = [f"round(sum(({a}) * ({b})), 2) AS xx_{i}_{j}" for i, a in enumerate(x) for j, b in enumerate(x) if j >= i]
    parts += [f"round(sum(({a}) * ({y})), 2) AS xy_{i}_0" for i, a in enumerate(x)]
    return f"SELECT {', '.join(parts)}, round(sum(({y}) * ({y})), 2) AS yy_0, CAST(count(*) AS BIGINT) AS n FROM {source}"


def _rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c != "n" else F.col(c) for c in df.columns])


_LIB = library.build_library(["l_quantity", "l_discount"], 2, names=["l_quantity", "l_discount"])


@fact("poly_library", "SELECT * FROM (VALUES (0, '1'), (1, 'l_quantity'), (2, 'l_discount'), (3, 'l_quantity*l_quantity'), (4, 'l_quantity*l_discount'), (5, 'l_discount*l_discount')) AS v(place, term)")
def poly_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(_LIB)], "place int, term string")


@query("gram_matrix", _moment_sql({t: e.sql() for t, e in _LIB.items()}, "l_tax", "lineitem"))
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(gram.wide_gram(table(spark, sf_dir, "lineitem"), library.columns(_LIB), {"l_tax": F.col("l_tax").cast("double")}))


@query(
    "block_gram",
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT l_returnflag AS grp, {i} AS i, {j} AS j, round(sum(({a}) * ({b})), 2) AS v FROM lineitem GROUP BY 1" for (i, a), (j, b) in itertools.combinations_with_replacement(list(enumerate(e.sql() for e in _LIB.values())), 2))
    + ")",
)
def block_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gram.grams(table(spark, sf_dir, "lineitem"), library.columns(_LIB), {"y": F.col("l_tax")}, "l_returnflag")
    rows = [(k, i, j, round(float(g.xx[i, j]), 2)) for k, g in found.items() for i in range(len(_LIB)) for j in range(i, len(_LIB))]
    return spark.createDataFrame(rows, "grp string, i int, j int, v double")


@query(
    "shape_moments",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT CAST({k!r} AS DOUBLE) AS scale, round(sum(z), 6) AS s1, round(sum(z * z), 6) AS s2, round(sum(z * l_tax), 6) AS sy FROM (SELECT l_quantity / ({k!r} + l_quantity) AS z, l_tax FROM lineitem)" for k in (5.0, 20.0, 50.0)) + ")",
)
def shape_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", F.explode(F.array(*[F.lit(k) for k in (5.0, 20.0, 50.0)])).alias("scale"))
    z = parse("l_quantity/(scale + l_quantity)").column()
    return df.groupBy("scale").agg(F.round(F.sum(z), 6).alias("s1"), F.round(F.sum(z * z), 6).alias("s2"), F.round(F.sum(z * F.col("l_tax")), 6).alias("sy"))


_CROSS = {"1": "1.0", "a": "l_quantity", "b": "l_discount", "ab": "l_quantity * l_discount"}


@query("interaction_moments", _moment_sql({**_CROSS, "1": "CAST(1 AS DOUBLE)"}, "l_tax", "lineitem"))
def interaction_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(gram.wide_gram(table(spark, sf_dir, "lineitem"), {k: parse(v).column() for k, v in _CROSS.items()}, {"y": F.col("l_tax").cast("double")}))


@query(
    "ridge_2x2",
    "WITH s AS (SELECT count(*) AS n, sum(l_quantity) AS x, sum(l_quantity * l_quantity) AS xx, sum(l_extendedprice) AS y, sum(l_quantity * l_extendedprice) AS xy FROM lineitem) SELECT round((y * xx - x * xy) / (n * xx - x * x), 4) AS intercept, round((n * xy - x * y) / (n * xx - x * x), 6) AS slope FROM s",
)
def ridge_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = {"1": F.lit(1.0), "x": F.col("l_quantity").cast("double")}
    row = gram.wide_gram(table(spark, sf_dir, "lineitem"), terms, {"y": F.col("l_extendedprice").cast("double")}).first()
    c = regression.solve(gram.from_wide(row, ["1", "x"], ["y"]), 0)
    return spark.createDataFrame([(round(float(c[0]), 4), round(float(c[1]), 6))], "intercept double, slope double")


@query("split_last_traj", f"WITH {OBS} SELECT traj = (SELECT max(traj) FROM obs) AS held, CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY 1")
def split_last_traj(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, held = library.split_rows(trajectories(spark, sf_dir))
    return rows.groupBy(held.alias("held")).agg(F.count("*").alias("n"))


_BUMP, _DBUMP = weakform.bump(6, 4), -weakform.bump(6, 4, 1)


@query(
    "weak_projection",
    f"WITH {OBS}, p AS (SELECT traj, step, {_weights('u', _BUMP, range(-6, 7))} AS x, {_weights('u', _DBUMP, range(-6, 7))} AS y, lag(u, 6) OVER w AS a, lead(u, 6) OVER w AS b FROM obs {W}) "
    "SELECT traj, CAST(step AS INTEGER) AS step, round(x, 5) AS x0, round(y, 5) AS y0 FROM p WHERE step % 3 = 0 AND x IS NOT NULL AND y IS NOT NULL",
)
def weak_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weakform.weak_ode_rows(trajectories(spark, sf_dir), ["u"], {"u": parse("u")}, 1.0, 6, 4, 3)
    return rows.select("traj", F.col("step").cast("int").alias("step"), F.round("x0", 5).alias("x0"), F.round("y0", 5).alias("y0"))


# --- folds, blocks, comparison


_FOLD = f"WITH {OBS}, f AS (SELECT *, traj % 4 AS fold FROM obs)"


@query("fold_gram", f"{_FOLD} SELECT fold, CAST(count(*) AS BIGINT) AS n, round(sum(u), 3) AS s1, round(sum(u * u), 2) AS s2, round(sum(u * step), 2) AS sy FROM f GROUP BY 1")
def fold_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = trajectories(spark, sf_dir).withColumn("fold", F.col("traj") % 4)
    found = gram.grams(f, {"1": F.lit(1.0), "u": F.col("u")}, {"step": F.col("step")}, "fold")
    return spark.createDataFrame([(int(k), int(g.n), round(float(g.xx[0, 1]), 3), round(float(g.xx[1, 1]), 2), round(float(g.xy[1, 0]), 2)) for k, g in found.items()], "fold long, n long, s1 double, s2 double, sy double")


@query(
    "cv_error",
    f"""{_FOLD}, s AS (SELECT fold, count(*) AS n, sum(u) AS x, sum(u * u) AS xx, sum(step) AS y, sum(u * step) AS xy, sum(step * step) AS yy FROM f GROUP BY 1),
r AS (SELECT s.fold, s.n AS hn, s.x AS hx, s.xx AS hxx, s.y AS hy, s.xy AS hxy, s.yy AS hyy, t.n - s.n AS n, t.x - s.x AS x, t.xx - s.xx AS xx, t.y - s.y AS y, t.xy - s.xy AS xy
  FROM s, (SELECT sum(n) AS n, sum(x) AS x, sum(xx) AS xx, sum(y) AS y, sum(xy) AS xy FROM s) t),
c AS (SELECT *, (y * xx - x * xy) / (n * xx - x * x) AS a, (n * xy - x * y) / (n * xx - x * x) AS b FROM r)
SELECT fold, round(sqrt((hyy - 2 * (a * hy + b * hxy) + a * a * hn + 2 * a * b * hx + b * b * hxx) / hyy), 8) AS error FROM c""",
)
def cv_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = trajectories(spark, sf_dir).withColumn("fold", F.col("traj") % 4)
    found = gram.grams(f, {"1": F.lit(1.0), "u": F.col("u")}, {"step": F.col("step")}, "fold")
    errors = uncertainty.cross_validated(found, 0, lambda g, k: regression.solve(g, k))
    return spark.createDataFrame([(int(k), round(e, 8)) for k, e in errors.items()], "fold long, error double")


@query(
    "aicc_bic",
    f"""WITH {OBS}, s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(u) AS x, sum(u * u) AS xx, sum(step) AS y, sum(u * step) AS xy, sum(step * step) AS yy FROM obs),
c AS (SELECT *, (y * xx - x * xy) / (n * xx - x * x) AS a, (n * xy - x * y) / (n * xx - x * x) AS b FROM s),
r AS (SELECT n, n * ln((yy - 2 * (a * y + b * xy) + a * a * n + 2 * a * b * x + b * b * xx) / n) AS f FROM c) SELECT round(f + 4 + 12 / (n - 3), 4) AS aicc, round(f + 2 * ln(n), 4) AS bic FROM r""",
)
def aicc_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gram.grams(trajectories(spark, sf_dir), {"1": F.lit(1.0), "u": F.col("u")}, {"step": F.col("step")})[None]
    x = regression.information(g.rss(regression.solve(g, 0), 0), g.n, 2)
    return spark.createDataFrame([(round(float(x["aicc"]), 4), round(float(x["bic"]), 4))], "aicc double, bic double")


@query(
    "paired_block_z",
    f"""WITH {OBS}, e AS (SELECT traj, step // 10 AS block, (u - 50) * (u - 50) - (u - 60) * (u - 60) AS d FROM obs), b AS (SELECT traj, block, avg(d) AS d FROM e GROUP BY 1, 2)
SELECT CAST(count(*) AS BIGINT) AS blocks, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 8) AS z FROM b""",
)
def paired_block_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = trajectories(spark, sf_dir).select("traj", F.floor(F.col("step") / 10).alias("block"), ((F.col("u") - 50) * (F.col("u") - 50) - (F.col("u") - 60) * (F.col("u") - 60)).alias("d"))
    return uncertainty.paired_z(d, "d", ("traj", "block")).select("blocks", F.round("z", 8).alias("z"))




@query(
    "block_bootstrap_ci",
    f"""WITH {OBS}, s AS (SELECT traj, step // 10 AS k, sum(u) AS s, count(*) AS n FROM obs GROUP BY 1, 2),
d AS (SELECT bag, s, n, ((bag * 7919 + traj * 104729 + k * 1299709) % 1000003) / 1000003.0 AS x FROM s, (SELECT unnest(range(0, 40)) AS bag)),
e AS (SELECT bag, sum(w * s) / sum(w * n) AS v FROM (SELECT bag, s, n, {" + ".join(f"(x >= {p!r})::INT" for p in uncertainty.POISSON)} AS w FROM d) GROUP BY 1)
SELECT round(quantile_cont(v, 0.05), 6) AS q05, round(median(v), 6) AS q50, round(quantile_cont(v, 0.95), 6) AS q95 FROM e""",
)
def block_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = trajectories(spark, sf_dir).select("traj", F.floor(F.col("step") / 10).alias("k"), "u").groupBy("traj", "k").agg(F.sum("u").alias("s"), F.count("*").alias("n"))
    means = uncertainty.block_bootstrap_mean(blocks, 40)
    q = means.agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    return q.select(*[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q05", "q50", "q95"))])


@query(
    "inclusion_prob",
    f"""WITH {OBS}, b AS (SELECT traj % 16 AS block, u, step FROM obs), s AS (SELECT block, count(*) AS n, sum(u) AS x, sum(u * u) AS xx, sum(step) AS y, sum(u * step) AS xy FROM b GROUP BY 1),
d AS (SELECT bag, ((bag * 7919 + slot * 104729) % 1000003) % 16 AS block FROM (SELECT unnest(range(0, 50)) AS bag) p, (SELECT unnest(range(0, 16)) AS slot) q),
e AS (SELECT bag, sum(n) AS n, sum(x) AS x, sum(xx) AS xx, sum(y) AS y, sum(xy) AS xy FROM d JOIN s USING (block) GROUP BY 1) SELECT round(avg(CASE WHEN (n * xy - x * y) / (n * xx - x * x) > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM e""",
)
def inclusion_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gram.grams(trajectories(spark, sf_dir).withColumn("block", F.col("traj") % 16), {"1": F.lit(1.0), "u": F.col("u")}, {"step": F.col("step")}, "block")
    blocks = {int(k): g for k, g in found.items()}
    share = np.mean([regression.solve(g, 0)[1] > 0 for g in uncertainty.bags(blocks, 50, 16)])
    return spark.createDataFrame([(round(float(share), 6),)], "positive double")


# --- coordinates


@query("coord_log", "SELECT l_returnflag AS grp, round(avg(ln(l_extendedprice)), 8) AS mean, round(stddev_pop(ln(l_extendedprice)), 8) AS std FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1")
def coord_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = parse("log(l_extendedprice)").column()
    return table(spark, sf_dir, "lineitem").where("l_extendedprice > 0").groupBy(F.col("l_returnflag").alias("grp")).agg(F.round(F.avg(z), 8).alias("mean"), F.round(F.stddev_pop(z), 8).alias("std"))


@query("coord_polar", "SELECT l_linenumber AS grp, round(avg(sqrt(x * x + y * y)), 8) AS r, round(avg(atan2(y, x)), 8) AS theta FROM (SELECT l_linenumber, l_quantity - 25 AS x, (l_discount - 0.05) * 100 AS y FROM lineitem) GROUP BY 1")
def coord_polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_quantity") - 25).cast("double").alias("x"), ((F.col("l_discount") - F.lit(0.05)) * 100).cast("double").alias("y"))
    r, theta = parse("sqrt(x**2 + y**2)").column(), parse("atan2(y, x)").column()
    return df.groupBy(F.col("l_linenumber").alias("grp")).agg(F.round(F.avg(r), 8).alias("r"), F.round(F.avg(theta), 8).alias("theta"))


@query("covariance_pca_input", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}), 6) AS v FROM lineitem" for a, b in itertools.combinations_with_replacement(_STATE, 2)) + ")")
def covariance_pca_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.covar_pop(a, b), 6).alias("v")) for a, b in itertools.combinations_with_replacement(_STATE, 2)]
    return table(spark, sf_dir, "lineitem").agg(F.array(*cells).alias("x")).select(F.inline("x"))


_NEAR = "d AS (SELECT q.vec_id AS a, e.vec_id AS b, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2]))) AS d FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM d)"


@query("knn_support", f"WITH {_NEAR} SELECT a AS vec_id, CAST(k AS INTEGER) AS place, round(sqrt(d), 4) AS distance FROM k WHERE k <= 5")
def knn_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.symmetry import nearest

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return nearest(e.where("id % 20 = 0"), e, 5).select(F.col("id").alias("vec_id"), "place", F.round("distance", 4).alias("distance"))


@query("density_weights", f"WITH {_NEAR} SELECT a AS vec_id, round(sqrt(max(d)), 4) AS radius FROM k WHERE k <= 10 GROUP BY 1")
def density_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.symmetry import nearest

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return nearest(e.where("id % 20 = 0"), e, 10).groupBy(F.col("id").alias("vec_id")).agg(F.round(F.max("distance"), 4).alias("radius"))


# --- scoring

_PRED = f"{OBS}, p AS (SELECT traj, step, t, u, 0.6 * u + 0.4 * lag(u) OVER w AS v FROM obs {W}), q AS (SELECT * FROM p WHERE v IS NOT NULL)"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = trajectories(spark, sf_dir)
    return df.withColumn("v", 0.6 * F.col("u") + 0.4 * F.lag("u").over(windows.along())).where("v is not null")


@query("nrmse", f"WITH {_PRED} SELECT traj, round(least(sqrt(avg((v - u) * (v - u))) / (sqrt(avg(u * u)) + 1e-12), 10), 8) AS nrmse FROM q GROUP BY 1")
def nrmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir).groupBy("traj").agg(F.round(scoring.nrmse(F.col("v"), F.col("u")), 8).alias("nrmse"))


@query(
    "valid_time",
    f"WITH {_PRED}, e AS (SELECT traj, t, sqrt((v - u) * (v - u)) / (sqrt(u * u) + 1e-12) AS e FROM q) SELECT traj, round(coalesce(min(CASE WHEN e > 0.3 THEN t END), max(t)) - min(t), 6) AS valid_time, round(max(t) - min(t), 6) AS horizon FROM e GROUP BY 1",
)
def valid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predicted(spark, sf_dir)
    e = scoring.step_errors(p.select("traj", "step", "t", F.col("v").alias("u")), p.select("traj", "step", "u"), ["u"])
    return scoring.valid_time(e).select("traj", F.round("valid_time", 6).alias("valid_time"), F.round("horizon", 6).alias("horizon"))


@query(
    "score_formula",
    f"WITH {_PRED}, n AS (SELECT traj, least(sqrt(avg((v - u) * (v - u))) / (sqrt(avg(u * u)) + 1e-12), 10) AS e FROM q GROUP BY 1) SELECT traj, round(0.5 * least(-log10(greatest(e, 1e-12)), 6) + 0.5 * least(-log10(greatest(e, 1e-12)), 6) + 0.5 * 0.25 - 0.02 * 3, 8) AS score FROM n",
)
def score_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _predicted(spark, sf_dir).groupBy("traj").agg(scoring.nrmse(F.col("v"), F.col("u")).alias("e"))
    return e.select("traj", F.round(scoring.score_column(F.col("e"), F.col("e"), F.lit(0.25), F.lit(3)), 8).alias("score"))


_MODELS = ((0.9, 0.1), (1.1, -0.2), (0.7, 0.3))


@query(
    "experiment_rank",
    "WITH c AS (SELECT o_orderkey AS candidate, o_totalprice / 100000 AS x FROM orders), "
    f"m AS (SELECT * FROM (VALUES {', '.join(f'({k}, {a}, {b})' for k, (a, b) in enumerate(_MODELS))}) AS m(model, a, b)), "
    "s AS (SELECT candidate, avg(least(power(d / 0.05, 2), 100)) AS score FROM (SELECT candidate, step, stddev_pop(a * x + b * x * x * step) AS d FROM c, m, (SELECT unnest(range(1, 5)) AS step) GROUP BY 1, 2) GROUP BY 1) "
    "SELECT candidate, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 6) DESC, candidate) AS INTEGER) AS place FROM s QUALIFY place <= 5",
)
def experiment_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.assess import disagreement

    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate"), (F.col("o_totalprice") / 100000).cast("double").alias("x"))
    m = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(_MODELS)], "model int, a double, b double")
    runs = c.crossJoin(F.broadcast(m)).select("candidate", "model", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("step"), "a", "b", "x").withColumn("u", F.col("a") * F.col("x") + F.col("b") * F.col("x") * F.col("x") * F.col("step"))
    ranked = disagreement(runs, {"u": 0.05}).withColumn("score", F.round("score", 6))
    return scoring.rank(ranked, [], [F.desc("score"), F.col("candidate")], 5).select("candidate", "score", "place")


@query(
    "predictability_horizon",
    f"WITH {OBS}, s AS (SELECT step, stddev_pop(u) AS spread FROM obs GROUP BY 1) SELECT CAST(coalesce(min(CASE WHEN spread > 60 THEN step END), max(step)) AS INTEGER) AS horizon FROM s",
)
def predictability_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = trajectories(spark, sf_dir).groupBy("step").agg(F.stddev_pop("u").alias("spread"))
    return s.agg(F.coalesce(F.min(F.when(F.col("spread") > 60, F.col("step"))), F.max("step")).cast("int").alias("horizon"))


# --- lessons

_WORDS = "w AS (SELECT event_type AS id, list_distinct(list(CAST(floor(value / 10) AS VARCHAR))) AS w FROM events GROUP BY 1)"


@query(
    "term_jaccard",
    f"WITH {_WORDS} SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 8) AS jaccard FROM w a JOIN w b ON a.id < b.id",
)
def term_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word sets of the kinds of events, which are a handful, against one another."""
    w = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("id")).agg(F.collect_set(F.floor(F.col("value") / 10).cast("string")).alias("w"))
    p = w.select(F.col("id").alias("a"), F.col("w").alias("x")).join(w.select(F.col("id").alias("b"), F.col("w").alias("y")), F.col("a") < F.col("b"))
    return p.select("a", "b", F.round(memory.jaccard("x", "y"), 8).alias("jaccard"))


@query(
    "lesson_topk",
    "SELECT p_brand AS lesson, round(2.0 * max((p_size % 2 = 0)::INT) + 1 / (1 + abs(avg(p_retailprice) / 1000 - 1.4) * 20), 8) AS score FROM part GROUP BY 1 ORDER BY round(2.0 * max((p_size % 2 = 0)::INT) + 1 / (1 + abs(avg(p_retailprice) / 1000 - 1.4) * 20), 8) DESC, 1 LIMIT 8",
)
def lesson_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("lesson")).agg(F.max((F.col("p_size") % 2 == 0).cast("int")).alias("same"), (F.avg("p_retailprice") / 1000).cast("double").alias("noise"))
    s = p.withColumn("score", F.round(2.0 * F.col("same") + 1 / (1 + F.abs(F.col("noise") - 1.4) * 20), 8))
    return scoring.rank(s, [], [F.desc("score"), F.col("lesson")], 8).select("lesson", "score")


# --- streaming (beyond the comparison): the same aggregate as a batch

@query(
    "tumbling_rates",
    "SELECT event_type, CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
)
def tumbling_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rates.tumbling(table(spark, sf_dir, "events"), "1 day", "ts", ["event_type"], "value")
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("day"), "n", F.round("mean", 6).alias("mean"))


# --- what SQL can't express: rows only, held by tests against NumPy


@fact("stlsq_path")
def stlsq_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = SYSTEMS["lorenz"]
    out = sindy.run_sindy(simulate(spark, s, 3, t_end=4), s.variables, s.dt, degree=2, window=5)
    return spark.createDataFrame([(v, r["threshold"], r["n_terms"], r["val_err"], r["model"]) for v, p in out["path"].items() for r in p], "variable string, threshold double, n_terms int, val_err double, model string")


@fact("rollout")
def rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = SYSTEMS["lotka_volterra"]
    return scoring.rollout(simulate(spark, s, 2, t_end=1).where("step = 0"), s.rhs, np.arange(101) * s.dt)


@fact("etdrk4")
def etdrk4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate(spark, "kdv", 1, t_end=1).select("traj", "step", "t", F.posexplode("u").alias("ix", "u"))


# --- operators whose results are known from elsewhere

from . import catalogue_facts, catalogue_scans  # noqa: E402, F401
