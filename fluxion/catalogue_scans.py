"""Registered queries of operators that cut one long trajectory in chunks and hand sums or samples from chunk to chunk: all events as a single trajectory,
cut far below the default size, against one window over everything in SQL; and fields over two axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import OBS, W, query, table, trajectories
from .functions.expressions import parse
from .operators import field_assess, field_intuition, fields, memory, symmetry, uncertainty, weakform, windows
from .operators.datasets import judged
from .operators.systems import System
from .sources import ingest

#: Rows of a chunk in these queries.
CHUNK = 4096


def one_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in the order of their ids: traj 0, step, angle (value modulo 360), u (null on 6 of 7 days)."""
    e = table(spark, sf_dir, "events")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6)
    return e.select(F.lit(0).alias("traj"), F.col("event_id").alias("step"), (F.col("value") % 360).cast("double").alias("angle"), F.when(day % 7 == 0, F.col("value")).cast("double").alias("u"), "ts")


_ONE = "o AS (SELECT event_id AS step, CAST(value % 360 AS DOUBLE) AS angle, CASE WHEN CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) % 7 = 0 THEN CAST(value AS DOUBLE) END AS u, ts FROM events)"


@query(
    "unwrap_in_chunks",
    f"""WITH {_ONE}, d AS (SELECT step, angle, angle - lag(angle) OVER (ORDER BY step) AS d FROM o),
k AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < 180 THEN 0 WHEN d - floor((d + 180) / 360) * 360 = -180 AND d > 0 THEN 1 - floor((d + 180) / 360) ELSE -floor((d + 180) / 360) END AS k FROM d)
SELECT step, round(angle + 360 * sum(k) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 5) AS angle FROM k""",
)
def unwrap_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.unwrap(one_trajectory(spark, sf_dir), "angle", 360.0, chunk=CHUNK).select("step", F.round("angle", 5).alias("angle"))


@query(
    "gap_fill_in_chunks",
    f"""WITH {_ONE}, f AS (SELECT step, u, last_value(CASE WHEN u IS NOT NULL THEN step END IGNORE NULLS) OVER b AS x0, last_value(u IGNORE NULLS) OVER b AS y0,
  first_value(CASE WHEN u IS NOT NULL THEN step END IGNORE NULLS) OVER a AS x1, first_value(u IGNORE NULLS) OVER a AS y1 FROM o
  WINDOW b AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT step, round(CASE WHEN u IS NOT NULL THEN u ELSE coalesce(y0 + (y1 - y0) * (step - x0) / nullif(x1 - x0, 0), y0, y1, 0) END, 6) AS u FROM f""",
)
def gap_fill_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.fill_gaps(one_trajectory(spark, sf_dir), ["u"], chunk=CHUNK).select("step", F.round("u", 6).alias("u"))


@query("rows_numbered_in_chunks", "SELECT event_id, CAST(row_number() OVER (ORDER BY epoch_us(ts) + event_id / 1e7) - 1 AS INTEGER) AS step FROM events")
def rows_numbered_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by a time of doubles, whose range is cut at even distances."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") / 1e7
    e = table(spark, sf_dir, "events").select(F.lit(0).alias("traj"), t.alias("t"), "event_id")
    return windows.numbered(e, "t", chunk=CHUNK).select("event_id", "step")


@query("elapsed_in_parts", "SELECT event_id, round((epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id)) / 3600e6, 6) AS t FROM events")
def elapsed_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours since the first event of a type: a few types hold all rows, and each is dealt to 16 parts."""
    e = windows.elapsed(table(spark, sf_dir, "events"), "ts", ("ts", "event_id"), 3600.0, ("event_type",), salts=16)
    return e.select("event_id", F.round("t", 6).alias("t"))


@query(
    "spline_in_chunks",
    """WITH n AS (SELECT CAST(floor((max(event_id) - min(event_id)) / 0.75 + 1e-9) AS BIGINT) + 1 AS n, min(event_id) AS t0 FROM events)
SELECT CAST(step AS INTEGER) AS step, round(t0 + 0.75 * step, 5) AS t, round(power((t0 + 0.75 * step) / 1000, 3) - (t0 + 0.75 * step) / 1000, 4) AS u FROM n, LATERAL (SELECT unnest(range(0, n)) AS step)""",
)
def spline_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cubic over the events' ids, read at other places from a spline of chunks: not-a-knot splines give cubics exactly."""
    e = table(spark, sf_dir, "events").select(F.lit(0).alias("traj"), F.col("event_id").cast("double").alias("t"), (F.pow(F.col("event_id") / 1000, F.lit(3)) - F.col("event_id") / 1000).alias("u"))
    return ingest.splined(e, ["u"], 0.75, CHUNK).select("step", F.round("t", 5).alias("t"), F.round("u", 4).alias("u"))


@query(
    "grid_two_axes",
    """WITH e AS (SELECT CAST(l_linenumber AS DOUBLE) AS t, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS y, max(l_orderkey) AS o FROM lineitem WHERE l_suppkey % 7 < 5 GROUP BY 1, 2, 3),
s AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS step FROM (SELECT DISTINCT t FROM e)), a AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS ix FROM (SELECT DISTINCT x FROM e)),
b AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS iy, count(*) OVER () AS ny FROM (SELECT DISTINCT y FROM e))
SELECT CAST(step AS INTEGER) AS step, CAST(ix * ny + iy AS INTEGER) AS cell, o AS orderkey FROM s CROSS JOIN a CROSS JOIN b LEFT JOIN e ON e.t = s.t AND e.x = a.x AND e.y = b.y""",
)
def grid_two_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers by quantities and discounts: every cell, row-major, the largest order of each, null where there is none."""
    e = table(spark, sf_dir, "lineitem").where(F.col("l_suppkey") % 7 < 5).select("l_linenumber", "l_quantity", "l_discount", "l_orderkey", F.col("l_orderkey").alias("o"), F.lit(0).alias("_traj"))
    frames = ingest.to_grid(e, ingest.Layout("pde", "l_linenumber", None, ["l_quantity", "l_discount"], ["l_orderkey"], [], [], "o"))
    return frames.select("step", F.posexplode("l_orderkey").alias("cell", "orderkey"))


@query(
    "bracket_sums",
    """WITH s AS (SELECT CAST(l_quantity AS DOUBLE) / 50 AS x, CAST(l_discount AS DOUBLE) * 10 AS y FROM lineitem), b AS (SELECT unnest([{'c': 0, 'u': y, 'v': x}, {'c': 1, 'u': -x, 'v': y}, {'c': 2, 'u': -x, 'v': y}, {'c': 3, 'u': -y, 'v': -x}]) AS b, x, y FROM s),
p AS (SELECT b.c AS a, unnest([{'c': 0, 'w': b.u * y + b.v * x}, {'c': 1, 'w': b.v * y - b.u * x}, {'c': 2, 'w': b.v * y - b.u * x}, {'c': 3, 'w': -b.u * y - b.v * x}]) AS q FROM b)
SELECT CAST(a AS INTEGER) AS a, CAST(q.c AS INTEGER) AS b, round(sum(q.w) / count(*), 6) AS mean FROM p GROUP BY 1, 2""",
)
def bracket_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brackets of the unit matrices with the rotation x' = y, y' = -x, over all line items as states."""
    s = table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("double") / 50).alias("x"), (F.col("l_discount").cast("double") * 10).alias("y"))
    m, _, _ = symmetry.bracket_sums({"x": parse("y", ["x", "y"]), "y": parse("-x", ["x", "y"])}, s)
    n = s.count()
    return spark.createDataFrame([(a, b, round(float(m[a, b]) / n, 6)) for a in range(4) for b in range(4)], "a int, b int, mean double")


@query(
    "models_by_effective_samples",
    """WITH r AS (SELECT l_orderkey AS b, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem), s AS (SELECT avg(y * y) AS q, count(*) / 7.0 AS n FROM r),
m AS (SELECT unnest(['flat', 'line']) AS model), e AS (SELECT model, b, avg(power(CASE model WHEN 'flat' THEN 38000 ELSE 1500 * x END - y, 2) / q) AS e FROM r, s, m GROUP BY 1, 2)
SELECT model, round(sqrt(avg(e)), 6) AS nrmse, round(any_value(n) * ln(avg(e)) + ln(any_value(n)), 3) AS bic FROM e, s GROUP BY 1""",
)
def models_by_effective_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models of a price, orders as blocks, all of them; BIC with a seventh of the rows as samples."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y_t"), F.lit(0.0).alias("y"))
    found = uncertainty.compare_models(rows, {"flat": {"y": "38000"}, "line": {"y": "1500*x"}}, F.col("l_orderkey"), correlation=7.0)["models"]
    return spark.createDataFrame([(m, round(float(v["nrmse"]), 6), round(float(v["bic"]), 3)) for m, v in found.items()], "model string, nrmse double, bic double")


@query(
    "weak_noise_gram",
    f"""WITH {OBS}, n AS (SELECT *, count(*) OVER (PARTITION BY traj) AS n FROM obs), c AS (SELECT traj, step FROM n WHERE traj % 5 = 0 AND step % 2 = 0 AND step >= 3 AND step + 3 < n),
o AS (SELECT o, power(1 - power(o / 4.0, 2), 8) AS phi, o * power(1 - power(o / 4.0, 2), 7) AS dphi FROM (SELECT unnest(range(-4, 5)) AS o)),
z AS (SELECT dphi AS l, phi AS a, phi * 2 * u AS b FROM c, o, obs s WHERE s.traj = c.traj AND s.step = c.step + o)
SELECT unnest(['lhs lhs', 'lhs u', 'lhs u*u', 'u u', 'u u*u', 'u*u u*u']) AS pair, round(unnest([sum(l * l), sum(l * a), sum(l * b), sum(a * a), sum(a * b), sum(b * b)]), 4) AS total FROM z""",
)
def weak_noise_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What unit noise in the events' values does to weak rows of a fifth of the users: left side and terms 1, u, u^2."""
    library = {t: parse(t, ["u"]) for t in ("1", "u", "u*u")}
    g = weakform.noise_grams(trajectories(spark, sf_dir), ["u"], library, 1.0, 4, F.col("traj") % 5 == 0)["u"]
    found = {"lhs lhs": g.yy[0], "lhs u": g.xy[1, 0], "lhs u*u": g.xy[2, 0], "u u": g.xx[1, 1], "u u*u": g.xx[1, 2], "u*u u*u": g.xx[2, 2]}
    return spark.createDataFrame([(k, round(float(v), 4)) for k, v in found.items()], "pair string, total double")


_SMOOTH7 = " + ".join(f"({w}) * lag(u, {k}) OVER w" if k > 0 else f"({w}) * lead(u, {-k}) OVER w" if k < 0 else f"({w}) * u" for k, w in zip(range(3, -4, -1), (-2, 3, 6, 7, 6, 3, -2), strict=True))
_SLOPE7 = " + ".join(f"({w}) * lag({{0}}, {k}) OVER w" if k > 0 else f"({w}) * lead({{0}}, {-k}) OVER w" for k, w in zip((3, 2, 1, -1, -2, -3), (22, -67, -58, 58, 67, -22), strict=True))


@query(
    "calibrated_floor",
    f"""WITH {OBS}, s AS (SELECT *, ({_SMOOTH7}) / 21.0 AS m FROM obs {W}), g AS (SELECT stddev_pop(u - m) / sqrt(1 - 7 / 21.0) AS noise, stddev_pop(u) AS sd FROM s),
a AS (SELECT traj, step, u, list_transform([1, 2], lambda k: (traj * 7919 + step * 104729 + k * 611953) % 2147483647) AS r FROM obs),
b AS (SELECT traj, step, u, list_transform(list_transform(r, lambda x: (x * x) % 2147483647), lambda x: (x * 48271 + 11) % 2147483647) AS r FROM a),
h AS (SELECT traj, step, u, list_transform(list_transform(r, lambda x: (x * x) % 2147483647), lambda x: ((x * 48271 + 11) % 2147483647 + 0.5) / 2147483647.0) AS r FROM b),
e AS (SELECT traj, step, u, noise * sqrt(-2 * ln(r[1])) * cos(2 * pi() * r[2]) AS e FROM h, g),
d AS (SELECT ({_SLOPE7.format('u')}) / 252.0 AS a, ({_SLOPE7.format('e')}) / 252.0 AS b FROM e {W})
SELECT round(any_value(noise), 5) AS noise, round(any_value(noise / sd), 6) AS noise_rel, round(sqrt(avg(b * b)) / sqrt(avg(a * a)), 6) AS floor FROM d, g WHERE a IS NOT NULL""",
)
def calibrated_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = uncertainty.calibrated_floor(trajectories(spark, sf_dir), ["u"], 1.0, 7)["u"]
    return spark.createDataFrame([tuple(round(float(r[k]), n) for k, n in (("noise", 5), ("noise_rel", 6), ("floor", 6)))], "noise double, noise_rel double, floor double")


@query(
    "quotients_judged",
    """WITH p AS (SELECT p_partkey, p_size AS k, p_partkey % 4 AS form, p_partkey % 3 AS edit FROM part)
SELECT p_partkey, CASE WHEN edit = 0 THEN 'equal' WHEN edit = 1 THEN 'close' ELSE 'different' END AS verdict FROM p""",
)
def quotients_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotients written in one of four ways, with the parts' sizes as coefficients, against a/(b + c): as they are, 2 % off or half as large again."""
    k = F.col("p_size").cast("string")
    by = F.element_at(F.array(F.lit("1"), F.lit("1.02"), F.lit("1.5")), (F.col("p_partkey") % 3 + 1).cast("int"))
    forms = ("{by}/(b/({k}*a) + c/({k}*a))", "{by}*{k}*a*b/(b + c)/b", "{by}*{k}*(a**2 - a*c)/((b + c)*(a - c))", "{by}*{k}*a*(1/b - c/(b*(b + c)))")
    text = lambda form: F.replace(F.replace(F.lit(form), F.lit("{by}"), by), F.lit("{k}"), k)
    written = F.element_at(F.array(*[text(f) for f in forms]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return judged(table(spark, sf_dir, "part").select("p_partkey", written.alias("a"), F.concat(k, F.lit("*a/(b + c)")).alias("b")), ["a", "b", "c"]).select("p_partkey", "verdict")


@query(
    "first_of_alike_documents",
    r"""WITH RECURSIVE w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z_]{3,}')) AS w FROM documents),
e AS (SELECT doc_id, len(w) AS n, unnest(w) AS x FROM w),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 160 * count(*) > 60 * (a.n + b.n)),
o AS (SELECT w.doc_id, row_number() OVER (ORDER BY w.doc_id) AS i, coalesce(list(l.a) FILTER (l.a IS NOT NULL), []) AS before FROM w LEFT JOIN l ON l.b = w.doc_id GROUP BY w.doc_id),
g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
  SELECT o.i, CASE WHEN list_has_any(g.kept, o.before) THEN g.kept ELSE list_append(g.kept, o.doc_id) END FROM g JOIN o ON o.i = g.i + 1),
k AS (SELECT unnest(kept) AS doc_id FROM g WHERE i = (SELECT count(*) FROM w))
SELECT w.doc_id, CAST(len(w) AS INTEGER) AS n_words, w.doc_id IN (SELECT doc_id FROM k) AS kept,
  CASE WHEN w.doc_id IN (SELECT doc_id FROM k) THEN w.doc_id ELSE (SELECT min(l.a) FROM l WHERE l.b = w.doc_id AND l.a IN (SELECT doc_id FROM k)) END AS stays_as FROM w""",
)
def first_of_alike_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = memory.first_of_alike(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "n_words", "kept", F.coalesce("resembles", "doc_id").alias("stays_as"))


def hourly_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj (event type), step (day), u: sums of the events' values by hour of the day, a periodic axis of 24 nodes."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("traj"), F.floor(us / 86400e6).alias("step"), F.pmod(F.floor(us / 3600e6), F.lit(24)).alias("h"), "value")
    hours = [F.sum(F.when(F.col("h") == h, F.col("value")).otherwise(0.0)) for h in range(24)]
    return e.groupBy("traj", "step").agg(F.array(*hours).alias("u"))


_HOURLY = """f AS (SELECT event_type AS traj, CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS step, CAST(floor(epoch_us(ts) / 3600e6) AS BIGINT) % 24 AS h, sum(value) AS u FROM events GROUP BY 1, 2, 3)"""


@query(
    "mode_rates",
    f"""WITH {_HOURLY}, z AS (SELECT traj, step, k, sum(u * cos(2 * pi() * k * h / 24)) AS re, -sum(u * sin(2 * pi() * k * h / 24)) AS im FROM f, (SELECT unnest(range(0, 13)) AS k) GROUP BY 1, 2, 3),
s AS (SELECT a.k, sqrt(a.re ** 2 + a.im ** 2) AS amp, sqrt(b.re ** 2 + b.im ** 2) AS next, atan2(b.im * a.re - b.re * a.im, b.re * a.re + b.im * a.im) AS turn FROM z a JOIN z b ON a.traj = b.traj AND a.k = b.k AND b.step = a.step + 1),
c AS (SELECT k, quantile_disc(amp, 0.2) AS cut, avg(amp * amp) AS power FROM s WHERE amp > 0 AND next > 0 GROUP BY 1)
SELECT CAST(s.k AS INTEGER) AS k, round(2 * pi() * s.k / 24, 6) AS wave_number, count(*) AS steps, round(any_value(power), 4) AS power, round(quantile_disc(ln(next / amp), 0.5), 6) AS growth,
  round(CASE WHEN s.k NOT IN (0, 12) THEN quantile_disc(turn, 0.5) END, 6) AS frequency FROM s JOIN c USING (k) WHERE amp >= cut AND amp > 0 AND next > 0 GROUP BY s.k""",
)
def mode_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the modes of a day's profile grow and turn from day to day, hours as nodes."""
    found = field_intuition.mode_rates(hourly_fields(spark, sf_dir), "u", 24.0, 1.0, 8)
    value = lambda x, n: None if x != x else round(float(x), n)
    return spark.createDataFrame(
        [(int(r.k), value(r.wave_number, 6), int(r.steps), value(r.power, 4), value(r.growth, 6), value(r.frequency, 6)) for r in found.itertuples()],
        "k int, wave_number double, steps long, power double, growth double, frequency double",
    )


@query(
    "field_moments",
    f"""WITH {_HOURLY}, g AS (SELECT traj, step, coalesce(f.u, 0) AS u FROM (SELECT DISTINCT traj, step FROM f) d CROSS JOIN (SELECT unnest(range(0, 24)) AS h) n LEFT JOIN f USING (traj, step, h)),
m AS (SELECT traj, step, avg(u) AS m FROM g GROUP BY 1, 2), d AS (SELECT avg(d) AS d FROM (SELECT stddev_pop(m) AS d FROM m GROUP BY traj)), s AS (SELECT stddev_pop(u) AS s, avg(u) AS a FROM g)
SELECT round(any_value(d / s), 8) AS mean_drift, round(avg(power((u - a) / s, 3)), 8) AS skewness, round(any_value(a / s), 8) AS offset_mean FROM g, s, d""",
)
def field_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = field_intuition.moments(hourly_fields(spark, sf_dir), "u")
    return m.select(F.round("mean_drift", 8).alias("mean_drift"), F.round("skewness", 8).alias("skewness"), F.round("offset", 8).alias("offset_mean"))


@query(
    "travelling_shift",
    f"""WITH {_HOURLY}, g AS (SELECT traj, step, h, coalesce(f.u, 0) AS u FROM (SELECT DISTINCT traj, step FROM f) d CROSS JOIN (SELECT unnest(range(0, 24)) AS h) n LEFT JOIN f USING (traj, step, h)),
p AS (SELECT traj, step, max(u) - min(u) AS size FROM g GROUP BY 1, 2),
c AS (SELECT a.traj, a.step, k, sum(a.u * b.u) AS c FROM g a JOIN (SELECT unnest(range(0, 24)) AS k) ON true JOIN g b ON b.traj = a.traj AND b.step = a.step + 1 AND b.h = (a.h + k) % 24 GROUP BY 1, 2, 3),
s AS (SELECT traj, step, arg_max(k, c) AS k FROM c GROUP BY 1, 2),
w AS (SELECT CASE WHEN k > 12 THEN k - 24 ELSE k END AS v, size FROM s JOIN p USING (traj, step))
SELECT median(v)::DOUBLE AS median, (quantile_cont(v::DOUBLE, 0.75) - quantile_cont(v::DOUBLE, 0.25)) AS iqr, round(corr(v, size), 6) AS correlation FROM w""",
)
def travelling_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift by which a day's profile is most like the next day's, in hours."""
    r = fields.travelling_speed(hourly_fields(spark, sf_dir), "u", 24, 24.0, 1.0, 8)
    return spark.createDataFrame([(r["median"], r["iqr"], round(r["amplitude_correlation"], 6))], "median double, iqr double, correlation double")


@query(
    "field_coverage",
    f"""WITH {_HOURLY}, g AS (SELECT traj, step, h, coalesce(f.u, 0) AS u FROM (SELECT DISTINCT traj, step FROM f) d CROSS JOIN (SELECT unnest(range(0, 24)) AS h) n LEFT JOIN f USING (traj, step, h)),
d AS (SELECT traj, step, lead(u, 3) OVER w - 3 * lead(u, 2) OVER w + 3 * lead(u, 1) OVER w - u AS d FROM g WINDOW w AS (PARTITION BY traj, step ORDER BY h)),
m AS (SELECT *, median(d) OVER (PARTITION BY traj, step) AS m FROM d WHERE d IS NOT NULL), n AS (SELECT 1.4826 * median(abs(d - m)) / sqrt(20) AS w FROM m GROUP BY traj, step),
a AS (SELECT traj, max(abs(u)) AS a FROM g GROUP BY 1)
SELECT round(min(u), 6) AS least, round(max(u), 6) AS most, round(stddev_pop(u), 6) AS deviation, (SELECT round(sqrt(avg(w * w)), 6) FROM n) AS noise, (SELECT count(*) FROM a) AS trajectories,
  (SELECT round(min(a), 6) FROM a) AS least_amplitude, (SELECT round(max(a), 6) FROM a) AS largest_amplitude FROM g""",
)
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = System("hours", {"u": "0"}, (), 1.0, 1.0, 1.0, ("x",), "periodic", {"x": (24, 24.0, 0.0)})
    c = field_assess.coverage(hourly_fields(spark, sf_dir), s)
    names = ("least", "most", "deviation", "noise", "least_amplitude", "largest_amplitude")
    return c.select("trajectories", *[F.round(n, 6).alias(n) for n in names])
