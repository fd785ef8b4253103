"""From a table to trajectories or fields: which column is time, which rows belong together, which columns are space, parameters or constants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numerics as N
from ..operators import windows
from .readers import ARRAYS, extension, read_file, sanitize_names

# Names by which columns are known, and units of time.
TIME_NAMES = ("t", "time", "times", "date", "datetime", "timestamp", "epoch", "tau")
TRAJECTORY_NAMES = ("traj", "trajectory", "run", "case", "trial", "experiment", "sim", "simulation", "episode", "id", "sample", "series", "group", "rep", "replicate")
SPACE_NAMES = ("x", "y", "z", "pos", "position", "space", "s")
TIME_UNITS = {"s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0}


@dataclass
class Card:
    """What was taken for granted, how sure that is, and what to look at first."""

    assumptions: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def assume(self, what: str, value, confidence: str, why: str) -> None:
        self.assumptions.append({"what": what, "value": str(value), "confidence": confidence, "why": why})

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(a["what"], a["value"], a["confidence"], a["why"]) for a in self.assumptions], "what string, value string, confidence string, why string")

    @property
    def review_first(self) -> list[str]:
        return [a["what"] for a in sorted(self.assumptions, key=lambda a: ("low", "medium", "high").index(a["confidence"])) if a["confidence"] != "high"]


@dataclass
class Layout:
    """Roles of a table's columns."""

    kind: str
    time: str
    trajectory: str | None
    space: list[str]
    variables: list[str]
    parameters: list[str]
    constants: list[str]
    order: str


def numeric_columns(df: DataFrame, share: float = 0.95) -> DataFrame:
    """Text columns that read as numbers in more than `share` of their filled rows become doubles."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    row = df.agg(*[F.avg(F.when(F.col(c).isNotNull(), F.expr(f"try_cast(`{c}` as double) is not null").cast("double"))).alias(c) for c in text]).first()
    return df.select(*[F.expr(f"try_cast(`{c}` as double)").alias(c) if c in text and (row[c] or 0) > share else F.col(f"`{c}`") for c in df.columns])


def detect_layout(df: DataFrame, card: Card, hints: Mapping[str, object] | None = None) -> tuple[DataFrame, Layout]:
    """Roles by name first, then by content. Raises ValueError for a table of constants (fewer than three rows)."""
    hints = hints or {}
    if df.limit(3).count() < 3:
        raise ValueError("fewer than three rows: a table of constants, not of measurements over time")
    if "_ordinal" not in df.columns:
        df = df.withColumn("_ordinal", F.monotonically_increasing_id())
    df = numeric_columns(df.drop(*hints.get("drop", [])).withColumnsRenamed(dict(hints.get("rename", {}))))
    names = [c for c in df.columns if c != "_ordinal"]
    low = {c.lower(): c for c in reversed(names)}
    stamps = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != "_ordinal"]
    time = hints.get("time") or next((low[n] for n in TIME_NAMES if n in low), None) or next((c for c in names if c.lower().startswith("time")), None) or (stamps[0] if stamps else None)
    sure = "high" if time else "low"
    if time is None:
        df, time = _stamped(df, [f.name for f in df.schema if isinstance(f.dataType, T.StringType)])
        sure = "medium" if time else "low"
    if time is None:
        flags = windows.never_falls(df, numbers, "_ordinal")
        many = df.agg(*[F.count_distinct(c).alias(c) for c in numbers]).first()
        time = next((c for c in numbers if flags[c] and many[c] > 2), None)
        if time is None:
            raise ValueError("no column looks like time; name one in the hints")
    card.assume("time column", time, sure, {"high": "by name", "medium": "text that reads as dates", "low": "first column that never falls"}[sure])
    trajectory = hints.get("trajectory") or next((low[n] for n in TRAJECTORY_NAMES if n in low and low[n] != time), None) or next((c for c in names if c.lower().endswith("_id") and c != time), None)
    values = [c for c in numbers if c not in (time, trajectory)]
    if trajectory is None:
        df = df.withColumn("_traj", F.lit(0)) if isinstance(df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else windows.trajectories_from_resets(df, time, "_ordinal").withColumnRenamed("traj", "_traj")
        card.assume("trajectories", "where time falls", "medium", "no column names them")
    else:
        if isinstance(df.schema[trajectory].dataType, T.IntegralType):
            df = df.withColumn("_traj", F.col(trajectory).cast("int"))
        else:  # one row for each trajectory is put in order, not the measurements
            names_ = df.select(trajectory).distinct().withColumn("_traj", (F.row_number().over(Window.orderBy(trajectory)) - 1).cast("int"))
            df = df.join(names_, trajectory)
        card.assume("trajectory column", trajectory, "high", "by name")
    facts = df.agg(*[F.count_distinct(c).alias(c) for c in values], F.count("*").alias("_rows")).first()
    constants = [c for c in values if facts[c] <= 1]
    values = [c for c in values if c not in constants]
    still = {r["name"]: r["parameter"] for r in parameter_columns(df, "_traj", values).collect()} if values else {}
    parameters = [c for c in values if still[c]]
    values = [c for c in values if c not in parameters]
    space = _preferred(space_columns(df, ("_traj", time), values), hints.get("space"))
    for c in space:
        card.assume("space column", c, "high" if c.lower() in SPACE_NAMES else "medium", "several values at each time, shared by many rows")
    return df, Layout("pde" if space else "ode", time, trajectory, space, [c for c in values if c not in space], parameters, constants, "_ordinal")


def _stamped(df: DataFrame, text: Sequence[str], share: float = 0.95) -> tuple[DataFrame, str | None]:
    """df with the first text column that reads as dates or times in more than `share` of its rows made time stamps, and its name."""
    if not text:
        return df, None
    read = lambda c: F.expr(f"try_cast(`{c}` as timestamp)")
    row = df.agg(*[F.avg(F.when(F.col(c).isNotNull(), read(c).isNotNull().cast("double"))).alias(c) for c in text]).first()
    found = next((c for c in text if (row[c] or 0) > share), None)
    return (df.withColumn(found, read(found)), found) if found else (df, None)


def parameter_columns(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """name, parameter: whether a column keeps one value within each of several keys, to 1e-9 of its size."""
    own = df.groupBy(key).agg(*[F.struct(F.stddev_pop(c).alias("d"), F.max(F.abs(F.col(c))).alias("m")).alias(f"_{c}") for c in columns])
    still = lambda c: (F.count("*") > 1) & (F.coalesce(F.max(f"_{c}.d"), F.lit(0.0)) <= 1e-9 * F.coalesce(F.max(f"_{c}.m"), F.lit(0.0)))
    return own.agg(F.array(*[F.struct(F.lit(c).alias("name"), still(c).alias("parameter")) for c in columns]).alias("a")).select(F.inline("a"))


def space_columns(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Columns with several values in every group of rows that share the key (trajectory and time), but half as many values as rows at most, in all."""
    if not columns:
        return []
    each = df.groupBy(*key).agg(F.count("*").alias("_n"), *[F.count_distinct(c).alias(c) for c in columns])
    row = each.agg(F.max("_n").alias("_n"), *[F.min(c).alias(c) for c in columns]).first()
    every = df.agg(F.count("*").alias("_rows"), *[F.count_distinct(c).alias(c) for c in columns]).first()
    return [c for c in columns if (row["_n"] or 0) > 1 and row[c] > 1 and every[c] <= every["_rows"] / 2]


def _preferred(found: Sequence[str], given: Sequence[str] | None = None) -> list[str]:
    """Those given; else those with names of space if there are any. More than two are refused, since cells would fall on one another."""
    space = list(given) if given is not None else [c for c in found if c.lower() in SPACE_NAMES] or list(found)
    if len(space) > 2:
        raise ValueError(f"{', '.join(space)} look like space: fields of two axes at most; name them in the hints (space) or drop the others")
    return space


def to_trajectories(df: DataFrame, layout: Layout, unit: str = "s") -> DataFrame:
    """obs(traj, step, t, <variables>, <parameters>): time in units since the first row, equal times averaged, steps numbered."""
    kind = df.schema[layout.time].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        df = windows.elapsed(df, layout.time, (layout.order,), TIME_UNITS[unit])
    else:
        df = df.withColumn("t", F.col(layout.time).cast("double"))
    names = dict(zip(layout.variables, sanitize_names(layout.variables), strict=True))
    rows = windows.average_duplicates(df.select(F.col("_traj").alias("traj"), "t", *[F.col(c).cast("double").alias(n) for c, n in names.items()], *layout.parameters), [*names.values(), *layout.parameters])
    return windows.numbered(rows, "t")


def to_grid(df: DataFrame, layout: Layout) -> DataFrame:
    """frames(traj, step, t, <field> arrays) of a long field over one or two axes: every (time, node), missing cells null, the last of doubled cells.

    Frames are row-major: cell ix * ny + iy. Each axis's nodes are numbered in a table of their own, which cells meet by an equi-join on
    their coordinate; every frame then counts through its cells and looks them up by an equi-join on (trajectory, time, cell)."""
    axes = layout.space
    base = df.select(F.col("_traj").alias("traj"), F.col(layout.time).cast("double").alias("t"), *[F.col(a).cast("double").alias(f"_x{k}") for k, a in enumerate(axes)], *[F.col(v).alias(f"_v{k}") for k, v in enumerate(layout.variables)], F.col(layout.order).alias("_o"))
    values = [f"_v{k}" for k in range(len(layout.variables))]
    one = base.groupBy("traj", "t", *[f"_x{k}" for k in range(len(axes))]).agg(*[F.max_by(v, "_o").alias(v) for v in values])
    sizes = [len(grid_nodes(df, layout, k)) for k in range(len(axes))]
    cell = F.lit(0)
    for k, n in enumerate(sizes):
        nodes = one.select(f"_x{k}").distinct().withColumn(f"_i{k}", F.row_number().over(Window.orderBy(f"_x{k}")) - 1)  # an axis of a frame
        one = one.join(nodes, f"_x{k}")
        cell = cell * n + F.col(f"_i{k}")
    one = one.select("traj", "t", cell.alias("_cell"), *values)
    grid = one.select("traj", "t").distinct().withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(int(np.prod(sizes)) - 1))))
    rows = grid.join(one, ["traj", "t", "_cell"], "left").groupBy("traj", "t").agg(F.array_sort(F.collect_list(F.struct("_cell", *values))).alias("z"))
    out = rows.select("traj", "t", *[F.col(f"z.{v}").alias(n) for v, n in zip(values, sanitize_names(layout.variables), strict=True)])
    return out.withColumn("step", (F.row_number().over(Window.partitionBy("traj").orderBy("t")) - 1).cast("int"))


def doubled_cells(df: DataFrame, layout: Layout) -> int:
    """Rows of a long field beyond the first of their trajectory, time and nodes: to_grid keeps the last of them."""
    each = df.groupBy("_traj", layout.time, *layout.space).count()
    return int(each.agg(F.sum(F.col("count") - 1)).first()[0] or 0)


def grid_nodes(df: DataFrame, layout: Layout, axis: int = 0) -> np.ndarray:
    return np.array([r["x"] for r in df.select(F.col(layout.space[axis]).cast("double").alias("x")).where("x is not null").distinct().orderBy("x").collect()])  # one axis of the grid


#: Knots on either side of a chunk of a spline. What a spline does at a knot fades by half with each knot at least, by 0.27 where they are even.
SPLINE_HALO = 64


def splined(df: DataFrame, variables: Sequence[str], dt: float, chunk: int = windows.CHUNK) -> DataFrame:
    """obs(traj, step, t, variables) at t0 + i dt of each trajectory, from its not-a-knot spline.

    The spline's equations are tridiagonal and dominated by their diagonal, so the second derivatives of a stretch depend on knots around it by a share
    that halves with each: chunks are solved with SPLINE_HALO more knots on either side, and each gives the even times between its own first knot and
    the next chunk's. Where a trajectory begins or ends, the chunk has the true end condition. A trajectory is as many tasks as it has chunks."""
    knots = windows.numbered(df.dropna(subset=["t", *variables]).select("traj", "t", *variables), "t", chunk=chunk)
    dealt = windows.with_halo(knots, chunk, min(SPLINE_HALO, chunk))
    w = Window.partitionBy("traj").orderBy("chunk")
    first = knots.groupBy("traj", F.floor(F.col("step") / chunk).alias("chunk")).agg(F.min("t").alias("_from"), F.max("t").alias("_end"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = first.select("traj", "chunk", "_from", F.lead("_from").over(w).alias("_to"), F.first("_from").over(whole).alias("_t0"), F.last("_end").over(whole).alias("_t1"))

    def spline(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        t, t0, t1, low, high = pdf["t"].to_numpy(), *(pdf[c].iloc[0] for c in ("_t0", "_t1", "_from", "_to"))
        n = int((t1 - t0) / dt + 1e-9) + 1
        place = lambda x: int(np.ceil((x - t0) / dt - 1e-9))
        i = np.arange(max(0, place(low)), n if np.isnan(high) else min(n, place(high)))
        y = N.not_a_knot(t, pdf[list(variables)].to_numpy(float))(t0 + dt * i)
        return pd.DataFrame({"traj": pdf["traj"].iloc[0], "step": i, "t": t0 + dt * i} | {v: y[:, k] for k, v in enumerate(variables)})

    kind = df.schema["traj"].dataType.simpleString()
    return dealt.drop("own").join(spans, ["traj", "chunk"]).groupBy("traj", "chunk").applyInPandas(spline, f"traj {kind}, step int, t double, " + ", ".join(f"{v} double" for v in variables))


def regular_time(df: DataFrame, variables: Sequence[str], tolerance: float = 1e-3, resample: bool = True) -> tuple[DataFrame, float]:
    """Trajectories on one uniform step (the median over all): those that deviate are read from a not-a-knot spline; all are
    cut to the shortest. A trajectory whose time falls is reversed."""
    facts = windows.sampling(df.withColumn("t", F.col("t")), "t", order=("t",))
    row = facts.agg(F.median("dt").alias("dt"), F.max("deviation").alias("dev"), (F.max("dt") / F.min("dt") - 1).alias("spread")).first()
    dt = float(row["dt"])
    if row["dev"] > tolerance or row["spread"] > tolerance:
        if not resample:
            raise ValueError(f"times are not uniform (deviation {row['dev']:.3g}) and resampling is off")
        df = splined(df, variables, dt)
    least = df.groupBy("traj").count().agg(F.min("count").alias("_least"))
    return df.join(F.broadcast(least)).where("step < _least").drop("_least"), dt


def sanity(df: DataFrame, variables: Sequence[str]) -> list[str]:
    """Warnings: constant variables, scales more than four decades apart, coarse steps, short or single trajectories."""
    row = df.agg(*[F.stddev_pop(v).alias(v) for v in variables], F.count_distinct("traj").alias("_traj")).first()
    least = df.groupBy("traj").count().agg(F.min("count")).first()[0] or 0
    steps = windows.step_change(df, variables).first()
    out = [f"{v} is constant" for v in variables if not row[v]]
    sizes = [row[v] for v in variables if row[v]]
    if sizes and max(sizes) / min(sizes) > 1e4:
        out.append("scales of variables differ by more than four decades")
    out += [f"{v} changes by {steps[v]:.2f} standard deviations a step: sampling is coarse" for v in variables if (steps[v] or 0) > 0.3]
    if least < 15:
        out.append(f"the shortest trajectory has {least} samples")
    if row["_traj"] == 1:
        out.append("a single trajectory: validation uses its last quarter")
    return out


def finish_fields(frames: DataFrame, names: Sequence[str], nodes: Sequence[np.ndarray], card: Card, hints: Mapping[str, object]) -> tuple[DataFrame, dict]:
    """Frames on a uniform grid with a known boundary: holes filled in time, uneven nodes resampled (1-D), a repeated end node dropped; and the grid.

    Axes that differ in their boundary make it unknown."""
    from ..operators import fields

    holes = frames.select(F.explode(F.arrays_zip(*names)).alias("z")).agg(*[F.count_if(F.col(f"z.{n}").isNull()).alias(n) for n in names]).first()
    if sum(holes):
        card.warnings.append(f"{sum(holes)} missing cells are filled from the times before and after")
        frames = fill_frames(frames, names)
    if len(nodes) == 1:
        frames, even = fields.uniform_space(frames, nodes[0], names)
        nodes = [even]
    else:
        frames, nodes = fields.uniform_plane(frames, nodes, names)
    shape, dims = [len(x) for x in nodes], "xy"[: len(nodes)]
    given, drop = hints.get("boundary"), hints.get("drop_end")
    found = {d: _common_boundary([fields.decide_boundary(fields.periodicity(frames, n, shape, k), given, drop) for n in names]) for k, d in enumerate(dims)}
    for d, b in found.items():
        card.assume(f"boundary ({d})", b["boundary"], b["confidence"], b["why"])
    kept = [n - bool(b["drop_end"]) for n, b in zip(shape, found.values(), strict=True)]
    if kept != shape:
        cut = lambda c: F.slice(c, 1, kept[0]) if len(shape) == 1 else F.flatten(F.transform(F.sequence(F.lit(0), F.lit(kept[0] - 1)), lambda i: F.slice(c, i * shape[1] + 1, kept[1])))
        frames = frames.withColumns({n: cut(F.col(n)) for n in names})
    kinds = {b["boundary"] for b in found.values()}
    boundary = kinds.pop() if len(kinds) == 1 else "unknown"
    grid = {}
    for d, x, n in zip(dims, nodes, kept, strict=True):
        dx = float((x[-1] - x[0]) / (len(x) - 1))
        grid[d] = {"n": n, "L": float(hints.get("L", dx * (n if boundary == "periodic" else n - 1))), "dx": dx, "x0": float(x[0])}
    return frames, {"kind": "pde", "variables": list(names), "spatial_dims": list(dims), "boundary": boundary, "grid": grid}


def _common_boundary(found: Sequence[Mapping]) -> Mapping:
    """What all fields say of an axis, no surer than the least sure; unknown where they differ."""
    if len({(f["boundary"], f["drop_end"]) for f in found}) > 1:
        return {"boundary": "unknown", "drop_end": False, "confidence": "low", "why": "fields differ in it"}
    return min(found, key=lambda f: ("low", "medium", "high").index(f["confidence"]))


def fill_frames(frames: DataFrame, names: Sequence[str]) -> DataFrame:
    """Missing cells by linear interpolation along time, node by node."""
    rest = [c for c in frames.columns if c not in names]
    z = frames.select(*rest, F.posexplode(F.arrays_zip(*names)).alias("_ix", "z")).select(*rest, "_ix", *[F.col(f"z.{n}").alias(n) for n in names])
    filled = windows.fill_gaps(z, names, ("traj", "_ix"))
    back = filled.groupBy(*rest).agg(F.array_sort(F.collect_list(F.struct("_ix", *names))).alias("z"))
    return back.select(*rest, *[F.col(f"z.{n}").alias(n) for n in names])


def ingest_arrays(spark, path: str, card: Card, hints: Mapping[str, object]) -> tuple[DataFrame, dict]:
    """An array file to trajectories or frames: roles from headers and vectors, values through Spark."""
    from .arrays import infer_arrays
    from .readers import array_headers, array_table

    rows = read_file(spark, path)
    heads = array_headers(rows)
    roles = infer_arrays(heads, card, {k: v for k, v in hints.items() if k in ("field", "axes", "time")})
    size = dict(zip(roles["axes"], heads[roles["field"]].shape, strict=True))
    t = heads.get(roles["time"]) if roles["time"] else None
    dt = float(hints.get("dt", np.median(np.diff(t)) if t is not None else 1.0))
    table = array_table(rows, roles["field"], roles["time"], dt, roles["axes"])
    names = list(hints.get("names") or ([roles["field"]] if size.get("v", 1) == 1 else [f"{roles['field']}{i}" for i in range(size["v"])]))
    names = sanitize_names(names)
    if "x" not in size:
        obs = table.groupBy("traj", "step", "t").agg(*[F.max(F.when(F.col("variable") == i, F.col("value"))).alias(n) for i, n in enumerate(names)])
        obs, step = regular_time(windows.fill_gaps(obs, names), names)
        return obs, {"kind": "ode", "variables": names, "dt": step}
    cells = table.groupBy("traj", "step", "t", "ix", "iy").agg(*[F.max(F.when(F.col("variable") == i, F.col("value"))).alias(n) for i, n in enumerate(names)])
    frames = cells.groupBy("traj", "step", "t").agg(F.array_sort(F.collect_list(F.struct("ix", "iy", *names))).alias("z")).select("traj", "step", "t", *[F.col(f"z.{n}").alias(n) for n in names])
    nodes = [next((heads[s] for s in roles["space"] if heads[s].size == size[d] and (d == "x") == (s == roles["space"][0])), np.arange(size[d], dtype=float)) for d in "xy" if d in size]
    frames, meta = finish_fields(frames, names, nodes, card, hints)
    return frames, meta | {"dt": dt}


def system_of(meta: Mapping):
    """The grid of ingested fields as a System without equations."""
    from ..operators.systems import System

    grid = {d: (g["n"], g["L"], g["x0"]) for d, g in meta["grid"].items()}
    return System("measured", dict.fromkeys(meta["variables"], "0"), (), meta["dt"], 0.0, 0.0, tuple(meta["spatial_dims"]), meta["boundary"], grid)


def ingest(spark, path: str, hints: Mapping[str, object] | None = None) -> tuple[DataFrame, dict, Card]:
    """A table or array file to trajectories or frames, with meta data and a card of what was assumed. hints: time, trajectory, rename, drop, unwrap
    (columns of angles), boundary, drop_end, L; of array files field, axes, time, dt, names."""
    card, hints = Card(), dict(hints or {})
    if extension(path) in ARRAYS:
        out, meta = ingest_arrays(spark, path, card, hints)
        return out, meta, card
    df, layout = detect_layout(read_file(spark, path), card, hints)
    if layout.kind == "pde":
        if again := doubled_cells(df, layout):
            card.warnings.append(f"{again} rows share their time and place with another: the last of each is kept")
        frames, meta = finish_fields(to_grid(df, layout), sanitize_names(layout.variables), [grid_nodes(df, layout, k) for k in range(len(layout.space))], card, hints)
        dt = windows.sampling(frames.select("traj", "step", "t"), order=("step",)).agg(F.median("dt")).first()[0]
        return frames, meta | {"dt": float(dt), "layout": asdict(layout)}, card
    names = sanitize_names(layout.variables)
    raw = to_trajectories(df, layout)
    card.warnings += [f"{v} has no value at all in {n} trajectories: zeros there" for v, n in windows.without_values(raw, names).items() if n]
    obs = windows.fill_gaps(raw, names, by="t")  # times may be uneven
    for angle in hints.get("unwrap", []):
        top = obs.agg(F.max(angle) - F.min(angle)).first()[0]
        obs = windows.unwrap(obs, angle, 360.0 if top > 7 else 2 * float(np.pi))
    obs, dt = regular_time(obs, names)
    card.warnings += sanity(obs, names)
    return obs, {"kind": "ode", "variables": names, "dt": dt, "layout": asdict(layout)}, card
