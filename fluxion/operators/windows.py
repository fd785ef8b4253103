"""Operators over ordered trajectories, as Spark window expressions.

A trajectory is the rows of one key (`traj` by default) in the order of `step`. Every operator here plans one exchange on the key and one
sort, shared by all window expressions of a select.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numerics import savgol_weights

KEY, ORDER = ("traj",), ("step",)
#: Steps of a trajectory that one task takes at a time.
CHUNK = 65_536


def along(key: Sequence[str] = KEY, order: Sequence[str] = ORDER) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def shifted(name: str | Column, by: int, w: WindowSpec) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return c if by == 0 else F.lag(c, -by).over(w) if by < 0 else F.lead(c, by).over(w)


def weighted(name: str | Column, weights: Sequence[float], offsets: Sequence[int], w: WindowSpec) -> Column:
    """Sum of weights times the samples at offsets; null where one is missing."""
    parts = [shifted(name, o, w) * F.lit(float(x)) for x, o in zip(weights, offsets, strict=True) if x]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def savgol(name: str, window: int, order: int, derivative: int, delta: float, w: WindowSpec, position: Column | None = None, size: Column | None = None) -> Column:
    """Savitzky-Golay value or derivative. With position (from 0) and size of the trajectory, ends are read from the first and last window's
    polynomial; without, they are null."""
    h, scale = window // 2, delta**derivative
    middle = weighted(name, savgol_weights(window, order, derivative), range(-h, h + 1), w)
    if position is not None:
        for p in range(h):
            first = weighted(name, savgol_weights(window, order, derivative, p), range(-p, window - p), w)
            last = weighted(name, savgol_weights(window, order, derivative, window - 1 - p), range(p - window + 1, p + 1), w)
            middle = F.when(position == p, first).when(position == size - 1 - p, last).otherwise(middle)
    return middle / F.lit(float(scale)) if scale != 1 else middle


def smooth_and_differentiate(
    df: DataFrame, variables: Sequence[str], dt: float, window: int = 9, order: int = 3, method: str = "savgol",
    key: Sequence[str] = KEY, by: str = "step", ends: bool = True, chunk: int = CHUNK,
) -> DataFrame:
    """df with `<v>_s` (smoothed) and `<v>_t` (time derivative) for each variable. method: savgol, or fd (no smoothing).

    `by` numbers the rows of a trajectory without gaps. Rows go to chunks of `chunk` steps with as many neighbours as a window needs, so that a long
    trajectory is many tasks."""
    dealt = with_halo(df, chunk, window if method != "fd" else 1, by)
    w = along((*key, "chunk"), (by,))
    if method == "fd":
        out = [c for v in variables for c in (F.col(v).alias(f"{v}_s"), gradient(v, dt, w).alias(f"{v}_t"))]
    elif not ends:
        out = [savgol(v, window, order, d, dt, w).alias(f"{v}_{s}") for v in variables for d, s in ((0, "s"), (1, "t"))]
    else:
        span = df.groupBy(*key).agg(F.min(by).alias("_lo"), F.max(by).alias("_hi"))
        dealt = dealt.join(span, list(key))
        place, size = F.col(by) - F.col("_lo"), F.col("_hi") - F.col("_lo") + 1
        out = [savgol(v, window, order, d, dt, w, place, size).alias(f"{v}_{s}") for v in variables for d, s in ((0, "s"), (1, "t"))]
    return dealt.select(*df.columns, "own", *out).where("own").drop("own")


def gradient(name: str, dt: float, w: WindowSpec) -> Column:
    """Central differences inside, one-sided at the two ends."""
    before, after, own = shifted(name, -1, w), shifted(name, 1, w), F.col(name)
    return F.coalesce((after - before) / (2 * dt), (after - own) / dt, (own - before) / dt)


def trim(df: DataFrame, n: int, key: Sequence[str] = KEY, by: str = "step") -> DataFrame:
    """Without the first and last n rows of every trajectory, numbered by `by` without gaps."""
    span = df.groupBy(*key).agg(F.min(by).alias("_lo"), F.max(by).alias("_hi"))
    return df.join(span, list(key)).where((F.col(by) >= F.col("_lo") + n) & (F.col(by) <= F.col("_hi") - n)).select(*df.columns)


def trajectories_from_resets(df: DataFrame, time: str, ordinal: str, source: Sequence[str] = ()) -> DataFrame:
    """df with `traj`: how often time has decreased so far, in the order of ordinal within each source (a file, say).

    Without a source, ordinal is taken for what monotonically_increasing_id gives: its upper bits name a partition, so that rows are counted
    within partitions and only one row for each partition is put in order."""
    if source:
        w = Window.partitionBy(*source).orderBy(ordinal)
        reset = F.coalesce((F.col(time) < F.lag(time).over(w)).cast("int"), F.lit(0))
        return df.withColumn("_r", reset).withColumn("traj", F.sum("_r").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_r")
    cut = df.withColumn("_part", F.shiftright(F.col(ordinal), 33))
    w = Window.partitionBy("_part").orderBy(ordinal)
    cut = cut.withColumn("_r", F.coalesce((F.col(time) < F.lag(time).over(w)).cast("int"), F.lit(0)))
    ends = cut.groupBy("_part").agg(F.min_by(time, ordinal).alias("_first"), F.max_by(time, ordinal).alias("_last"), F.sum("_r").alias("_own"))
    o = Window.orderBy("_part")
    start = F.coalesce((F.col("_first") < F.lag("_last").over(o)).cast("int"), F.lit(0))
    before = ends.select("_part", start.alias("_s"), "_own").select("_part", (F.sum(F.col("_s") + F.col("_own")).over(o.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_own")).alias("_before"))
    out = cut.withColumn("_k", F.sum("_r").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(before, "_part")
    return out.withColumn("traj", (F.col("_k") + F.col("_before")).cast("int")).drop("_part", "_r", "_k", "_before")


def never_falls(df: DataFrame, columns: Sequence[str], ordinal: str) -> dict[str, bool]:
    """For each column, whether it never falls in the order of ordinal (as above: within partitions, then from each partition to the next)."""
    cut = df.select(F.shiftright(F.col(ordinal), 33).alias("_part"), ordinal, *columns)
    w = Window.partitionBy("_part").orderBy(ordinal)
    rows = cut.select("_part", ordinal, *columns, *[F.coalesce(F.col(c) >= F.lag(c).over(w), F.lit(True)).alias(f"_up_{c}") for c in columns])
    cells = [x for c in columns for x in (F.bool_and(f"_up_{c}").alias(f"_up_{c}"), F.min_by(c, ordinal).alias(f"_a_{c}"), F.max_by(c, ordinal).alias(f"_z_{c}"))]
    o = Window.orderBy("_part")
    parts = rows.groupBy("_part").agg(*cells)
    checks = [(F.col(f"_up_{c}") & F.coalesce(F.col(f"_a_{c}") >= F.lag(f"_z_{c}").over(o), F.lit(True))).alias(c) for c in columns]
    r = parts.select(*checks).agg(*[F.bool_and(c).alias(c) for c in columns]).first()
    return {c: bool(r[c]) for c in columns}


def elapsed(df: DataFrame, stamp: str, order: Sequence[str], unit_seconds: float = 1.0, key: Sequence[str] = (), salts: int = 0) -> DataFrame:
    """df with `t`: time since the first row of the key (in the given order, not the smallest stamp), in units.

    Without a key the first row is one aggregate, handed to all rows. With `salts`, a key's rows are dealt to as many parts, each of which meets the
    key's first stamp, so that a long key is many tasks; without, they are one window."""
    micros = F.unix_micros(F.col(stamp).cast("timestamp"))
    if key and not salts:
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumn("t", (micros - F.first(micros).over(w)) / F.lit(1e6 * unit_seconds))
    first = df.groupBy(*key).agg(F.min_by(micros, F.struct(*order)).alias("_first"))
    if not key:
        both = df.crossJoin(F.broadcast(first))  # one row
    else:
        salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
        both = df.withColumn("_salt", salt).join(first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*key, "_salt"]).drop("_salt")
    return both.select(*df.columns, ((micros - F.col("_first")) / F.lit(1e6 * unit_seconds)).alias("t"))


def in_chunks(df: DataFrame, by: str, chunk: int = CHUNK) -> DataFrame:
    """df with `_c`: which stretch of the order a row is in, about `chunk` rows each. Whole numbers are cut at multiples of chunk; other
    orders at even distances, as many as their range holds chunks of rows on average."""
    if isinstance(df.schema[by].dataType, T.IntegralType):
        return df.withColumn("_c", F.floor(F.col(by) / chunk))
    row = df.agg(F.min(by).cast("double"), F.max(by).cast("double"), F.count("*")).first()
    if not row[2] or row[0] is None or row[0] == row[1]:
        return df.withColumn("_c", F.lit(0).cast("long"))
    width = (row[1] - row[0]) / max(1, -(-row[2] // chunk))
    return df.withColumn("_c", F.coalesce(F.floor((F.col(by).cast("double") - row[0]) / width), F.lit(-1)))


def numbered(df: DataFrame, by: str, key: Sequence[str] = KEY, into: str = "step", chunk: int = CHUNK) -> DataFrame:
    """df with the number (from 0) of each row of its key in the order of `by`: rows count within chunks, chunks are added up before them."""
    cut = in_chunks(df.drop(into), by, chunk)
    own = cut.withColumn("_k", F.row_number().over(Window.partitionBy(*key, "_c").orderBy(by)) - 1)
    w = Window.partitionBy(*key).orderBy("_c")
    before = cut.groupBy(*key, "_c").agg(F.count("*").alias("_n")).select(*key, "_c", (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return own.join(before, [*key, "_c"]).withColumn(into, (F.col("_k") + F.col("_before")).cast("int")).drop("_c", "_k", "_n", "_before")


def average_duplicates(df: DataFrame, values: Sequence[str], key: Sequence[str] = ("traj", "t")) -> DataFrame:
    """One row for each (trajectory, time): the mean of its values."""
    return df.groupBy(*key).agg(*[F.avg(v).alias(v) for v in values])


def fill_gaps(df: DataFrame, values: Sequence[str], key: Sequence[str] = KEY, by: str = "step", chunk: int = CHUNK) -> DataFrame:
    """Nulls filled by linear interpolation over the order column; constant beyond the ends; 0 where a whole series is null.

    Chunks of a series are filled by themselves and need of the rest the last known sample before and the first one after them only, which a
    window over one row for each chunk finds: a long series is many tasks."""
    cut = in_chunks(df, by, chunk)
    own = Window.partitionBy(*key, "_c")
    placed = cut.withColumn("_i", F.row_number().over(own.orderBy(by)))
    # frames that end at the last row are filled anew for every row: looking ahead is looking back in the opposite order
    back, ahead = own.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0), own.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    known = {v: F.when(F.col(v).isNotNull(), F.struct(F.col(by).alias("x"), F.col(v).alias("y"))) for v in values}
    inside = placed.select("*", *[c for v in values for c in (F.last(known[v], True).over(back).alias(f"_b_{v}"), F.last(known[v], True).over(ahead).alias(f"_a_{v}"))])
    ends = cut.groupBy(*key, "_c").agg(*[c for v in values for c in (F.max_by(known[v], F.when(F.col(v).isNotNull(), F.col(by))).alias(f"_z_{v}"), F.min_by(known[v], F.when(F.col(v).isNotNull(), F.col(by))).alias(f"_f_{v}"))])
    w = Window.partitionBy(*key)
    before, after = (w.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_c"), F.desc("_c")))
    outside = ends.select(*key, "_c", *[c for v in values for c in (F.last(f"_z_{v}", True).over(before).alias(f"_p_{v}"), F.last(f"_f_{v}", True).over(after).alias(f"_n_{v}"))])
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"o.{k}")) for k in (*key, "_c")]
    out = []
    for v in values:
        b, a = F.coalesce(f"_b_{v}", f"_p_{v}"), F.coalesce(f"_a_{v}", f"_n_{v}")
        x0, y0, x1, y1 = b["x"], b["y"], a["x"], a["y"]
        line = F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (F.col(f"i.{by}") - x0) / (x1 - x0))
        out.append(F.coalesce(F.col(f"i.{v}"), line, y0, y1, F.lit(0.0)).alias(v))
    return inside.alias("i").join(outside.alias("o"), same).select(*[F.col(f"i.{c}").alias(c) for c in df.columns if c not in values], *out)


def without_values(df: DataFrame, values: Sequence[str], key: Sequence[str] = KEY) -> dict[str, int]:
    """For each value, how many series (keys) have none at all: what fill_gaps makes zeros."""
    row = df.groupBy(*key).agg(*[F.count(v).alias(v) for v in values]).agg(*[F.count_if(F.col(v) == 0).alias(v) for v in values]).first()
    return {v: int(row[v] or 0) for v in values}


def longest_gap(df: DataFrame, value: str, key: Sequence[str] = KEY, by: str = "step") -> DataFrame:
    """For each trajectory, the most consecutive nulls of value (gaps and islands)."""
    w = along(key, (by,))
    missing = F.col(value).isNull()
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*key, missing).orderBy(by))
    runs = df.select(*key, missing.alias("_m"), island.alias("_i")).where("_m").groupBy(*key, "_i").count()
    return df.select(*key).distinct().join(runs.groupBy(*key).agg(F.max("count").alias("longest_gap")), list(key), "left").fillna(0, ["longest_gap"])


def sampling(df: DataFrame, time: str = "t", key: Sequence[str] = KEY, order: Sequence[str] | None = None) -> DataFrame:
    """For each trajectory: median step, largest relative deviation from it, steps beyond 3 medians, rows."""
    w = along(key, order or (time,))
    steps = df.select(*key, (F.col(time) - F.lag(time).over(w)).alias("_d")).where("_d is not null")
    middle = steps.groupBy(*key).agg(F.median("_d").alias("dt"))
    return (
        steps.join(middle, list(key))
        .groupBy(*key, "dt")
        .agg(F.max(F.abs(F.try_divide(F.col("_d"), F.col("dt")) - 1)).alias("deviation"), F.count_if(F.col("_d") > 3 * F.col("dt")).alias("gaps"), (F.count("*") + 1).alias("rows"))
    )


def step_change(df: DataFrame, variables: Sequence[str], key: Sequence[str] = KEY, by: Sequence[str] = ORDER) -> DataFrame:
    """One row: for each variable, mean absolute change per step over its (population) standard deviation."""
    w = along(key, by)
    changes = df.select(*variables, *[F.abs(F.col(v) - F.lag(v).over(w)).alias(f"_{v}") for v in variables])
    return changes.agg(*[(F.avg(f"_{v}") / (F.stddev_pop(v) + F.lit(1e-12))).alias(v) for v in variables])


def _turns(d: Column, period: float) -> Column:
    """Whole periods that take back a jump of d; a jump of exactly half a period keeps its direction."""
    half = period / 2
    down = F.floor((d + half) / period)
    tie = (d - down * period == -half) & (d > 0)
    return F.when(F.abs(d) >= half, F.when(tie, 1 - down).otherwise(-down)).otherwise(F.lit(0))


def unwrap(df: DataFrame, angle: str, period: float, key: Sequence[str] = KEY, by: Sequence[str] = ORDER, into: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """df with the angle made continuous: every jump of half a period or more is taken back by whole periods.

    A prefix sum in two levels: turns are counted within chunks of the order, then over one row for each chunk, whose first angle meets the last one
    of the chunk before. Turns are whole numbers, so the sums don't depend on how rows are cut."""
    order = by[0]
    cut = in_chunks(df, order, chunk)
    own = Window.partitionBy(*key, "_c").orderBy(*by)
    jumps = cut.withColumn("_j", F.coalesce(_turns(F.col(angle) - F.lag(angle).over(own), period), F.lit(0)))
    summed = jumps.withColumn("_s", F.sum("_j").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*by)
    ends = jumps.groupBy(*key, "_c").agg(F.min_by(angle, at).alias("_f"), F.max_by(angle, at).alias("_l"), F.sum("_j").alias("_t"))
    w = Window.partitionBy(*key).orderBy("_c")
    joint = ends.select(*key, "_c", "_t", F.coalesce(_turns(F.col("_f") - F.lag("_l").over(w), period), F.lit(0)).alias("_j0"))
    before = joint.select(*key, "_c", (F.sum(F.col("_t") + F.col("_j0")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).alias("_o"))
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"o.{k}")) for k in (*key, "_c")]
    out = summed.alias("i").join(before.alias("o"), same)
    value = (F.col(f"i.{angle}") + (F.col("_s") + F.col("_o")) * F.lit(float(period))).alias(into or angle)
    return out.select(*[value if c == (into or angle) else F.col(f"i.{c}").alias(c) for c in df.columns], *([] if (into or angle) in df.columns else [value]))


def with_halo(df: DataFrame, chunk: int, halo: int, by: str = "step") -> DataFrame:
    """Rows dealt to chunks of `chunk` steps, each with `halo` rows of its neighbours (own = false), so that a long trajectory needs no
    single task for operators that look at most halo steps around."""
    k = F.floor(F.col(by) / chunk)
    at = F.col(by) - k * chunk
    near = F.array_compact(F.array(k, F.when((at < halo) & (k > 0), k - 1), F.when(at >= chunk - halo, k + 1)))
    return df.withColumn("chunk", F.explode(near)).withColumn("own", F.col("chunk") == k)


def subsample(df: DataFrame, every: int, by: str = "step") -> DataFrame:
    """Every k-th frame, steps renumbered."""
    return df.where(F.col(by) % every == 0).withColumn(by, (F.col(by) / every).cast(df.schema[by].dataType))


def append_trajectories(old: DataFrame, new: DataFrame) -> DataFrame:
    """New trajectories go in front, so that the last (validation) trajectory stays last; all are cut to the shortest."""
    if set(old.columns) != set(new.columns):
        raise ValueError(f"columns differ: {sorted(set(old.columns) ^ set(new.columns))}")
    first = new.agg(F.coalesce(F.max("traj") + 1, F.lit(0))).first()[0]
    both = new.unionByName(old.withColumn("traj", (F.col("traj") + first).cast(old.schema["traj"].dataType)))
    least = both.groupBy("traj").count().agg(F.min("count").alias("_least"))
    return both.join(F.broadcast(least)).where("step < _least").drop("_least")
