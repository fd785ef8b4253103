"""Weak form: both sides are integrated against smooth test functions, so that noisy data need no differentiation.

A test function is a product of bumps (1 - s**2)**p in time and space. Time derivatives move to the test function, and so do space derivatives of
linear and flux terms; other terms are integrated as they are. Each (trajectory, centre) gives one row of a small regression. For ODE tables the
projections are a join-free window sum over a trajectory; for frames they are matrix products in the trajectory's task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Expr, Symbol, linear_combination
from . import regression
from .gram import GROUPS, Gram, added, grams, packed_gram
from .library import build_library, columns, derivative_symbols
from .quantiles import median
from .simulate import derivatives
from .systems import System
from .windows import CHUNK, along, shifted, weighted, with_halo


def bump(half: int, p: int, derivative: int = 0) -> np.ndarray:
    """Values at -half..half of the derivative (unit spacing) of (1 - (i / half)**2)**p."""
    poly = np.polynomial.Polynomial([1, 0, -1]) ** p
    return poly.deriv(derivative)(np.arange(-half, half + 1) / half) / half**derivative if derivative else poly(np.arange(-half, half + 1) / half)


def half_width(corner: int, n: int, p: int) -> int:
    """Half width whose spectrum meets the data's corner mode, within 4 and a quarter of the series."""
    return int(np.clip(round(n * np.sqrt(2 * p) / (2 * np.pi * max(corner, 1))), 4, max(4, n // 4)))


def corner_mode(u: np.ndarray) -> int:
    """Last Fourier mode above ten times the noise floor of a series (time along axis 0), trend removed and tapered."""
    n = len(u)
    ramp = u[:1] + (u[-1:] - u[:1]) * np.linspace(0, 1, n).reshape([-1] + [1] * (u.ndim - 1))
    e = (np.abs(np.fft.rfft((u - ramp) * np.hanning(n).reshape([-1] + [1] * (u.ndim - 1)), axis=0)) ** 2).reshape(n // 2 + 1, -1).mean(axis=1)
    above = np.flatnonzero(e > 10 * np.median(e[int(0.75 * len(e)) :]))
    return int(above[-1]) if len(above) else 1


def weak_ode_rows(df: DataFrame, variables: Sequence[str], library: Mapping[str, Expr], dt: float, half: int, p: int = 8, every: int | None = None) -> DataFrame:
    """A row for each (traj, centre): projections x0..xk of the terms and y0..ym of the time derivatives (by parts: minus the derivative of the test function)."""
    w = along(("traj", "chunk"))
    phi, dphi = bump(half, p) * dt, -bump(half, p, 1)
    offsets = range(-half, half + 1)
    rows = df.select("traj", "step", *[c.alias(f"x{i}") for i, c in enumerate(columns(dict(library)).values())], *[F.col(v).alias(f"y{i}") for i, v in enumerate(variables)])
    out = with_halo(rows, CHUNK, half).select(
        "traj", "step", "own", *[weighted(f"x{i}", phi, offsets, w).alias(f"x{i}") for i in range(len(library))],
        *[weighted(f"y{i}", dphi, offsets, w).alias(f"y{i}") for i in range(len(variables))],
    )
    return out.where(F.col("own") & (F.col("step") % (every or max(1, half // 2)) == 0) & F.col("x0").isNotNull() & F.col("y0").isNotNull()).drop("own")


def noise_grams(df: DataFrame, variables: Sequence[str], library: Mapping[str, Expr], dt: float, half: int, held: Column, p: int = 8, every: int | None = None) -> dict[str, Gram]:
    """For each variable, products of what unit white noise in it does to the held-out weak rows: to the left side through the derivative of the test
    function, to each term through the test function times the term's derivative by the variable.

    A sample meets every test function around it, so the sums over rows and samples are one weighted Gram matrix over samples, whose weights are window sums
    over the centres near by."""
    stride = every or max(1, half // 2)
    phi, dphi = bump(half, p) * dt, -bump(half, p, 1)
    span = df.groupBy("traj").agg(F.min("step").alias("_lo"), F.max("step").alias("_hi"))
    reach = half - 1  # a bump is 0 at its ends
    inside = (F.col("step") - reach >= F.col("_lo")) & (F.col("step") + reach <= F.col("_hi")) & (F.col("step") % stride == 0)
    marked = df.select("traj", "step", *variables).join(span, "traj").withColumn("_c", (inside & held).cast("double")).drop("_lo", "_hi")
    w = along(("traj", "chunk"))
    near = {o: F.coalesce(shifted("_c", -o, w), F.lit(0.0)) for o in range(-half, half + 1)}
    total = lambda weights: sum((near[o] * F.lit(float(x)) for o, x in zip(near, weights, strict=True) if x), F.lit(0.0))
    samples = with_halo(marked, CHUNK, half).select("*", total(phi * phi).alias("_w2"), total(phi * dphi).alias("_w1")).where(F.col("own") & (F.col("_w2") > 0))
    own = {(f, t): e.diff(f) for f in variables for t, e in library.items()}
    own = {k: e for k, e in own.items() if e.terms}
    label = {k: f"n{i}" for i, k in enumerate(own)}
    root = F.sqrt("_w2")
    g = grams(samples, {label[k]: root * e.column() for k, e in own.items()}, {"lhs": F.col("_w1") / root}, None)[None]
    rows = marked.agg(F.sum("_c")).first()[0] or 0.0
    place = {t: i for i, t in enumerate(library)}
    out = {}
    for k, f in enumerate(variables):
        n = Gram.empty(list(library), list(variables))
        mine = [(label_, t) for (f_, t), label_ in label.items() if f_ == f]
        at = {name: i for i, name in enumerate(g.terms)}
        for a, ta in mine:
            n.xy[place[ta], k] = g.xy[at[a], 0]
            for b, tb in mine:
                n.xx[place[ta], place[tb]] = g.xx[at[a], at[b]]
        n.yy[k] = rows * float((dphi**2).sum())
        out[f] = n
    return out


def residual_floor(noise: Mapping[str, Gram], sigma: Mapping[str, float], target: int):
    """Of coefficients, the length of the held-out residual that white noise of sizes sigma in the variables would leave."""
    return lambda c: float(np.sqrt(sum(sigma[f] ** 2 * n.rss(c, target) for f, n in noise.items())))


def weak_sindy_ode(df: DataFrame, variables: Sequence[str], dt: float, degree: int = 3, trig: bool = False, custom: Iterable[str] = (), half: int = 12, p: int = 8, tolerance: float = 0.05, swap: bool = True, accept: float = 1.1, rule: str = "fewest") -> dict:
    """Sparse weak regression; the last trajectory's (or last quarter's) test functions validate. accept: how many times the noise floor a model's error
    may be (0: no floor); rule: see `regression.accepted`."""
    library = build_library(variables, degree, trig, custom)
    rows = weak_ode_rows(df, variables, library, dt, half, p)
    ends = df.agg(F.min("traj").alias("a"), F.max("traj").alias("b"), F.max("step").alias("s")).first()
    held = F.col("traj") == ends["b"] if ends["a"] != ends["b"] else F.col("step") > 0.75 * ends["s"]
    terms = {t: F.col(f"x{i}") for i, t in enumerate(library)}
    found = grams(rows, terms, {v: F.col(f"y{i}") for i, v in enumerate(variables)}, F.when(held, "held").otherwise("train"))
    train, val = found["train"], found["held"]
    floors = {v: None for v in variables}
    if accept and rule == "fewest":
        sigma = {v: noise_level(df, v).first()["noise"] or 0.0 for v in variables}
        noise = noise_grams(df, variables, library, dt, half, held, p)
        floors = {v: residual_floor(noise, sigma, k) for k, v in enumerate(variables)}
    rhs, path = {}, {}
    for k, v in enumerate(variables):
        c, path[v] = regression.accepted(train, val, k, floors[v], tolerance, accept, swap, rule)
        rhs[v] = linear_combination(c, train.terms)
    lowest = {v: float(min((r["noise_floor"] for r in path[v]), default=0.0)) for v in variables}
    return {"rhs": rhs, "library_size": len(library), "test_functions": int(train.n + val.n), "val_noise_floor": lowest, "sparsity_path": path}


def _split_derivative(e: Expr, fields: Sequence[str]) -> tuple[float, list[tuple[str, float]], str] | None:
    """(coefficient, [(field, power)], suffix) if the term is c * product of powers * at most one derivative that integrates by parts exactly:
    a derivative of a field alone, or u**k * u_x = (u**(k+1))_x / (k + 1)."""
    if len(e.terms) != 1:
        return None
    ((m, c),) = e.terms.items()
    powers: dict[str, float] = {}
    partial = None
    for a, n in m:
        if not isinstance(a, Symbol):
            return None
        f, _, suffix = a.name.partition("_")
        if suffix and f in fields:
            if partial or n != 1:
                return None
            partial = f, suffix
        else:
            powers[a.name] = powers.get(a.name, 0) + n
    if partial is None:
        return c, list(powers.items()), ""
    f, suffix = partial
    if not powers:
        return c, [(f, 1.0)], suffix
    if len(suffix) == 1 and set(powers) == {f}:
        k = powers[f]
        return c / (k + 1), [(f, k + 1)], suffix
    return None


#: Draws of noise by which the floor of a field's weak residual is estimated.
NOISE_DRAWS = 2
#: Neighbouring centres along an axis that make a block.
BLOCK = 8


def _white(u: np.ndarray) -> float:
    """White noise of a field (time and space): third differences along the axis on which it is smoothest."""
    away = []
    for k in range(u.ndim):
        if u.shape[k] > 8:
            d = np.diff(u, 3, axis=k)
            away.append(1.4826 * float(np.median(np.abs(d - np.median(d)))) / np.sqrt(20.0))
    return min(away, default=0.0)


def _slope(plan: tuple, f: str, u: np.ndarray, names: Sequence[str], system: System) -> np.ndarray:
    """Derivative by the field f of a term's factor that is multiplied with the test function."""
    c, powers, _ = plan
    out = np.full(u.shape[:-1], c)
    for g, n in powers:
        x = u[..., names.index(g)] if g in names else np.broadcast_to(system.axis(g).reshape([-1 if d == g else 1 for d in system.dims]), u.shape[:-1])
        out = out * (n * x ** (n - 1) if g == f else x**n)
    return out


def weak_field_grams(frames: DataFrame, system: System, library: Mapping[str, Expr], dt: float, half_t: int | None = None, half_x: Mapping[str, int] | None = None, p: int = 8, blocks: bool = False) -> dict[str, Gram]:
    """{train, held: Gram} of projected terms, and {noise <field>: Gram} of what noise does to the held-out ones; a task for each trajectory, whose matrices are added up on the executors. Held out is the last
    trajectory; the only one serves for both. Widths are chosen from the data's corner modes where not given. blocks: instead, a matrix for each group of blocks of
    neighbouring test functions (BLOCK of them along time and each axis, so that most overlaps are within a block), of all trajectories."""
    names, dims = system.variables, system.dims
    terms = list(library)
    plan = {t: _split_derivative(e, names) for t, e in library.items()}
    wanted = set().union(*(library[t].symbols for t in terms if plan[t] is None), set())
    compiled = {t: library[t].numpy() for t in terms}
    q = len(names)
    ends = frames.agg(F.min("traj").alias("a"), F.max("traj").alias("b")).first()

    def axis_matrix(n: int, half: int, derivative: int, h: float, wrap: bool, stride: int) -> np.ndarray:
        values = bump(half, p, derivative) * (-1) ** derivative * h ** (1 - derivative)
        centres = range(0, n, stride) if wrap else range(half, n - half, stride)
        out = np.zeros((len(centres), n))
        for r, c in enumerate(centres):
            np.add.at(out[r], (c + np.arange(-half, half + 1)) % n if wrap else c + np.arange(-half, half + 1), values)
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from .fields import stacked

        pdf = pdf.sort_values("step")
        u = stacked(pdf, system)
        nt = len(u)
        ht = half_t or half_width(corner_mode(u), nt, p)
        hx = {}
        for k, d in enumerate(dims):
            n = system.grid[d][0]
            e = np.abs(np.fft.rfft(u, axis=1 + k)) ** 2
            e = np.moveaxis(e, 1 + k, 0).reshape(e.shape[1 + k], -1).mean(axis=1)
            above = np.flatnonzero(e > 10 * np.median(e[int(0.75 * len(e)) :]))
            hx[d] = (half_x or {}).get(d) or half_width(int(above[-1]) if len(above) else 1, n, p)
        wrap = system.boundary == "periodic"
        step = {d: system.grid[d][1] / (system.grid[d][0] - (not wrap)) for d in dims}

        def project(a: np.ndarray, suffix: str, time: int = 0) -> np.ndarray:
            out = np.tensordot(axis_matrix(nt, ht, time, dt, False, max(1, ht // 2)), a, (1, 0))
            for k, d in enumerate(dims):
                m = axis_matrix(system.grid[d][0], hx[d], suffix.count(d), step[d], wrap, max(1, hx[d] // 2))
                out = np.moveaxis(np.tensordot(m, out, (1, 1 + k)), 0, 1 + k)
            return out.ravel()

        values = derivatives(u, names, system, wanted) if wanted else {f: u[..., i] for i, f in enumerate(names)}
        columns_ = []
        for t in terms:
            if plan[t] is not None:
                c, powers, suffix = plan[t]
                base = np.full(u.shape[:-1], c)
                for f, n in powers:
                    base = base * (u[..., names.index(f)] if f in names else np.broadcast_to(system.axis(f).reshape([-1 if d == f else 1 for d in dims]), u.shape[:-1])) ** n
                columns_.append(project(base, suffix))
            else:
                columns_.append(project(np.broadcast_to(compiled[t](values), u.shape[:-1]), ""))
        y = np.stack([project(u[..., i], "", 1) for i in range(q)], axis=1)
        if blocks:
            count = [len(range(ht, nt - ht, max(1, ht // 2))), *[len(range(0, n, s) if wrap else range(hx[d], n - hx[d], s)) for d in dims for n, s in [(system.grid[d][0], max(1, hx[d] // 2))]]]
            place = np.stack([i.ravel() // BLOCK for i in np.indices(count)], axis=1)
            cells, at = np.unique(place, axis=0, return_inverse=True)
            theta, groups = np.stack(columns_, axis=1), {}
            for b, cell in enumerate(cells):
                mine = at.ravel() == b
                g = str(zlib.crc32(f"{pdf['traj'].iloc[0]}:{cell.tolist()}".encode()) % GROUPS)
                groups[g] = groups.get(g, 0.0) + packed_gram(theta[mine], y[mine])
            return pd.DataFrame({"label": list(groups), "m": list(groups.values())})
        label = "held" if pdf["traj"].iloc[0] == ends["b"] else "train"
        out = {label: packed_gram(np.stack(columns_, axis=1), y)}
        if label == "held":  # what white noise of each field's own size does to the rows, by draws that are the same in every run
            for i, f in enumerate(names):
                rng, size = np.random.default_rng((int(pdf["traj"].iloc[0]) & 0xFFFF, i)), _white(u[..., i])
                for _ in range(NOISE_DRAWS):
                    e = size * rng.standard_normal(u.shape[:-1])
                    moved = [project(e * _slope(plan[t], f, u, names, system), plan[t][2]) if plan[t] is not None and f in dict(plan[t][1]) else np.zeros(len(y)) for t in terms]
                    left = np.zeros_like(y)
                    left[:, i] = project(e, "", 1)
                    out[f"noise {f}"] = out.get(f"noise {f}", 0.0) + packed_gram(np.stack(moved, axis=1), left) / NOISE_DRAWS
        return pd.DataFrame({"label": list(out), "m": list(out.values())})

    return added(frames.select("traj", "step", *names).groupBy("traj").applyInPandas(run, "label string, m array<double>"), terms, names)


def weak_sindy(frames: DataFrame, system: System, dt: float, degree: int = 2, max_derivative: int = 4, custom: Iterable[str] = (), exclude: Iterable[str] = (), p: int = 8, tolerance: float = 0.1, swap: bool = True, half_t: int | None = None, half_x: Mapping[str, int] | None = None, accept: float = 1.1, rule: str = "fewest") -> dict:
    """Sparse weak regression of a field equation. With one trajectory, its own test functions serve for both fit and choice. accept, rule: as in
    `weak_sindy_ode`."""
    library = build_library(system.variables, degree, custom=custom, exclude=exclude, dims=system.dims, max_derivative=max_derivative, names=derivative_symbols(system.variables, system.dims, max_derivative))
    found = weak_field_grams(frames, system, library, dt, half_t, half_x, p)
    train, held = found.get("train", found["held"]), found["held"]
    kept = regression.near_dependent(train, 1e-10)
    train, held = train.keep(kept), held.keep(kept)
    noise = {f: found[f"noise {f}"].keep(kept) for f in system.variables if f"noise {f}" in found} if accept else {}
    rhs, path = {}, {}
    for k, f in enumerate(system.variables):
        floor = residual_floor(noise, dict.fromkeys(noise, 1.0), k) if noise else None
        c, path[f] = regression.accepted(train, held, k, floor, tolerance, accept, swap, rule)
        rhs[f] = linear_combination(c, train.terms)
    lowest = {f: float(min((r["noise_floor"] for r in path[f]), default=0.0)) for f in system.variables}
    return {"rhs": rhs, "library_size": len(library), "test_functions": int(train.n + held.n), "val_noise_floor": lowest, "sparsity_path": path}


def noise_level(df: DataFrame, value: str, by: Sequence[str] = ("traj",), order: Sequence[str] = ("step",)) -> DataFrame:
    """One row: noise from third differences, 1.4826 * median absolute deviation / sqrt(20)."""
    w = along(by, order)
    d = weighted(value, (-1.0, 3.0, -3.0, 1.0), (-3, -2, -1, 0), w)
    rows = df.select(d.alias("_d")).where("_d is not null").persist()
    try:
        middle = median(rows, "_d")
        away = median(rows, F.abs(F.col("_d") - F.lit(middle))) if middle is not None else None
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame([(away * 1.4826 / float(np.sqrt(20.0)) if away is not None else None,)], "noise double")
