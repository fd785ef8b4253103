"""Simulation: models as row producers. A trajectory is the unit of parallelism; every trajectory has a seed of its own."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions import numerics as N
from ..functions.expressions import Expr, parse, split_linear_part
from .library import derivative_symbols
from .systems import SYSTEMS, System, initial_state


def ode_function(rhs: Mapping[str, str | Expr]) -> Callable[[float, np.ndarray], np.ndarray]:
    names = list(rhs)
    compiled = [(e if isinstance(e, Expr) else parse(e, [*names, "t"])).numpy() for e in rhs.values()]

    def f(t: float, y: np.ndarray) -> np.ndarray:
        values = dict(zip(names, y, strict=True)) | {"t": t}
        return np.array([c(values) for c in compiled], float)

    return f


def integrate_ode(rhs: Mapping[str, str], start: np.ndarray, t: np.ndarray) -> np.ndarray:
    return N.integrate(ode_function(rhs), np.asarray(start, float), np.asarray(t, float))


# --- partial differential equations


def derivatives(u: np.ndarray, names: Sequence[str], system: System, wanted: set[str]) -> dict[str, np.ndarray]:
    """The symbols wanted of fields u (..., *grid, fields): spectral on periodic axes, finite differences of order 4 otherwise."""
    nd = len(system.dims)
    out = {f: u[..., i] for i, f in enumerate(names)}
    for symbol in wanted:
        f, _, suffix = symbol.partition("_")
        if not suffix or f not in names:
            continue
        value = out[f]
        for k, d in enumerate(system.dims):
            order = suffix.count(d)
            if order:
                n, length, _ = system.grid[d]
                axis = value.ndim - nd + k
                value = N.spectral_derivative(value, length, order, axis) if system.boundary == "periodic" else np.moveaxis(np.moveaxis(value, axis, -1) @ N.difference_matrix(n, length / (n - 1), order).T, -1, axis)
        out[symbol] = value
    shape = u.shape[:-1]
    for k, d in enumerate(system.dims):
        if d in wanted:
            x = system.axis(d)
            out[d] = np.broadcast_to(x.reshape([-1 if j == k else 1 for j in range(nd)]), shape)
    return out


def pde_function(rhs: Mapping[str, str], system: System) -> Callable[[np.ndarray], np.ndarray]:
    names = list(system.rhs)
    own = [parse(rhs.get(f, "0"), derivative_symbols(names, system.dims)) for f in names]
    wanted = set().union(*(e.symbols for e in own))
    compiled = [e.numpy() for e in own]

    def f(u: np.ndarray) -> np.ndarray:
        values = derivatives(u, names, system, wanted)
        return np.stack([np.broadcast_to(c(values), u.shape[:-1]) for c in compiled], axis=-1)

    return f


def integrate_pde(rhs: Mapping[str, str], system: System, start: np.ndarray, t: np.ndarray, dt_sim: float | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """Fields at the times t, NaN after a blow-up. Periodic grids: exponential time differencing with the constant-coefficient linear part
    exact and 2/3 of the modes kept. Others: method of lines with implicit steps; end nodes follow `ends` (t, 2, fields) or their boundary."""
    return _spectral(rhs, system, start, t, dt_sim) if system.boundary == "periodic" else _lines(rhs, system, start, t, ends)


def _spectral(rhs: Mapping[str, str], system: System, start: np.ndarray, t: np.ndarray, dt_sim: float | None) -> np.ndarray:
    names, dims = list(system.rhs), system.dims
    axes = tuple(range(len(dims)))
    shape = start.shape[:-1]
    freq = [2 * np.pi * (np.fft.rfftfreq if k == len(dims) - 1 else np.fft.fftfreq)(system.grid[d][0], d=system.grid[d][1] / system.grid[d][0]) for k, d in enumerate(dims)]
    mesh = np.meshgrid(*freq, indexing="ij")
    keep = np.ones(mesh[0].shape, bool)
    for m in mesh:
        keep &= np.abs(m) <= np.abs(m).max() * 2 / 3
    symbols = derivative_symbols(names, dims)
    linear, rest = [], []
    for f in names:
        own, left = split_linear_part(parse(rhs.get(f, "0"), symbols), f)
        total = np.zeros(mesh[0].shape, complex)
        for s, c in own.items():
            factor = np.full(mesh[0].shape, c, complex)
            for k, d in enumerate(dims):
                factor = factor * (1j * mesh[k]) ** s.partition("_")[2].count(d)
            total += factor
        linear.append(total.real if np.abs(total.imag).max() == 0 else total)
        rest.append(left)
    kind = np.result_type(*linear)
    linear = np.stack([x.astype(kind) for x in linear], axis=-1)
    wanted = set().union(*(e.symbols for e in rest))
    compiled = [e.numpy() for e in rest]
    back = lambda v: np.fft.irfftn(v, s=shape, axes=axes)
    there = lambda u: np.fft.rfftn(u, axes=axes)

    def nonlinear(v: np.ndarray) -> np.ndarray:
        values = {f: back(v[..., i]) for i, f in enumerate(names)}
        for s in wanted:
            f, _, suffix = s.partition("_")
            if suffix and f in names:
                factor = np.ones(mesh[0].shape, complex)
                for k, d in enumerate(dims):
                    factor = factor * (1j * mesh[k]) ** suffix.count(d)
                values[s] = back(v[..., names.index(f)] * factor)
            elif s in dims:
                values[s] = system.axis(s).reshape([-1 if d == s else 1 for d in dims])
        out = [there(np.broadcast_to(c(values), shape)) * keep if e.terms else np.zeros(mesh[0].shape, complex) for c, e in zip(compiled, rest, strict=True)]
        return np.stack(out, axis=-1)

    v = np.stack([there(start[..., i]) for i in range(len(names))], axis=-1)
    out = np.full((len(t), *start.shape), np.nan)
    out[0] = start
    for i in range(len(t) - 1):
        gap = t[i + 1] - t[i]
        steps = max(1, round(gap / (dt_sim or system.dt_sim or gap)))
        v = N.etdrk4(linear, nonlinear, v, gap / steps, steps)
        u = np.stack([back(v[..., f]) for f in range(len(names))], axis=-1)
        if not np.all(np.isfinite(u)) or np.abs(u).max() > 1e6:
            break
        out[i + 1] = u
    return out


def _lines(rhs: Mapping[str, str], system: System, start: np.ndarray, t: np.ndarray, ends: np.ndarray | None) -> np.ndarray:
    shape = start.shape
    f = pde_function(rhs, system)
    n, length, _ = system.grid["x"]
    dx = length / (n - 1)
    slope = N.stencil((0.0, 1.0, 2.0, 3.0, 4.0), 1)

    def closed(u: np.ndarray, at: float) -> np.ndarray:
        u = u.copy()
        if ends is not None:
            for side, k in ((0, 0), (-1, 1)):
                u[side] = [np.interp(at, t, ends[:, k, j]) for j in range(shape[-1])]
        elif system.boundary == "neumann":  # end values that make the one-sided slope zero
            u[0] = -(np.tensordot(slope[1:], u[1:5], (0, 0))) / slope[0]
            u[-1] = -(np.tensordot(slope[1:], u[-2:-6:-1], (0, 0))) / slope[0]
        else:
            u[0], u[-1] = start[0], start[-1]
        return u

    def inner(at: float, y: np.ndarray) -> np.ndarray:
        u = np.concatenate([start[:1], y.reshape(n - 2, shape[-1]), start[-1:]])
        return f(closed(u, at))[1:-1].ravel()

    sub = max(2, int(np.ceil((t[1] - t[0]) / (0.5 * dx)))) if len(t) > 1 else 2
    flat = N.integrate_stiff(inner, start[1:-1].ravel(), t, min(sub, 8))
    return np.stack([closed(np.concatenate([start[:1], y.reshape(n - 2, shape[-1]), start[-1:]]), at) for at, y in zip(t, flat, strict=True)])


# --- data sets


def add_noise(u: np.ndarray, level: float, kind: str, rng: np.random.Generator) -> np.ndarray:
    """Noise of `level` times each variable's standard deviation. u: (time, ..., variables).

    gaussian; multiplicative (level times the value); red (AR(1) with 0.9 over time); outliers (gaussian, and ten times the size more on 1 % of the samples)."""
    if not level:
        return u
    scale = level * u.reshape(-1, u.shape[-1]).std(axis=0)
    white = rng.normal(size=u.shape)
    if kind == "multiplicative":
        return u * (1 + level * white)
    if kind == "red":
        for i in range(1, len(u)):
            white[i] = 0.9 * white[i - 1] + np.sqrt(1 - 0.81) * white[i]
    if kind == "outliers":
        white = white + np.where(rng.random(u.shape) < 0.01, np.where(rng.random(u.shape) < 0.5, 10.0, -10.0), 0.0)
    return u + scale * white


def trajectory(system: System, seed: int, traj: int, noise: float = 0.0, kind: str = "gaussian", t_end: float | None = None, every: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, clean and noisy values of one trajectory; starts that blow up or leave the system's band are drawn anew, 50 times at most."""
    rng = np.random.default_rng([seed, traj, int(hashlib.sha256(system.name.encode()).hexdigest()[:8], 16)])
    t = np.arange(round((t_end or system.t_end) / system.dt) + 1) * system.dt
    for _ in range(50):
        start = initial_state(system, rng)
        u = integrate_ode(system.rhs, start, t) if system.kind == "ode" else integrate_pde(system.rhs, system, start, t)
        good = np.all(np.isfinite(u))
        if good and system.valid:
            name, low, high = system.valid
            own = u[:, system.variables.index(name)]
            good = low < own.min() and own.max() < high
        if good:
            break
    return t[::every], u[::every], add_noise(u, noise, kind, rng)[::every]


def schema_of(system: System) -> str:
    kind = "double" if system.kind == "ode" else "array<double>"
    return "traj int, step int, t double, " + ", ".join(f"{v} {kind}" for v in system.variables)


def simulate(
    spark: SparkSession, name: str | System, trajectories: int = 4, seed: int = 0, noise: float = 0.0, kind: str = "gaussian",
    t_end: float | None = None, every: int = 1, first: int = 0,
) -> DataFrame:
    """obs(traj, step, t, <variables>) of an ODE, frames(traj, step, t, <field> arrays, row-major) of a PDE; a task for each trajectory."""
    system = name if isinstance(name, System) else SYSTEMS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for traj in batch["id"].tolist():
                t, _, u = trajectory(system, seed, traj, noise, kind, t_end, every)
                out = {"traj": np.int32(traj), "step": np.arange(len(t), dtype=np.int32), "t": t}
                for i, v in enumerate(system.variables):
                    out[v] = u[:, i] if system.kind == "ode" else list(u[..., i].reshape(len(t), -1))
                yield pd.DataFrame(out)

    return spark.range(first, first + trajectories, 1, trajectories).mapInPandas(run, schema_of(system))


def blind(system: System, seed: int) -> tuple[System, dict[str, str]]:
    """The system with variables renamed and coefficients moved by up to a quarter, under a name that tells nothing; and the renaming."""
    rng = np.random.default_rng(seed)
    names = {v: f"q{i}" for i, v in enumerate(system.variables)}
    if system.kind == "pde":
        names = {v: f"w{chr(97 + i)}" for i, v in enumerate(system.variables)}
    symbols = [*system.variables, "t"] if system.kind == "ode" else derivative_symbols(system.variables, system.dims)

    def renamed(symbol: str) -> str:
        f, sep, suffix = symbol.partition("_")
        return names.get(f, f) + sep + suffix if system.kind == "pde" else names.get(symbol, symbol)

    rhs = {}
    for v, text in system.rhs.items():
        e = parse(text, symbols)
        moved = Expr({m: c if abs(c) == 1 and not m else c * rng.uniform(0.75, 1.25) for m, c in e.terms.items()})
        rhs[names[v]] = moved.subs({s: parse(renamed(s)) for s in symbols}).text(6)
    hidden = f"blind_{hashlib.sha256(f'{seed}/{system.name}'.encode()).hexdigest()[:10]}"
    valid = (names[system.valid[0]], *system.valid[1:]) if system.valid else ()
    return System(hidden, rhs, system.start, system.dt, system.t_end, system.horizon, system.dims, system.boundary, system.grid, system.dt_sim, valid), names
