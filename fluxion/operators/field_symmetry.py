"""Symmetries of field data, measured: a sparse surrogate u_t = F[u] is fitted, then transformed fields are put through it.

Every frame is tested in the task that holds it; what leaves a task is sums of squares and products, a few numbers for each test, which add up to
norms over all frames. Tests: dependence on place, mirrors with signs of the fields, signs and swaps of the fields, shifts and boosts, linear generators.

A residual counts against the noise of the surrogate: half the disagreement of the same terms fitted to the fitting and to the left-out part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import linear_combination
from . import regression
from .fields import field_grams, smooth_space, stacked, train_and_held
from .library import build_library
from .simulate import derivatives, pde_function
from .systems import System

#: A surrogate noisier than this decides nothing.
NOISIEST = 0.15


def field_maps(fields: list[str]) -> dict[str, np.ndarray]:
    """Signs of the fields (all but none) and exchanges of two, as matrices."""
    out = {}
    for signs in itertools.product((1, -1), repeat=len(fields)):
        if -1 in signs:
            out[", ".join(f"{f} -> -{f}" for f, s in zip(fields, signs, strict=True) if s < 0)] = np.diag(np.array(signs, float))
    for i, j in itertools.combinations(range(len(fields)), 2):
        swap = np.eye(len(fields))
        swap[[i, j]] = swap[[j, i]]
        out[f"{fields[i]} <-> {fields[j]}"] = swap
    return out


def fitted(frames: DataFrame, system: System, dt: float, degree: int, max_derivative: int, window: int, fraction: float | None) -> tuple[list[dict[str, str]], dict[str, float], dict[str, bool]]:
    """The surrogate fitted to everything, to the fitting part and to the rest, on the same terms; and by field, what terms in sin and cos of the place
    take from the left-out error (a share of the time derivative), and whether that is less than a tenth of the error or a hundredth in all."""
    names = list(system.variables)
    plain = build_library(names, degree, dims=system.dims, max_derivative=max_derivative)
    waves = []
    for d in system.dims:
        length = system.grid[d][1]
        waves += [f"{w}({2 * np.pi * k / length!r}*{d})*{b}" for k in (1, 2) for w in ("sin", "cos") for b in ["1", *[f"{f}{s}" for f in names for s in ("", f"_{d}", f"_{d}{d}")]]]
    placed = build_library(names, degree, dims=system.dims, max_derivative=max_derivative, custom=waves)
    train, held = train_and_held(field_grams(frames, system, placed, dt, window, 3, fraction))  # one pass: the plain library is part of it
    at = [i for i, t in enumerate(train.terms) if t in plain]
    small, rest = train.keep(at), held.keep(at)
    models: list[dict[str, str]] = [{}, {}, {}]
    gain, free = {}, {}
    for k, f in enumerate(names):
        without, _ = regression.sweep(small, rest, k)
        within, _ = regression.sweep(train, held, k)
        gain[f] = max(0.0, without["val_err"] - within["val_err"])
        free[f] = gain[f] < max(0.1 * without["val_err"], 0.01)
        whole = small + rest
        support = np.flatnonzero(regression.stlsq(whole, k, without["threshold"]))
        for model, g in zip(models, (whole, small, rest), strict=True):
            model[f] = linear_combination(regression.solve(g, k, support), g.terms, 12)
    return models, gain, free


def measure(frames: DataFrame, system: System, models: list[dict[str, str]], fraction: float | None) -> dict[str, np.ndarray]:
    """Sums over all frames, by test. Maps: squares of F[Gu] - G F[u] and F[Gu] + G F[u], and of the differences of the two part models in both.
    Shifts: products of (F[u + c] - F[u]) / c, its difference between the part models and the gradients; c is given as `step`. Generators: products of DF[u]Au - A F[u] by matrix
    unit, the same for the difference, and of the two sides."""
    names, nd = list(system.variables), len(system.dims)
    q = len(names)
    spread = frames.select(*[F.explode(F.arrays_zip(*names)).alias("z")]).agg(*[F.stddev_pop(f"z.{f}").alias(f) for f in names]).first()
    step = [0.25 * float(spread[f] or 0.0) + 1e-12 for f in names]
    maps: dict[str, tuple[np.ndarray, int | None]] = {g: (m, None) for g, m in field_maps(names).items()}
    for k, d in enumerate(system.dims):
        maps[f"{d} -> -{d}"] = (np.eye(q), k)
        maps |= {f"{d} -> -{d}, {g}": (m, k) for g, m in field_maps(names).items()}
    units = [np.outer(np.eye(q)[a], np.eye(q)[b]) for a in range(q) for b in range(q)]

    def sums(u: np.ndarray, own: list) -> Iterator[tuple[str, np.ndarray]]:
        now = [m(u) for m in own]
        yield "size", np.array([(now[0] ** 2).sum()])
        for name, (matrix, axis) in maps.items():
            move = lambda v, g=matrix, a=axis: (np.flip(v, 1 + a) if a is not None else v) @ g.T
            pairs = [(m(move(u)), move(f)) for m, f in zip(own, now, strict=True)]
            minus, plus = [a - b for a, b in pairs], [a + b for a, b in pairs]
            yield f"map:{name}", np.array([(r**2).sum() for r in (minus[0], plus[0], minus[1] - minus[2], plus[1] - plus[2])])
        slopes = derivatives(u, names, system, {f"{f}_{d}" for f in names for d in system.dims})
        for i, f in enumerate(names):
            moved = u.copy()
            moved[..., i] += step[i]
            change = [m(moved) - n for m, n in zip(own, now, strict=True)]
            parts = [change[0], change[1] - change[2], *[np.stack([slopes[f"{g}_{d}"] for g in names], axis=-1) for d in system.dims]]
            flat = np.stack([p.ravel() for p in parts])
            flat[:2] /= step[i]
            yield f"shift:{f}", (flat @ flat.T).ravel()
        sides = []
        for m, n in zip(own, now, strict=True):
            left, right = [], []
            for e in units:
                turned = u @ e.T
                h = 1e-3 * np.abs(u).max() / (np.abs(turned).max() + 1e-30)
                left.append(((m(u + h * turned) - m(u - h * turned)) / (2 * h)).ravel())
                right.append((n @ e.T).ravel())
            sides.append((np.stack(left), np.stack(right)))
        gap = [a - b for a, b in sides]
        yield "unlike", (gap[0] @ gap[0].T).ravel()
        yield "noise", ((gap[1] - gap[2]) @ (gap[1] - gap[2]).T / 4).ravel()
        yield "sides", (sides[0][0] @ sides[0][0].T + sides[0][1] @ sides[0][1].T).ravel()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [pde_function(m, system) for m in models]
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                u = stacked(pdf.iloc[lo : lo + 64], system)
                u = u[np.isfinite(u).all(axis=tuple(range(1, nd + 2)))]
                if len(u):
                    for name, x in sums(smooth_space(u, system, fraction) if fraction else u, own):
                        total[name] = total.get(name, 0.0) + x
        for name, x in total.items():
            yield pd.DataFrame({"test": name, "i": range(len(x)), "x": x})

    found = frames.select(*names).mapInPandas(run, "test string, i int, x double").groupBy("test", "i").agg(F.sum("x").alias("x"))
    out: dict[str, dict[int, float]] = {}
    for r in found.collect():  # some tens of numbers
        out.setdefault(r["test"], {})[r["i"]] = r["x"]
    return {t: np.array([v[i] for i in range(len(v))]) for t, v in out.items()} | {"step": np.array(step)}


def detect_field_symmetries(
    frames: DataFrame, system: System, dt: float, degree: int = 2, max_derivative: int = 4, window: int = 9, fraction: float | None = 0.3,
    tolerance: float = 0.05, sigma: float = 2.0,
) -> dict:
    """translation (with the gain by field), maps, shifts, generators and the surrogate.

    maps: {name: symmetry | reversing | inconclusive | no}; shifts: by field, shift | boost (with the velocity by axis of the frame for a shift of one)
    | no; generators: matrices A of u -> u + eps A u; for one field [[1]] says that the equation is linear. A test passes where its residual, as a
    share of F, is below tolerance or `sigma` times the noise, and the noise below NOISIEST. Without a finite frame, or where F vanishes, only the
    translation and the surrogate are given."""
    if not system.dims:
        raise ValueError("fields need an axis")
    names, q = list(system.variables), len(system.variables)
    models, gain, free = fitted(frames, system, dt, degree, max_derivative, window, fraction)
    got = measure(frames, system, models, fraction)
    out: dict = {"translation": all(free.values()), "gain": gain, "surrogate": models[0], "maps": {}, "shifts": {}, "generators": []}
    size = float(np.sqrt(got.get("size", np.zeros(1))[0]))
    if size <= 1e-12:
        return out

    def good(error: float, noise: float) -> bool:
        return error < max(tolerance, sigma * noise) and noise < NOISIEST

    for test, x in got.items():
        kind, _, name = test.partition(":")
        if kind == "map":
            kept, turned, kept_noise, turned_noise = np.sqrt(x) / size / np.array([1, 1, 2, 2])
            lost = min(kept - sigma * kept_noise, turned - sigma * turned_noise) < 0 and min(kept, turned) < 0.5
            out["maps"][name] = "symmetry" if good(kept, kept_noise) else "reversing" if good(turned, turned_noise) else "inconclusive" if lost else "no"
        elif kind == "shift":
            g = x.reshape(2 + len(system.dims), -1)
            slope = np.linalg.pinv(g[2:, 2:])
            velocity = slope @ g[2:, 0]
            c = got["step"][names.index(name)] / size
            left = [c * np.sqrt(max(0.0, g[i, i] - g[i, 2:] @ slope @ g[2:, i])) for i in (0, 1)]
            change = c * np.sqrt(g.diagonal()[:2])
            if good(change[0], change[1] / 2):
                out["shifts"][name] = {"kind": "shift"}
            elif good(left[0], left[1] / 2) and left[0] < 0.5 * change[0]:
                out["shifts"][name] = {"kind": "boost", "velocity": dict(zip(system.dims, (-velocity).tolist(), strict=True))}
            else:
                out["shifts"][name] = {"kind": "no"}
    unlike, noise, sides = (got[t].reshape(q * q, q * q) for t in ("unlike", "noise", "sides"))
    scale = np.sqrt(np.maximum(sides.diagonal(), 1e-300))
    root = np.linalg.cholesky(sides / np.outer(scale, scale) + 1e-12 * np.eye(q * q))
    inner = np.linalg.solve(root, np.linalg.solve(root, unlike / np.outer(scale, scale)).T)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    for v, y in zip(value, vector.T, strict=True):
        a = np.linalg.solve(root.T, y) / scale
        if good(np.sqrt(max(v, 0.0)), np.sqrt(max(0.0, a @ noise @ a) / (a @ sides @ a))):
            matrix = (a / a[np.abs(a).argmax()]).reshape(q, q)
            out["generators"].append(matrix)
    return out
