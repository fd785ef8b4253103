"""Which array is the field, which axis is what: decided from names, shapes and monotone vectors alone."""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np

from .ingest import SPACE_NAMES, TIME_NAMES, Card

#: How names say that something is a derivative of `{}`: u_x, uxx, u_dt, u_dot, uprime, u_deriv2; dudx, du_dt; du, ddu.
_SAYINGS = ("{}_?d?[txyz]{{1,4}}", "{}_?dot", "{}_?prime", "{}_?deriv\\w*", "d{}_?d[txyz]+", "d{{1,4}}{}")


def derivative_of(name: str, known: set[str]) -> str | None:
    """The array that a name calls a derivative of, if that array is there: the longest of them."""
    says = lambda base: any(re.fullmatch(s.format(re.escape(base)), name, re.IGNORECASE) for s in _SAYINGS)
    return max((b for b in known if b.lower() != name.lower() and says(b)), key=len, default=None)


def infer_arrays(arrays: Mapping[str, np.ndarray], card: Card, hints: Mapping[str, str] | None = None) -> dict:
    """{field, time, space, axes}: axes has a letter for each axis of the field: r trajectory, t time, x space, v variable.

    Vectors by name or by strict monotony tell axes by their length; an axis left over is variables if it has 8 entries at most, else
    trajectories; hints (field, axes, time) win."""
    hints = dict(hints or {})
    numeric = {k: np.asarray(a) for k, a in arrays.items() if np.asarray(a).dtype.kind in "fiub"}
    known = set(numeric)
    vectors = {k: a.ravel() for k, a in numeric.items() if a.size == max(a.shape, default=0) and a.size > 2}
    rising = {k for k, v in vectors.items() if np.all(np.diff(v) > 0) or np.all(np.diff(v) < 0)}
    named = lambda names: sorted((k for k in rising if k.lower() in names), key=lambda k: (names.index(k.lower()), k))
    time = hints.get("time") or next(iter(named(TIME_NAMES)), None)
    space = [k for k in named(SPACE_NAMES) if k != time]
    fields = {k: a for k, a in numeric.items() if a.ndim >= 2 and a.size != max(a.shape) and derivative_of(k, known) is None}
    name = hints.get("field") or max(fields, key=lambda k: (fields[k].size, k), default=None)
    if name is None:
        raise ValueError("no array of two or more axes: nothing to take for measurements")
    shape = numeric[name].shape
    if "axes" in hints:
        card.assume("axes", hints["axes"], "high", "given")
        return {"field": name, "time": time, "space": space, "axes": hints["axes"]}
    letters: list[str | None] = [None] * len(shape)

    def claim(vector: str | None, letter: str) -> None:
        if vector is not None:
            at = next((i for i, n in enumerate(shape) if letters[i] is None and n == vectors[vector].size), None)
            if at is not None:
                letters[at] = letter

    claim(time, "t")
    for s in space:
        claim(s, "x" if "x" not in letters else "y")
    sure = "high" if "t" in letters else "low"
    free = [i for i, x in enumerate(letters) if x is None]
    if "t" not in letters and free:
        at = max(free, key=lambda i: (shape[i], -i))
        letters[at] = "t"
        free.remove(at)
    for i in sorted(free, key=lambda i: shape[i]):
        letters[i] = "v" if "v" not in letters and shape[i] <= 8 else "r" if "r" not in letters else "x"
    axes = "".join(x or "r" for x in letters)
    card.assume("axes", axes, sure, "by length of named vectors" if sure == "high" else "the longest axis is taken for time")
    return {"field": name, "time": time, "space": space, "axes": axes}


def canonical(a: np.ndarray, axes: str) -> np.ndarray:
    """(trajectory, time, [x, [y]], variable), missing axes of one."""
    order = [c for c in "rtxyv" if c in axes]
    out = a.transpose([axes.index(c) for c in order])
    if "r" not in axes:
        out = out[None]
    return out if "v" in axes else out[..., None]


def match_derivatives(u: np.ndarray, dx: float, dt: float, given: Mapping[str, np.ndarray], limit: float = 0.3) -> dict[str, tuple[str, float]]:
    """For each given array of u's shape (time, x): the derivative of u it is nearest to, with the relative error, if below the limit."""
    own = {"u": u, "u_t": np.gradient(u, dt, axis=0)}
    x = u
    for k in range(1, 5):
        x = np.gradient(x, dx, axis=1)
        own["u_" + "x" * k] = x
    out = {}
    for name, a in given.items():
        if a.shape == u.shape:
            errors = {k: float(np.linalg.norm(a - v) / (np.linalg.norm(a) + 1e-300)) for k, v in own.items()}
            best = min(errors, key=errors.get)
            if errors[best] < limit:
                out[name] = (best, errors[best])
    return out
