"""Conserved quantities and changes of coordinates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Expr, linear_combination, parse
from . import regression
from .gram import within
from .library import build_library, columns
from .sindy import features
from .windows import unwrap


def find_invariants(df: DataFrame, variables: Sequence[str], dt: float, degree: int = 2, logs: bool = True, tolerance: float = 0.02, window: int = 9, most: int = 4) -> dict:
    """Combinations H of library terms that stay put along trajectories: those of least share of within-trajectory variation.

    kind `constraint`: the same value everywhere; `first integral`: a value for each trajectory. From one pass of grouped Gram matrices."""
    rows = features(df, variables, dt, window)
    least = rows.agg(*[F.min(v).alias(v) for v in variables]).first()
    positive = [v for v in variables if logs and least[v] > 0]
    library = build_library(variables, degree, custom=[f"log({v})" for v in positive], exclude=["1"])
    every, scatter = within(rows, columns(library), F.col("traj"))
    n, mean = every.n, every.xx[0] / every.n
    centred = every.xx / n - np.outer(mean, mean)
    size = np.sqrt(np.maximum(np.diag(centred), 0))
    at = [i for i in range(1, len(size)) if size[i] > 1e-12]
    scaled = regression.Gram([every.terms[i] for i in at], ["y"], centred[np.ix_(at, at)], np.zeros((len(at), 1)), np.zeros(1), n)
    kept = regression.near_dependent(scaled, 1e-9)
    at_all, at = at, [at[i] for i in kept]
    inner = scatter[np.ix_(at_all, at_all)] / n
    d = np.array([size[i] for i in at_all])
    w, v = np.linalg.eigh(inner / np.outer(d, d))
    out = []
    for value, vec in zip(w, v.T, strict=True):
        if np.sqrt(max(value, 0)) > tolerance or len(out) >= most:
            break
        c = vec / d
        c = np.where(np.abs(vec) < 0.02 * np.abs(vec).max(), 0.0, c)
        c = c / c[np.argmax(np.abs(c * d))]
        total = float(np.sqrt(max(c @ centred[np.ix_(at_all, at_all)] @ c, 0)))
        spread = float(np.sqrt(max(c @ inner @ c, 0)))
        reach = float(np.sqrt(((c * d) ** 2).sum()))
        out.append({"H": linear_combination(c, [every.terms[i] for i in at_all], 4), "rel_variation": spread / (reach + 1e-300), "kind": "constraint" if total <= 3 * tolerance * reach else "first integral"})
    spectrum = np.linalg.eigvalsh(centred[np.ix_(range(1, 1 + len(variables)), range(1, 1 + len(variables)))])
    share = np.sort(spectrum)[::-1].cumsum() / max(spectrum.sum(), 1e-300)
    return {"invariants": out, "dimension": int(np.searchsorted(share, 0.999) + 1), "independent_terms": len(kept)}


@dataclass
class Coordinates:
    """New coordinates as expressions of the old (forward), and back (inverse)."""

    name: str
    forward: dict[str, Expr]
    inverse: dict[str, Expr]

    @property
    def old(self) -> list[str]:
        return list(self.inverse)


#: Inverses of elementwise changes of one variable.
_ELEMENTWISE = {"log({})": "exp({})", "exp({})": "log({})", "sqrt({})": "({})**2", "1/{}": "1/({})", "{}": "{}"}


def make_coords(name: str, forward: Mapping[str, str], variables: Sequence[str], inverse: Mapping[str, str] | None = None) -> Coordinates:
    """inverse may be left out where every new coordinate is an elementwise change of one old one, times a number."""
    new = {z: parse(e, [*variables, "t"]) for z, e in forward.items()}
    if inverse is None:
        inverse = {}
        for z, e in new.items():
            own = sorted(e.symbols)
            hit = next((back for there, back in _ELEMENTWISE.items() if len(own) == 1 and parse(there.format(own[0])) == e), None)
            if hit is None and len(own) == 1 and len(e.terms) == 1 and (c := e.coefficients().get(own[0])):
                hit = f"{1 / c!r}*{{}}"
            if hit is None:
                raise ValueError(f"give the inverse of {z} = {e}")
            inverse[own[0]] = hit.format(z)
    if set(inverse) != set(variables):
        raise ValueError(f"the inverse must give {sorted(variables)}, not {sorted(inverse)}")
    return Coordinates(name, new, {v: parse(inverse[v], [*new, "t"]) for v in variables})


def transform_data(df: DataFrame, coords: Coordinates, most_bad: float = 0.01) -> tuple[DataFrame, float]:
    """Rows in new coordinates (angles unwrapped, up to 1 % undefined values filled), and the largest relative error of going there and back."""
    from .windows import fill_gaps

    rest = [c for c in df.columns if c not in coords.old]
    out = df.select(*rest, *coords.old, *[e.column().alias(z) for z, e in coords.forward.items()])
    facts = out.agg(*[F.avg((F.col(z).isNull() | F.isnan(z)).cast("double")).alias(z) for z in coords.forward]).first()
    if max(facts) > most_bad:
        raise ValueError(f"{max(facts):.1%} of the rows have no value in {coords.name}")
    back = [F.max(F.abs(e.column() - F.col(v))) / (F.stddev_pop(v) + F.lit(1e-12)) for v, e in coords.inverse.items()]
    error = max(x or 0.0 for x in out.agg(*[b.alias(f"e{i}") for i, b in enumerate(back)]).first())
    new = out.select(*rest, *[F.when(~F.isnan(z), F.col(z)).alias(z) for z in coords.forward])
    new = fill_gaps(new, list(coords.forward))
    for z, e in coords.forward.items():
        if "atan" in str(e):
            new = unwrap(new, z, 2 * np.pi if "atan2" in str(e) else np.pi)
    return new, float(error)


def map_back(coords: Coordinates, rhs: Mapping[str, str]) -> dict[str, str]:
    """The model in old variables: d(old)/dt = (d inverse / d z) g(z) + d inverse / dt, with z written as functions of the old."""
    g = {z: parse(rhs[z], [*coords.forward, "t"]) for z in coords.forward}
    out = {}
    for v, e in coords.inverse.items():
        total = e.diff("t")
        for z in coords.forward:
            total = total + e.diff(z) * g[z]
        out[v] = total.subs(coords.forward).text(8)
    return out


def map_forward(coords: Coordinates, rhs: Mapping[str, str]) -> dict[str, str]:
    """A model in old variables written in the new coordinates."""
    f = {v: parse(rhs[v], [*coords.old, "t"]) for v in coords.old}
    out = {}
    for z, e in coords.forward.items():
        total = e.diff("t")
        for v in coords.old:
            total = total + e.diff(v) * f[v]
        out[z] = total.subs(coords.inverse).text(8)
    return out
