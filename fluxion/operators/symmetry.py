"""Symmetries of vector fields: nearest neighbours, generators, discrete maps, equivariant fits."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..functions.expressions import Expr, Symbol, linear_combination, parse, symbol
from . import regression
from .gram import Gram, grams
from .library import build_library, columns
from .sindy import features, train_and_held
from .uncertainty import cross_validate

#: Points of a cell's part and asked points that meet in one group; pivots, at most.
BLOCK, PIVOTS = 4096, 1024


def nearest(asked: DataFrame, points: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """id, other, place, distance: the k nearest other points (id, x) of every asked point, exactly; ties go to the smaller id.

    Cells around pivots (points by smallest hash, as many as there are blocks of points) and the triangle inequality: an asked point at distance d of its
    own pivot has k others within d plus that cell's (k + 1)-th distance to the pivot, so only cells whose nearest possible point lies within that
    bound see it. Points are read once for the pivots, once for the cells and once for the groups. Cells are dealt in parts of some `block` points, and the asked
    points that a cell sees in blocks, so no cell, however crowded, is one task. Every group keeps k candidates for each asked point."""
    spark, kind = points.sparkSession, points.schema["id"].dataType.simpleString()
    count = points.count()
    number = int(min(PIVOTS, max(1, -(-count // block))))
    pivots = points.orderBy(F.xxhash64("id", F.lit(3)), "id").select("x").limit(number).toPandas()
    empty = spark.createDataFrame([], f"id {kind}, other {kind}, distance double, place int")
    if not len(pivots):
        return empty
    at = spark.sparkContext.broadcast(np.stack(pivots["x"]).astype(float))
    number = len(pivots)

    def distances(x: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in at.value], axis=1)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = distances(np.stack(pdf["x"]).astype(float))
                yield pd.DataFrame({"id": pdf["id"], "x": pdf["x"], "cell": d.argmin(axis=1).astype(np.int32), "d": d.min(axis=1)})

    celled = points.select("id", F.col("x").cast("array<double>").alias("x")).mapInPandas(cells, f"id {kind}, x array<double>, cell int, d double")
    least = F.slice(F.array_sort(F.flatten(F.collect_list("ds"))), 1, k + 1)
    # the smallest distances of a cell by parts first, so that no list is longer than k + 1 for each part
    parts = celled.groupBy("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, count // block))).alias("p")).agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.slice(F.array_sort(F.collect_list("d")), 1, k + 1).alias("ds"))
    table = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), least.alias("ds")).toPandas().set_index("cell").reindex(range(number))
    low, high = table["lo"].fillna(np.inf).to_numpy(), table["hi"].fillna(-np.inf).to_numpy()
    size = table["n"].fillna(0).to_numpy(np.int64)
    kth = np.array([d[k] if isinstance(d, (list, np.ndarray)) and len(d) > k else np.inf for d in table["ds"]])
    facts = spark.sparkContext.broadcast((low, high, kth, size))

    def routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high, kth, size = facts.value
        for pdf in batches:
            if not len(pdf):
                continue
            d = distances(np.stack(pdf["x"]).astype(float))
            bound = (d + kth).min(axis=1)  # any cell's k + 1 points closest to its pivot hold k others
            reach = (np.maximum(np.maximum(low - d, d - high), 0) <= bound[:, None] * (1 + 1e-12)) & (size > 0)
            row, cell = np.nonzero(reach)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "x": pdf["x"].to_numpy()[row], "cell": cell.astype(np.int32)})

    sent = asked.select("id", F.col("x").cast("array<double>").alias("x")).mapInPandas(routes, f"id {kind}, x array<double>, cell int")
    seen = sent.groupBy("cell").count().toPandas().set_index("cell")["count"].reindex(range(number)).fillna(0).to_numpy(np.int64)
    share = spark.createDataFrame([(c, int(max(1, -(-size[c] // block))), int(max(1, -(-seen[c] // block)))) for c in range(number) if size[c] and seen[c]], "cell int, parts int, blocks int")
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(5)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = F.broadcast(share)  # PIVOTS rows at most
    met = celled.select("id", "x", "cell").join(share, "cell").withColumn("part", own("parts")).withColumn("block", every("blocks")).withColumn("ask", F.lit(False))
    met = met.unionByName(sent.join(share, "cell").withColumn("block", own("blocks")).withColumn("part", every("parts")).withColumn("ask", F.lit(True)))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf["ask"].to_numpy()
        ids, other = pdf["id"].to_numpy()[ask], pdf["id"].to_numpy()[~ask]
        if not len(ids) or not len(other):
            return pd.DataFrame({"id": ids[:0], "other": other[:0], "distance": np.zeros(0)})
        q, x = (np.stack(pdf["x"].to_numpy()[w]) for w in (ask, ~ask))
        out = []
        for lo in range(0, len(ids), 64):
            d = np.stack([((x - p) ** 2).sum(axis=1) for p in q[lo : lo + 64]])
            d[ids[lo : lo + 64, None] == other[None, :]] = np.inf
            n = min(k, len(other))
            edge = np.partition(d, n - 1, axis=1)[:, n - 1]
            for i in range(len(d)):  # ties at the edge all go on: the smaller id wins in the end
                j = np.flatnonzero((d[i] <= edge[i]) & np.isfinite(d[i]))
                if len(j) > n:
                    j = j[np.lexsort((other[j], d[i][j]))[:n]]
                out.append((np.repeat(ids[lo + i], len(j)), other[j], np.sqrt(d[i][j])))
        return pd.DataFrame({n: np.concatenate([o[c] for o in out]) for c, n in enumerate(("id", "other", "distance"))})

    found = met.select("cell", "part", "block", "id", "x", "ask").groupBy("cell", "part", "block").applyInPandas(search, f"id {kind}, other {kind}, distance double")
    w = Window.partitionBy("id").orderBy("distance", "other")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


# --- polynomial surrogate and its Lie algebra


def monomial_powers(q: int, degree: int) -> np.ndarray:
    return np.array([p for p in itertools.product(range(degree + 1), repeat=q) if sum(p) <= degree])


def choose_degree(df: DataFrame, variables: Sequence[str], dt: float, degrees: Sequence[int] = (1, 2, 3, 4, 5), window: int = 9, folds: int = 16) -> int:
    """The lowest degree whose error on left-out trajectories is within one standard error of the best. One pass: matrices of the largest library by
    trajectory (by `folds` groups of them where there are more; by stretches of time where there is one), of which lower degrees are parts."""
    library = build_library(variables, max(degrees))
    rows = features(df, variables, dt, window)
    ends = df.agg(F.count_distinct("traj").alias("k"), F.max("step").alias("s")).first()
    fold = F.pmod(F.col("traj").cast("long"), F.lit(folds)) if ends["k"] > 1 else F.floor(F.col("step") * 4 / (ends["s"] + 1))
    found = grams(rows, columns(library), {v: F.col(f"{v}_t") for v in variables}, fold)
    level = [max((sum(n for _, n in m) for m in e.terms), default=0) for e in library.values()]
    scores = {}
    for d in degrees:
        own = {k: g.keep([i for i, x in enumerate(level) if x <= d]) for k, g in found.items()}
        errors = [cross_validate(own, k, "fitter", fitter=lambda g, k: regression.solve(g, k, None, 1e-8)) for k in range(len(variables))]
        each = np.mean([list(e["errors"].values()) for e in errors], axis=0)
        scores[d] = float(each.mean()), float(each.std(ddof=1) / np.sqrt(len(each))) if len(each) > 1 else 0.0
    best = min(scores.values())
    return min(d for d, (e, _) in scores.items() if e <= best[0] + best[1])


def surrogate(df: DataFrame, variables: Sequence[str], dt: float, degree: int = 3, window: int = 9) -> tuple[dict[str, Expr], Gram]:
    """Polynomial vector field of the data (ridge), and its Gram matrix."""
    library = build_library(variables, degree)
    train, held = train_and_held(features(df, variables, dt, window), variables, library)
    g = train + held
    fields = {}
    for k, v in enumerate(variables):
        c = regression.stlsq(g, k, 1e-3)
        fields[v] = sum((library[t].scaled(float(x)) for t, x in zip(g.terms, c, strict=True) if x), Expr({}))
    return fields, g


def sample_states(df: DataFrame, variables: Sequence[str], n: int = 2000, seed: int = 0) -> np.ndarray:
    """n states by smallest hash (the same whatever the partitioning)."""
    rows = df.select("traj", "step", *variables).orderBy(F.xxhash64("traj", "step", F.lit(seed)), "traj", "step").limit(n).toPandas()
    return rows[list(variables)].to_numpy(float)


def bracket_sums(fields: Mapping[str, Expr], states: DataFrame | np.ndarray, affine: bool = False) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Products, summed over all states, of the brackets [A x, f] of the unit matrices A (i, j) with one another, and of the sizes J A x of their action.

    Of a table, brackets are columns, and one Gram matrix of them over its rows holds all sums: what reaches the driver is that matrix."""
    names = list(fields)
    q = len(names)
    labels = [(i, j) for i in range(q) for j in range(q + affine)]
    if isinstance(states, np.ndarray):
        values = {n: states[:, i] for i, n in enumerate(names)}
        whole = lambda e: np.broadcast_to(e.numpy()(values), len(states))
        f, jac = [whole(e) for e in fields.values()], [[whole(e.diff(n)) for n in names] for e in fields.values()]
        x, zero = [*values.values(), np.ones(len(states))], np.zeros(len(states))
    else:
        f, jac = [e.column() for e in fields.values()], [[e.diff(n).column() for n in names] for e in fields.values()]
        x, zero = [*map(F.col, names), F.lit(1.0)], F.lit(0.0)
    # A = e_i e_j^T: (A f)_k = delta_ki f_j; J A x = J[:, i] x_j
    action = [[jac[k][i] * x[j] for i, j in labels] for k in range(q)]
    bracket = [[(f[j] if k == i and j < q else zero) - action[k][c] for c, (i, j) in enumerate(labels)] for k in range(q)]
    if isinstance(states, np.ndarray):
        m, s = (np.array([np.concatenate([part[k][c] for k in range(q)]) for c in range(len(labels))]) for part in (bracket, action))
        return m @ m.T, s @ s.T, labels
    n = len(labels)
    each = states.select(F.explode(F.array(*[F.struct(*[c.cast("double").alias(f"c{i}") for i, c in enumerate([*bracket[k], *action[k]])]) for k in range(q)])).alias("z")).select("z.*")
    xx = grams(each, {f"c{i}": F.col(f"c{i}") for i in range(2 * n)}, {})[None].xx
    return xx[:n, :n], xx[n:, n:], labels


def linear_generators(fields: Mapping[str, Expr], states: DataFrame | np.ndarray, tolerance: float = 0.02, affine: bool = False) -> list[dict]:
    """Matrices A whose flow exp(sA) maps the vector field into itself: [A x, f] = 0 on all the states, by a generalized eigenproblem (size of the
    bracket against that of the generator's action). The trivial f itself is not linear, so it doesn't appear. Where several are found, `templates` names
    those known generators that lie in the space they span."""
    names = list(fields)
    q = len(names)
    m, s, labels = bracket_sums(fields, states, affine)
    own = s + 1e-9 * np.trace(s) / len(s) * np.eye(len(s))
    w, v = N.generalized_eigh(m, own)
    out = []
    for value, vec in zip(w, v.T, strict=True):
        if np.sqrt(max(value, 0)) > tolerance:
            break
        a = np.zeros((q, q + affine))
        for (i, j), x in zip(labels, vec, strict=True):
            a[i, j] = x
        a /= np.abs(a).max()
        out.append({"residual": float(np.sqrt(max(value, 0))), "matrix": a, "name": generator_name(a[:, :q], names)})
    inside = generators_in_span([g["matrix"][:, :q] for g in out], names) if out else []
    return [g | {"templates": inside} for g in out]


def principal_angles(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> np.ndarray:
    """Angles between the spaces that two sets of matrices span, smallest first."""
    bases = [np.linalg.qr(np.array([np.ravel(m) for m in part], float).T)[0] for part in (a, b)]
    return np.arccos(np.clip(np.linalg.svd(bases[0].T @ bases[1], compute_uv=False), -1, 1))


def generators_in_span(found: Sequence[np.ndarray], names: Sequence[str], tolerance: float = 0.1) -> list[str]:
    """Names of the rotations of a plane, the scaling of each variable and of all, that lie in the span of the matrices found: an eigenproblem gives any
    basis of it, in which a rotation and a scaling may be mixed."""
    q = len(names)
    unit = np.eye(q)
    known = {f"rotation in {names[i]}-{names[j]}": rotation_generator(i, j, q) for i in range(q) for j in range(i)}
    known |= {"scaling of all": unit} | ({f"scaling of {n}": np.outer(unit[i], unit[i]) for i, n in enumerate(names)} if q > 1 else {})
    return [name for name, a in known.items() if principal_angles(found, [a])[0] < tolerance]


def generator_name(a: np.ndarray, names: Sequence[str], tolerance: float = 0.1) -> str:
    a = a / (np.abs(a).max() or 1.0)
    skew, sym = (a - a.T) / 2, (a + a.T) / 2
    if np.abs(sym).max() < tolerance:
        planes = [f"{names[i]}-{names[j]}" for i in range(len(a)) for j in range(i) if abs(skew[i, j]) > tolerance]
        return f"rotation in {', '.join(planes)}"
    if np.abs(a - np.diag(np.diag(a))).max() < tolerance:
        return "scaling of " + ", ".join(f"{n}:{x:.2g}" for n, x in zip(names, np.diag(a), strict=True) if abs(x) > tolerance)
    return "linear map"


def _supported(moved: np.ndarray, states: np.ndarray, radius: float) -> np.ndarray:
    """Which of the moved states have one of the states within the radius."""
    return np.concatenate([(((moved[lo : lo + 256, None] - states[None]) ** 2).sum(axis=2).min(axis=1)) <= radius**2 for lo in range(0, len(moved), 256)])


def discrete_symmetries(fields: Mapping[str, Expr], states: np.ndarray, tolerance: float = 0.03, reversing: bool = True, least: float = 0.3) -> list[dict]:
    """Signed permutations S (variables four at most; sign flips beyond) with S f(x) = f(S x), or = -f(S x) if they turn time around.

    Compared where the data reach: a moved state counts if a state lies within the radius that most states have to their own neighbour, and a map
    that takes fewer than the share `least` of the states into the data's reach says nothing."""
    span = states.std(axis=0) + 1e-12
    scaled = states / span
    near = np.concatenate([np.partition(((scaled[lo : lo + 256, None] - scaled[None]) ** 2).sum(axis=2), min(1, len(scaled) - 1), axis=1)[:, min(1, len(scaled) - 1)] for lo in range(0, len(scaled), 256)])
    radius = max(0.1, 2 * float(np.sqrt(np.quantile(near, 0.95))))
    names = list(fields)
    q = len(names)
    order = list(itertools.permutations(range(q))) if q <= 4 else [tuple(range(q))]
    values = lambda x: np.stack([np.broadcast_to(e.numpy()({n: x[:, i] for i, n in enumerate(names)}), len(x)) for e in fields.values()], axis=1)
    f, out = values(states), []
    for p in order:
        for signs in itertools.product((1, -1), repeat=q):
            if p == tuple(range(q)) and all(s == 1 for s in signs):
                continue
            s = np.array(signs)
            moved = states[:, p] * s
            inside = _supported(moved / span, scaled, radius)
            if inside.mean() < least:
                continue
            there, size = values(moved), np.sqrt((f**2).mean()) + 1e-300
            for turn in (1, -1) if reversing else (1,):
                error = float(np.sqrt(((f[:, p] * s - turn * there)[inside] ** 2).mean()) / size)
                if error <= tolerance:
                    text = "(" + ", ".join(f"{'-' if k < 0 else ''}{names[i]}" for i, k in zip(p, signs, strict=True)) + ")"
                    out.append({"map": text, "time": "reversed" if turn < 0 else "kept", "error": error})
    return out


def detect_symmetries(df: DataFrame, variables: Sequence[str], dt: float, degree: int | None = 3, window: int = 9, tolerance: float = 0.05, sample: int = 2000) -> dict:
    """Generators from sums over all rows; discrete maps, which need the data's reach around every state, on `sample` states, drawn from ten times as many
    by hash so that thin regions count as much as crowded ones."""
    fields, _ = surrogate(df, variables, dt, degree or choose_degree(df, variables, dt, window=window), window)
    states = balanced_sample(sample_states(df, variables, 10 * sample), sample)
    return {"generators": linear_generators(fields, df, tolerance), "discrete": discrete_symmetries(fields, states, tolerance), "surrogate": {v: e.text(5) for v, e in fields.items()}}


def rotation_generator(i: int, j: int, q: int) -> np.ndarray:
    a = np.zeros((q, q))
    a[i, j], a[j, i] = -1.0, 1.0
    return a


def scaling_generator(weights: Sequence[float]) -> np.ndarray:
    return np.diag(np.asarray(weights, float))


# --- equivariant regression


def equivariance_constraints(library: Mapping[str, Expr], variables: Sequence[str], generators: Sequence[np.ndarray] = (), maps: Sequence[np.ndarray] = ()) -> np.ndarray:
    """Rows of linear conditions on the stacked coefficients (variable by variable) under which the model commutes with every generator A
    ([A x, f] = 0) and map S (S f(x) = f(S x)); by comparing coefficients of the library's monomials and of those that leave it."""
    terms = list(library)
    p, q = len(terms), len(variables)
    rows: dict[tuple, np.ndarray] = {}

    def add(tag: tuple, e: Expr, at: int) -> None:
        for m, c in e.terms.items():
            rows.setdefault((*tag, m), np.zeros(p * q))[at] += c

    x = [symbol(v) for v in variables]
    for k, a in enumerate(generators):
        ax = [sum((x[j].scaled(float(a[i, j])) for j in range(q) if a[i, j]), Expr({})) for i in range(q)]
        for t, term in enumerate(library.values()):
            flow = sum((term.diff(v) * ax[i] for i, v in enumerate(variables)), Expr({}))
            for i in range(q):
                add(("g", k, i), flow, i * p + t)
                for j in range(q):
                    if a[i, j]:
                        add(("g", k, i), term.scaled(-float(a[i, j])), j * p + t)
    for k, s in enumerate(maps):
        moved = {v: sum((x[j].scaled(float(s[i, j])) for j in range(q) if s[i, j]), Expr({})) for i, v in enumerate(variables)}
        for t, term in enumerate(library.values()):
            there = term.subs(moved)
            for i in range(q):
                add(("m", k, i), there, i * p + t)
                for j in range(q):
                    if s[i, j]:
                        add(("m", k, i), term.scaled(-float(s[i, j])), j * p + t)
    return np.array(list(rows.values())) if rows else np.zeros((0, p * q))


def equivariant_sindy(df: DataFrame, variables: Sequence[str], dt: float, degree: int = 3, generators: Sequence[np.ndarray] = (), maps: Sequence[np.ndarray] = (), threshold: float = 0.02, window: int = 9) -> dict:
    """Thresholded least squares within the models that respect the symmetries; free_parameters is their dimension."""
    library = build_library(variables, degree)
    train, held = train_and_held(features(df, variables, dt, window), variables, library)
    g = train + held
    p, q = len(g.terms), len(variables)
    conditions = equivariance_constraints(library, variables, generators, maps)
    free = N.null_space(conditions).shape[1]
    big = np.kron(np.diag(1 / np.maximum(g.yy, 1e-300)), g.xx)
    rhs = np.concatenate([g.xy[:, k] / max(g.yy[k], 1e-300) for k in range(q)])
    off: set[int] = set()
    c = np.zeros(p * q)
    for _ in range(20):
        extra = np.eye(p * q)[sorted(off)] if off else np.zeros((0, p * q))
        basis = N.null_space(np.vstack([conditions, extra]))
        c = basis @ np.linalg.lstsq(basis.T @ big @ basis, basis.T @ rhs, rcond=1e-12)[0] if basis.shape[1] else np.zeros(p * q)
        size = np.abs(c) * np.sqrt(np.diag(big))
        small = {i for i in range(p * q) if i not in off and size[i] < threshold}
        if not small:
            break
        off |= small
    c[sorted(off)] = 0.0
    models = {v: linear_combination(c[k * p : (k + 1) * p], g.terms) for k, v in enumerate(variables)}
    return {"rhs": models, "free_parameters": int(free), "error": {v: g.error(c[k * p : (k + 1) * p], k) for k, v in enumerate(variables)}}


# --- fields


def field_symmetries(rhs: Mapping[str, str], names: Sequence[str]) -> dict:
    """Of a 1-D field equation given as text: translations (no x or t), reflection x -> -x with u -> u or -u, and Galilean boosts u -> u + c,
    x -> x + k c t, with k if there is one."""
    own = {f: parse(e, names) for f, e in rhs.items()}
    fields = list(rhs)
    every = frozenset().union(*(e.symbols for e in own.values()))
    order = lambda s: len(s.partition("_")[2]) if s.partition("_")[0] in fields else 0
    out: dict = {"translation": not every & {"x", "t"}, "reflections": []}
    for sign in (1, -1):
        moved = {s: symbol(s).scaled(float(sign * (-1) ** order(s))) for s in every if s.partition("_")[0] in fields} | ({"x": symbol("x").scaled(-1.0)} if "x" in every else {})
        if all(e.subs(moved) == e.scaled(float(sign)) for e in own.values()):
            out["reflections"].append("x -> -x" + (", u -> -u" if sign < 0 else ""))
    if len(fields) == 1:
        f = fields[0]
        shifted = own[f].subs({f: symbol(f) + symbol("_c")}) - own[f]
        slope = symbol(f"{f}_x")
        boost = next((c for m, c in shifted.terms.items() if dict(m).get(Symbol("_c")) == 1), None)
        if boost is not None and (shifted - slope * symbol("_c").scaled(boost)).terms == {}:
            out["galilean"] = -boost
    return out




def balanced_sample(states: np.ndarray, n: int, k: int = 10, power: float = 1.0, seed: int = 0) -> np.ndarray:
    """n of the states (a bounded sample), with chances proportional to the distance of their k-th neighbour to a power: thin regions count more."""
    scaled = (states - states.mean(axis=0)) / (states.std(axis=0) + 1e-12)
    radius = np.empty(len(scaled))
    for lo in range(0, len(scaled), 256):
        d = ((scaled[lo : lo + 256, None, :] - scaled[None, :, :]) ** 2).sum(axis=2)
        radius[lo : lo + 256] = np.sqrt(np.partition(d, min(k, d.shape[1] - 1), axis=1)[:, min(k, d.shape[1] - 1)])
    weight = radius**power
    return states[np.random.default_rng(seed).choice(len(states), min(n, len(states)), replace=False, p=weight / weight.sum())]
