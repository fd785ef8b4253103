"""How far to trust a field equation, and which field to start from next: everything on integrals against test functions, where noisy derivatives bias nothing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import linear_combination, parse
from . import assess as A
from . import fields, regression, uncertainty, weakform
from .library import build_library, derivative_symbols
from .simulate import integrate_pde
from .systems import System

#: Of test functions, which overlap by three quarters along each axis, one in so many counts as a sample, for each axis and time.
OVERLAP = 4
#: An addition whose change of BIC lies between these, or a removal below the third, can't be decided by the data.
ADDED, REMOVED = (-10.0, 2.0), 6.0


def coverage(frames: DataFrame, system: System) -> DataFrame:
    """field, least, most, deviation, noise (white, from third differences along the axis on which each frame is smoothest), trajectories, and the least and the
    largest amplitude that a trajectory reaches. One pass; a task adds up each trajectory it meets."""
    names, shape = system.variables, [system.grid[d][0] for d in system.dims]

    def white(u: np.ndarray) -> np.ndarray:
        sizes = []
        for k in range(1, u.ndim):
            if u.shape[k] > 8:
                d = np.diff(u, 3, axis=k).reshape(len(u), -1)
                sizes.append(1.4826 * np.median(np.abs(d - np.median(d, axis=1, keepdims=True)), axis=1) / np.sqrt(20.0))
        return np.min(sizes, axis=0) if sizes else np.zeros(len(u))

    def run(batches):
        for pdf in batches:
            for traj, own in pdf.groupby("traj"):
                for f in names:
                    u = np.stack([np.asarray(a, float) for a in own[f]]).reshape(-1, *shape)
                    yield pd.DataFrame({"traj": [str(traj)], "field": [f], "lo": [u.min()], "hi": [u.max()], "s": [u.sum()], "ss": [(u**2).sum()], "w": [(white(u) ** 2).sum()], "frames": [len(u)], "n": [u.size]})

    rows = frames.select("traj", *names).dropna().mapInPandas(run, "traj string, field string, lo double, hi double, s double, ss double, w double, frames long, n long")
    each = rows.groupBy("traj", "field").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(c).alias(c) for c in ("s", "ss", "w", "frames", "n")])
    reach = F.greatest(F.abs("lo"), F.abs("hi"))
    mean = F.sum("s") / F.sum("n")
    return each.groupBy("field").agg(
        F.min("lo").alias("least"), F.max("hi").alias("most"), F.sqrt(F.greatest(F.sum("ss") / F.sum("n") - mean * mean, F.lit(0.0))).alias("deviation"), F.sqrt(F.sum("w") / F.sum("frames")).alias("noise"),
        F.count("*").alias("trajectories"), F.min(reach).alias("least_amplitude"), F.max(reach).alias("largest_amplitude"),
    )


def coefficients_of(rhs: Mapping[str, str], system: System, terms: Sequence[str]) -> dict[str, np.ndarray]:
    """For each field, coefficients of a model in a library that holds all its terms."""
    names = derivative_symbols(system.variables, system.dims)
    place = {parse(t, names): i for i, t in enumerate(terms)}
    out = {}
    for f in system.variables:
        e, c = parse(rhs.get(f, "0"), names), np.zeros(len(terms))
        for m, x in e.terms.items():
            c[place[type(e)({m: 1.0})]] = x
        out[f] = c
    return out


def compare_fields(found: Mapping, system: System, models: Mapping[str, Mapping[str, str]], samples: float, limit: float = 2.0) -> dict:
    """Models on matrices of blocks of weak rows: error, BIC, z against the best over blocks; of those within `limit` standard errors of the best, the one of
    fewest terms is preferred. Terms outside the matrices' library are an error."""
    every = uncertainty.total(found)
    blocks = [g for g in found.values() if g.n]
    error, size = {}, {}
    for m, rhs in models.items():
        c = coefficients_of(rhs, system, every.terms)
        size[m] = sum(int(np.count_nonzero(x)) for x in c.values())
        error[m] = np.array([sum(max(g.rss(c[f], k), 0.0) / (every.yy[k] / every.n + 1e-300) for k, f in enumerate(system.variables)) for g in blocks])
    n = np.array([g.n for g in blocks])
    mean = {m: float(e.sum() / n.sum()) for m, e in error.items()}
    best = min(mean, key=mean.get)
    out = {}
    for m, e in error.items():
        d = (e - error[best]) - (mean[m] - mean[best]) * n  # what each block departs from the mean difference by
        spread = float(np.sqrt((d**2).sum() * len(n) / max(len(n) - 1, 1)) / n.sum())
        z = 0.0 if m == best or not spread else (mean[m] - mean[best]) / spread
        out[m] = {"nrmse": float(np.sqrt(mean[m] / len(system.variables))), "n_terms": size[m], "z_vs_best": float(z), **regression.information(mean[m] * samples, samples, size[m])}
    equal = [m for m in models if m == best or out[m]["z_vs_best"] < limit and mean[m] < 1.5 * mean[best] + 1e-12]
    preferred = min(equal, key=lambda m: (size[m], mean[m]))
    return {"models": out, "best": best, "preferred": preferred, "ranking": sorted(models, key=lambda m: (m != preferred, mean[m])), "indistinguishable": equal}


def divergence(starts: DataFrame, system: System, models: Mapping[str, Mapping[str, str]], noise: Mapping[str, float], t: np.ndarray, cap: float = 100.0) -> DataFrame:
    """key, score, until: from each start (key and an array for each field), how far the models' fields part: the mean over times and fields of their squared spread
    (averaged over the grid) in units of the noise, capped; and the time until the spread exceeds three times the noise (null if it doesn't).
    A model that blows up counts as parted. A start is one row of a task."""
    names, shape = system.variables, [system.grid[d][0] for d in system.dims]
    size = np.array([max(noise[f], 1e-12) for f in names])

    def run(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                u = np.stack([np.asarray(r[f], float).reshape(shape) for f in names], axis=-1)
                runs = np.stack([integrate_pde(m, system, u, t) for m in models.values()])
                spread = runs.std(axis=0).mean(axis=tuple(range(1, 1 + len(shape)))) / size
                spread = np.where(np.isfinite(spread), spread, np.inf)
                over = np.flatnonzero((spread > 3).any(axis=1))
                yield pd.DataFrame({"key": [str(r["key"])], "score": [float(np.minimum(spread**2, cap).mean())], "until": [float(t[over[0]]) if len(over) else None]})

    with_key = starts.select(F.col("key").cast("string").alias("key"), *names)
    return with_key.repartition(starts.sparkSession.sparkContext.defaultParallelism, "key").mapInPandas(run, "key string, score double, until double")


def candidates(frames: DataFrame, system: System, scale: Mapping[str, float], n: int = 12) -> tuple[DataFrame, list[str]]:
    """(key and an array for each field, descriptions): profiles on one axis of the size of each field, about its amplitude."""
    x = system.axis(system.dims[0])
    each = {f: A.field_candidates(x, scale[f], n, seed) for seed, f in enumerate(system.variables)}
    kinds = ("cosine", "pulse", "sum of four waves")
    told = [f"{kinds[i % 3]} of size " + ", ".join(f"{np.abs(each[f][i]).max():.3g} in {f}" for f in system.variables) for i in range(n)]
    rows = [(str(i), *[each[f][i].tolist() for f in system.variables]) for i in range(n)]
    return frames.sparkSession.createDataFrame(rows, "key string, " + ", ".join(f"{f} array<double>" for f in system.variables)), told


def assess_fields(
    frames: DataFrame, system: System, dt: float, rhs: Mapping[str, str], rivals: Mapping[str, Mapping[str, str]] | None = None, degree: int = 2, validation: Mapping | None = None,
    max_derivative: int = 4, best: int = 5,
) -> dict:
    """Terms with intervals, evidence for missing terms, edits and rivals that the data can't tell from the model, coverage, experiments, predictability and
    confidence of a field equation; in the form that `assess.verdict` reads. Starts of experiments are proposed on one axis only."""
    names = system.variables
    symbols = derivative_symbols(names, system.dims, max_derivative)
    models = {"model": dict(rhs), **{k: dict(m) for k, m in (rivals or {}).items()}}
    own = {f: parse(rhs.get(f, "0"), symbols) for f in names}
    extra = [t for m in models.values() for f in names for t in parse(m.get(f, "0"), symbols).coefficients()]
    library = build_library(names, degree, custom=extra, dims=system.dims, max_derivative=max_derivative, names=symbols)
    found = weakform.weak_field_grams(frames, system, library, dt, blocks=True)
    every = uncertainty.total(found)
    kept = sorted({*regression.near_dependent(every, 1e-10), *np.flatnonzero(sum(np.abs(c) for m in models.values() for c in coefficients_of(m, system, every.terms).values())).tolist()})
    found = {k: g.keep(kept) for k, g in found.items()}
    every, library = every.keep(kept), {every.terms[i]: library[every.terms[i]] for i in kept}
    samples = A.effective_samples(every.n, OVERLAP ** (1 + len(system.dims)))
    terms, removal, missing = A.term_statistics(found, names, own, library, samples)
    close = []
    for k, f in enumerate(names):
        support = np.flatnonzero(coefficients_of(rhs, system, every.terms)[f]).tolist()
        for e in uncertainty.local_search(every, k, support, samples, len(every.terms) + len(support)) if support else []:
            if ADDED[0] <= e["dbic"] < ADDED[1] if e["edit"] == "add" else e["dbic"] < REMOVED:
                close.append({"edit": e["edit"], "var": f, "term": e["term"], "dbic": e["dbic"], "rhs": {**rhs, f: linear_combination(e["coef"].values(), e["coef"])}})
    models |= {f"with {m['term']} in {m['var']}": {**rhs, m["var"]: linear_combination(m["coef"].values(), m["coef"])} for m in missing}
    compared = compare_fields(found, system, models, samples)
    table = {r["field"]: r.asDict() for r in coverage(frames, system).collect()}
    noise = {f: max(table[f]["noise"], 1e-3 * table[f]["deviation"]) for f in names}
    relative = max(table[f]["noise"] / (table[f]["deviation"] + 1e-12) for f in names)
    plausible = {"model": models["model"]} | {k: models[k] for k in compared["indistinguishable"]} | {f"{e['edit']} {e['term']} in {e['var']}": e["rhs"] for e in close[:3]}
    validation = validation or fields.validate_fields(frames, system, rhs, dt)
    n = frames.agg(F.max("step")).first()[0] + 1
    t = np.arange(n) * dt
    ranked, base, ahead = [], None, {"horizon": float(t[-1]), "horizon_is_full_data_span": True}
    if len(plausible) > 1:
        known = frames.where("step = 0").select(F.col("traj").alias("key"), *names)
        r = divergence(known, system, plausible, noise, t).agg(F.avg("score").alias("score"), F.percentile_approx(F.coalesce("until", F.lit(float(t[-1]))), 0.5).alias("h"), F.count("until").alias("parted")).first()
        base, ahead = r["score"], {"horizon": r["h"], "horizon_is_full_data_span": not r["parted"]}
        if len(system.dims) == 1:
            plan, told = candidates(frames, system, {f: table[f]["largest_amplitude"] for f in names})
            first = divergence(plan, system, plausible, noise, t[: max(3, int(0.4 * n))]).orderBy(F.desc("score"), "key").limit(best).collect()
            ranked = [{"description": told[int(r["key"])], "score": r["score"], "gain_vs_existing_data": r["score"] / base if base else None} for r in first]
    trust = A.grade({
        "every term is significant": all(x["significant"] for x in terms),
        "no missing term is strongly supported": not [m for m in missing if m["error_reduction"] >= 0.02],
        "held-out rollouts stay valid": not validation["rollout_blew_up"] and validation["rollout_valid_time"] >= 0.5 * validation["rollout_horizon"],
        "derivatives are explained": validation["deriv_nrmse"] < max(0.1, 3 * relative),
    })
    trajectories = max(r["trajectories"] for r in table.values())
    advice = [*(["noise is above 5 %: average repeats"] if relative > 0.05 else []), *(["fewer than three trajectories: start from more fields"] if trajectories < 3 else [])]
    told = [*compared["indistinguishable"], *[f"{e['edit']} {e['term']} in {e['var']}" for e in close[:4]]]
    return {
        "terms": terms, "basis": "weak form", "removal_evidence": removal, "missing_term_evidence": missing, "model_ambiguity": compared | {"undecided_edits": close}, "validation": dict(validation), "coverage": list(table.values()),
        "experiments": {"ranked": ranked, "existing_data_discrimination": base}, "predictability": ahead, "data_advice": advice, "questions_for_human": A.questions(terms, told), "confidence": trust,
    }
