"""How far to trust a model, and what to measure next."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import linear_combination, parse
from . import regression, scoring, uncertainty, weakform
from .diagnostics import coverage, diagnose, ranges
from .gram import grams, grouped
from .library import build_library, columns
from .sindy import features


def candidates(spark, box: Mapping[str, tuple[float, float]], n: int = 40, margin: float = 0.35, seed: int = 0) -> DataFrame:
    """candidate and variables: a Latin hypercube over the box of the data, widened by `margin` of its sides."""
    rng = np.random.default_rng(seed)
    cols = []
    for lo, hi in box.values():
        a, b = lo - margin * (hi - lo), hi + margin * (hi - lo)
        cols.append(a + (b - a) * (rng.permutation(n) + rng.random(n)) / n)
    rows = [(i, *[float(c[i]) for c in cols]) for i in range(n)]
    return spark.createDataFrame(rows, "candidate int, " + ", ".join(f"{v} double" for v in box))


def disagreement(runs: DataFrame, noise: Mapping[str, float], cap: float = 100.0, by: str = "candidate") -> DataFrame:
    """by, score: mean over steps and variables of the squared spread of models in units of the noise, capped."""
    spread = runs.groupBy(by, "step").agg(*[F.stddev_pop(v).alias(v) for v in noise])
    each = sum((F.least(F.coalesce((F.col(v) / s) * (F.col(v) / s), F.lit(cap)), F.lit(cap)) for v, s in noise.items()), F.lit(0.0)) / len(noise)
    return spread.groupBy(by).agg(F.avg(each).alias("score"))


def design_experiments(df: DataFrame, variables: Sequence[str], models: Mapping[str, Mapping[str, str]], noise: Mapping[str, float], t: np.ndarray, k: int = 5, n: int = 40) -> list[dict]:
    """Initial states at which plausible models differ most, best first, with the gain over the states that were measured."""
    box = {r["variable"]: (r["least"], r["most"]) for r in ranges(df, variables).collect()}
    plan = candidates(df.sparkSession, box, n).withColumnRenamed("candidate", "traj")
    known = df.where("step = 0").select(F.col("traj").cast("int").alias("traj"), *variables)
    score = lambda starts: disagreement(scoring.rollout(starts, models, t), noise, by="traj")
    base = score(known).agg(F.avg("score")).first()[0] or 0.0
    best = plan.join(score(plan), "traj").orderBy(F.desc("score"), "traj").limit(k).collect()
    return [{"initial_condition": [r[v] for v in variables], "score": r["score"], "gain_vs_existing_data": r["score"] / base if base else None} for r in best]


def perturbed(rhs: Mapping[str, str], names: Sequence[str], share: float = 0.05) -> dict[str, dict[str, str]]:
    """{term: model} with one coefficient raised by `share`."""
    out = {}
    for v, text in rhs.items():
        e = parse(text, names)
        for m, c in e.terms.items():
            moved = type(e)(e.terms | {m: c * (1 + share)})
            out[f"{v}: {type(e)({m: 1.0}).text(4)}"] = {**rhs, v: moved.text(12)}
    return out


def sensitivity(starts: DataFrame, rhs: Mapping[str, str], t: np.ndarray, share: float = 0.05) -> DataFrame:
    """model (the term moved), effect: relative change of trajectories for a relative change of each coefficient."""
    names = [*rhs, "t"]
    base = scoring.rollout(starts, rhs, t).drop("model")
    moved = scoring.rollout(starts, perturbed(rhs, names, share), t)
    e = scoring.step_errors(moved, base, list(rhs), ("traj", "model"))
    return e.groupBy("model").agg((F.avg(F.least("error", F.lit(10.0))) / share).alias("effect"))


def predictability(starts: DataFrame, models: Mapping[str, Mapping[str, str]], noise: Mapping[str, float], t: np.ndarray) -> dict:
    """Time until the spread of models exceeds three times the noise, median over starts."""
    runs = scoring.rollout(starts, models, t)
    spread = runs.groupBy("traj", "step", "t").agg(*[F.stddev_pop(v).alias(v) for v in noise])
    over = F.greatest(*[F.coalesce(F.col(v) / (3 * s), F.lit(1e9)) for v, s in noise.items()], F.lit(0.0)) > 1
    each = spread.groupBy("traj").agg(F.coalesce(F.min(F.when(over, F.col("t"))), F.max("t")).alias("h"), F.bool_or(over).alias("ends"))
    r = each.agg(F.median("h").alias("h"), F.bool_or("ends").alias("ends")).first()
    return {"horizon": r["h"], "horizon_is_full_data_span": not r["ends"]}


def grade(level_points: Mapping[str, bool]) -> dict:
    """Level from how many conditions hold: high from three, medium from one; reasons are those that hold, doubts the others."""
    yes = [k for k, ok in level_points.items() if ok]
    return {"level": "high" if len(yes) >= 3 else "medium" if yes else "low", "reasons": yes, "doubts": [k for k, ok in level_points.items() if not ok]}


def data_advice(facts: Mapping) -> list[str]:
    out = []
    if max(facts["noise_rel"].values()) > 0.05:
        out.append("noise is above 5 %: average repeats, or use the weak form")
    if max(facts["change_per_step"].values()) > 0.3:
        out.append("sampling is coarse against the dynamics: shorten the time step")
    if facts["n_traj"] < 3:
        out.append("fewer than three trajectories: start from more initial states")
    return out


def questions(terms: Sequence[Mapping], ambiguous: Sequence[str]) -> list[str]:
    out = [f"Is the term {t['term']} of d{t['var']}/dt expected? The data don't settle it." for t in terms if not t["significant"]]
    return out + ([f"Models {', '.join(ambiguous)} explain the data equally well: is one known to be unphysical?"] if len(ambiguous) > 1 else [])


def use_weak(facts: Mapping, kind: str = "ode") -> bool:
    """Whether noise or coarse steps make integrals against test functions a better basis than derivatives."""
    return max(facts["noise_rel"].values()) > (0.02 if kind == "ode" else 0.005) or max(facts["change_per_step"].values()) > 0.15


def weak_grams(df: DataFrame, variables: Sequence[str], library: Mapping, dt: float, half: int = 12, p: int = 8) -> dict:
    """Gram matrices of weak rows by groups of neighbouring test functions, so that overlapping ones are drawn together."""
    rows = weakform.weak_ode_rows(df, variables, library, dt, half, p)
    return grams(rows, {t: F.col(f"x{i}") for i, t in enumerate(library)}, {v: F.col(f"y{i}") for i, v in enumerate(variables)}, grouped("traj", F.floor(F.col("step") / (2 * half))))


def refit_disagreement(terms: Sequence[Mapping]) -> float:
    """The largest relative gap between a refitted coefficient (coef) and the model's own (given)."""
    return max((abs(t["coef"] - t["given"]) / (abs(t["given"]) + 1e-12) for t in terms if t.get("given") is not None), default=0.0)


def term_statistics(found: Mapping, variables: Sequence[str], own: Mapping, library: Mapping, effective: float | None = None) -> tuple[list[dict], list[dict], list[dict]]:
    """(terms with intervals, what removing each does to BIC, additions that lower BIC by more than 10, two for each variable), from blocks' matrices.

    `effective`: independent samples, rows over the length of their correlation (`effective_samples`); without it, each group counts as one."""
    every, place = uncertainty.total(found), {e: i for i, e in enumerate(library.values())}
    n = effective or len(found)
    terms, removal, missing = [], [], []
    for k, v in enumerate(variables):
        given = {place[type(own[v])({m: 1.0})]: c for m, c in own[v].terms.items() if type(own[v])({m: 1.0}) in place}
        support = sorted(given)
        if not support:
            continue
        terms += [{"var": v, "given": given[i], **t} for i, t in zip(support, uncertainty.coefficient_intervals(found, k, support), strict=True)]
        edits = uncertainty.local_search(every, k, support, n, len(every.terms) + len(support))
        error = every.error(regression.solve(every, k, support), k)
        removal += [{"var": v, "term": e["term"], "dBIC_if_removed": e["dbic"]} for e in edits if e["edit"] == "remove"]
        for e in [e for e in edits if e["edit"] == "add" and e["dbic"] < -10][:2]:
            left = every.error(regression.solve(every, k, e["support"]), k)
            missing.append({"var": v, "term": e["term"], "dBIC_if_added": e["dbic"], "error_reduction": 1 - left / max(error, 1e-300), "coef": e["coef"]})
    return terms, removal, missing


def effective_samples(rows: float, correlation: float) -> float:
    """Independent samples among rows of which about `correlation` neighbours say the same; ten at least."""
    return max(rows / correlation, 10.0)


#: Of weak rows, whose test functions overlap, a quarter counts.
WEAK_OVERLAP = 4


def weak_stats(df: DataFrame, variables: Sequence[str], dt: float, rhs: Mapping[str, str], degree: int = 2, half: int = 12, p: int = 8) -> dict:
    """Intervals, removals and additions on the weak form, where noisy derivatives bias nothing; test functions overlap, so that a quarter of them count."""
    names = [*variables, "t"]
    own = {v: parse(e, names) for v, e in rhs.items()}
    library = build_library(variables, degree, custom=[t for e in own.values() for t in e.coefficients()], names=names)
    found = weak_grams(df, variables, library, dt, half, p)
    terms, removal, missing = term_statistics(found, variables, own, library, effective_samples(uncertainty.total(found).n, WEAK_OVERLAP))
    return {"terms": terms, "removal_evidence": removal, "missing_term_evidence": missing, "basis": "weak form"}


def assess(df: DataFrame, variables: Sequence[str], dt: float, rhs: Mapping[str, str], rivals: Mapping[str, Mapping[str, str]] | None = None, degree: int = 2, window: int = 9) -> dict:
    """Terms with intervals, evidence for missing terms, rivals, coverage, experiments, predictability, confidence."""
    names = [*variables, "t"]
    facts = diagnose(df, variables, dt)
    rows = features(df, variables, dt, window)
    own = {v: parse(e, names) for v, e in rhs.items()}
    extra = [t for e in own.values() for t in e.coefficients()]
    library = build_library(variables, degree, custom=extra, names=names)
    shape = df.groupBy("traj").count().agg(F.max("count").alias("n")).first()["n"]
    block = uncertainty.block_of("step", shape, window)
    basis = "weak form" if use_weak(facts) else "derivatives"
    found = grams(rows, columns(library), {v: F.col(f"{v}_t") for v in variables}, grouped("traj", block)) if basis == "derivatives" else weak_grams(df, variables, library, dt)
    terms, removal, missing = term_statistics(found, variables, own, library, effective_samples(uncertainty.total(found).n, window if basis == "derivatives" else WEAK_OVERLAP))
    if basis == "derivatives" and refit_disagreement(terms) > 0.25:  # derivatives and model disagree: integrals decide
        basis, found = "weak form", weak_grams(df, variables, library, dt)
        terms, removal, missing = term_statistics(found, variables, own, library, effective_samples(uncertainty.total(found).n, WEAK_OVERLAP))
    models = {"model": dict(rhs), **{k: dict(m) for k, m in (rivals or {}).items()}}
    for i, m in enumerate(missing):  # a rival from each edit, with the edit's own coefficients
        models[f"with {m['term']} in {m['var']} ({i})"] = {**rhs, m["var"]: linear_combination(m["coef"].values(), m["coef"])}
    compared = uncertainty.compare_models(rows, models, F.struct("traj", block), correlation=window)
    validation = scoring.validate(df, variables, rhs, dt, window)
    scale = {r["variable"]: r["std"] for r in ranges(df, variables).collect()}
    noise = {v: max(facts["noise_rel"][v], 1e-3) * scale[v] for v in variables}
    plausible = {k: models[k] for k in compared["indistinguishable"]} | {"model": models["model"]}
    t = np.arange(shape) * dt
    starts = df.where("step = 0").select("traj", *variables)
    trust = grade({
        "every term is significant": all(x["significant"] for x in terms),
        "no missing term is strongly supported": not [m for m in missing if m["error_reduction"] >= 0.02],
        "held-out rollouts stay valid": validation["rollout_valid_time"] >= 0.5 * validation["rollout_horizon"],
        "derivatives are explained": max(validation["deriv_nrmse"].values()) < max(0.1, 3 * max(facts["noise_rel"].values())),
    })
    return {
        "terms": terms, "basis": basis, "removal_evidence": removal, "missing_term_evidence": missing, "model_ambiguity": compared, "validation": validation, "coverage": coverage(df, variables) if len(variables) > 1 else [],
        "experiments": {"ranked": design_experiments(df, variables, plausible, noise, t) if len(plausible) > 1 else []},
        "predictability": predictability(starts, plausible, noise, t) if len(plausible) > 1 else {"horizon": float(t[-1]), "horizon_is_full_data_span": True},
        "data_advice": data_advice(facts), "questions_for_human": questions(terms, compared["indistinguishable"]), "confidence": trust,
    }


def start_of(experiment: Mapping) -> str:
    return experiment.get("description") or str([round(x, 4) for x in experiment["initial_condition"]])


def verdict(a: Mapping) -> dict:
    """CONFIDENT, COLLECT MORE DATA, CONFIDENT IN PREDICTIONS or INCONCLUSIVE, with what to do."""
    if "confidence" not in a:
        return {"status": "INCONCLUSIVE", "recommendation": "there is no assessment"}
    level = a["confidence"]["level"]
    strong = [m for m in a["missing_term_evidence"] if m["dBIC_if_added"] < -10 and m.get("error_reduction", 1.0) >= 0.02]
    weak = [t for t in a["terms"] if not t["significant"]]
    ranked = a["experiments"]["ranked"]
    telling = bool(ranked) and ranked[0]["score"] > 1 and (ranked[0]["gain_vs_existing_data"] or np.inf) > 1.2
    doubts = bool(strong or weak) or len(a["model_ambiguity"]["indistinguishable"]) > 1
    if level == "high" and not strong and not weak or level != "low" and not doubts and not telling:
        return {"status": "CONFIDENT", "recommendation": "use the model"}
    if telling:
        return {"status": "COLLECT MORE DATA", "recommendation": f"start at {start_of(ranked[0])}"}
    if not a["validation"]["rollout_blew_up"] and a["predictability"]["horizon_is_full_data_span"] and not strong:
        return {"status": "CONFIDENT IN PREDICTIONS", "recommendation": "plausible models agree over the data's range, though their terms differ"}
    return {"status": "INCONCLUSIVE", "recommendation": "; ".join(a["data_advice"][:2]) or "more trajectories, less noise, or knowledge of the domain"}


def brief_markdown(a: Mapping) -> str:
    """An assessment on one page of Markdown: verdict, terms, rivals, what to measure next, open questions."""
    v = verdict(a)
    line = lambda *cells: "| " + " | ".join(map(str, cells)) + " |"
    parts = [f"# {v['status']}", v["recommendation"], f"Confidence: {a['confidence']['level']}. Basis: {a.get('basis', 'derivatives')}.", "## Terms", line("of", "term", "coefficient", "90 %", "significant"), line(*["-"] * 5)]
    parts += [line(t["var"], f"`{t['term']}`", f"{t['coef']:.4g}", f"{t['ci90'][0]:.4g} to {t['ci90'][1]:.4g}", "yes" if t["significant"] else "no") for t in a["terms"]]
    parts += ["## Missing terms", *([f"- `{m['term']}` in {m['var']}: BIC falls by {-m['dBIC_if_added']:.1f}" for m in a["missing_term_evidence"]] or ["none"])]
    parts += ["## Models that explain the data as well", ", ".join(a["model_ambiguity"]["indistinguishable"])]
    parts += ["## Next experiments", *([f"- start at {start_of(r)} (score {r['score']:.3g})" for r in a["experiments"]["ranked"]] or ["none"])]
    parts += ["## Questions", *([f"- {q}" for q in a["questions_for_human"]] or ["none"]), "## Advice", *([f"- {x}" for x in a["data_advice"]] or ["none"])]
    return "\n".join(parts) + "\n"


def coefficient_information(starts: DataFrame, rhs: Mapping[str, str], noise: Mapping[str, float], t: np.ndarray, share: float = 0.05) -> DataFrame:
    """traj, model (the coefficient moved), information: how far, in squared noise, a relative change of each coefficient moves a trajectory from
    each start; tells which experiment pins down which coefficient."""
    names = [*rhs, "t"]
    base = scoring.rollout(starts, rhs, t).drop("model", "t")
    moved = scoring.rollout(starts, perturbed(rhs, names, share), t)
    joined = moved.join(base.withColumnsRenamed({v: f"_{v}" for v in rhs}), ["traj", "step"])
    d = sum((((F.col(v) - F.col(f"_{v}")) / s) ** 2 for v, s in noise.items()), F.lit(0.0)) / share**2
    return joined.groupBy("traj", "model").agg(F.avg(F.least(F.coalesce(d, F.lit(1e12)), F.lit(1e12))).alias("information"))


def field_candidates(x: np.ndarray, scale: float, n: int = 12, seed: int = 0) -> list[np.ndarray]:
    """Starting profiles for field experiments: amplitudes, single modes and pulses within a third beyond the data's scale."""
    rng = np.random.default_rng(seed)
    s = (x - x[0]) / (x[-1] - x[0] + x[1] - x[0])
    out = []
    for k in range(n):
        a = scale * (0.3 + 1.05 * (k + rng.random()) / n)
        if k % 3 == 0:
            out.append(a * np.cos(2 * np.pi * (1 + k // 3) * s + rng.uniform(0, 2 * np.pi)))
        elif k % 3 == 1:
            out.append(a * np.exp(-(((s - rng.random() + 0.5) % 1 - 0.5) ** 2) / 0.005))
        else:
            out.append(a * sum(rng.normal() / m * np.cos(2 * np.pi * (m * s + rng.random())) for m in range(1, 5)))
    return out
