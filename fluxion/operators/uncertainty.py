"""Uncertainty on Gram matrices: folds, blocks, bags and comparisons cost one pass over the rows together.

A bag of blocks is a weighted sum of the blocks' matrices, exactly the matrix of the resampled rows; a training fold is the total less one fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import regression
from .gram import Gram, grams, grouped
from .library import build_library, columns
from .sindy import features


def block_of(step: str, samples: int, window: int = 9) -> Column:
    """Contiguous blocks of max(2 * window, samples / 25, 4) steps, a short last one merged into its neighbour."""
    size = max(2 * window, samples // 25, 4)
    return F.least(F.floor(F.col(step) / size), F.lit(max(0, samples // size - 1))).cast("int")


def fold_of(trajectories: int, samples: int, traj: str = "traj", step: str = "step") -> Column:
    """Folds by trajectory if there are three or more, else four stretches of time."""
    return F.col(traj).cast("int") if trajectories >= 3 else F.least(F.floor(F.col(step) * 4 / samples), F.lit(3)).cast("int")


def total(found: Mapping) -> Gram:
    parts = [found[k] for k in sorted(found, key=str)]
    return sum(parts[1:], parts[0])


def cross_validated(found: Mapping, target: int, fitter: Callable[[Gram, int], np.ndarray]) -> dict:
    """{fold: error on it of the fit to all others}."""
    every = total(found)
    return {k: g.error(fitter(every - g, target), target) for k, g in found.items()}


def cross_validate(found: Mapping, target: int, mode: str = "refit", coef: np.ndarray | None = None, support: Sequence[int] | None = None, fitter: Callable[[Gram, int], np.ndarray] | None = None) -> dict:
    """Errors on folds of a model whose coefficients stay (fixed), are refitted on a support to the other folds (refit), or of whatever a fitter makes of
    them (fitter), with their mean and standard error and how alike the folds' sets of terms are."""
    fits = {"fixed": lambda g, k: np.asarray(coef, float), "refit": lambda g, k: regression.solve(g, k, support), "fitter": fitter}
    if mode not in fits or fits[mode] is None:
        raise ValueError(f"mode {mode!r}: give fixed with coef, refit with support, or fitter with a function")
    every, errors, sets = total(found), {}, []
    for k in sorted(found, key=str):
        c = fits[mode](every - found[k], target)
        errors[k] = found[k].error(c, target)
        sets.append({every.terms[i] for i in np.flatnonzero(c)})
    e = np.array(list(errors.values()))
    return {"errors": errors, "mean": float(e.mean()), "se": float(e.std(ddof=1) / np.sqrt(len(e))) if len(e) > 1 else 0.0, "stability": term_stability(sets)}


def bags(blocks: Mapping[int, Gram], count: int, draws: int) -> Iterator[Gram]:
    """Bags of `draws` blocks by a portable integer hash: (bag * 7919 + slot * 104729) mod 1000003 mod blocks."""
    for inside, _ in bags_and_rest(blocks, count, draws):
        yield inside


def bags_and_rest(blocks: Mapping[int, Gram], count: int, draws: int) -> Iterator[tuple[Gram, Gram | None]]:
    """Each bag, and the blocks that it left out (None if there are none)."""
    keys = sorted(blocks)
    for b in range(count):
        picked = np.bincount([(b * 7919 + s * 104729) % 1000003 % len(keys) for s in range(draws)], minlength=len(keys))
        parts = [blocks[k].times(float(n)) for k, n in zip(keys, picked, strict=True) if n]
        rest = [blocks[k] for k, n in zip(keys, picked, strict=True) if not n]
        yield sum(parts[1:], parts[0]), sum(rest[1:], rest[0]) if rest else None


#: Chances of 0, 1, 2, ... draws of a block in a bag (Poisson, mean 1), summed up.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def block_bootstrap_mean(blocks: DataFrame, count: int, traj: str = "traj", block: str = "k") -> DataFrame:
    """bag, v: means over bags of blocks (traj, k, s, n). Each bag takes a block so often as a portable hash of (bag, traj, k) says, Poisson
    with mean 1: one partial aggregate, no numbering of blocks and no join."""
    bag = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("bag")
    u = ((F.col("bag").cast("long") * 7919 + F.col(traj).cast("long") * 104729 + F.col(block).cast("long") * 1299709) % 1000003) / 1000003.0
    draws = sum(((F.col("u") >= p).cast("int") for p in POISSON), F.lit(0))
    rows = blocks.select(traj, block, "s", "n", bag).select("bag", "s", "n", u.alias("u")).select("bag", "s", "n", draws.alias("w"))
    return rows.groupBy("bag").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("v"))


def ensemble(df: DataFrame, variables: Sequence[str], dt: float, degree: int = 2, count: int = 50, window: int = 9, consensus: float = 0.6, threshold: float | None = None, **library) -> dict:
    """Bags of blocks: inclusion probability, median and 5-95 % range of every term, and the refit of terms beyond the consensus share."""
    rows = features(df, variables, dt, window)
    shape = df.groupBy("traj").count().agg(F.max("count").alias("n"), F.count("*").alias("k")).first()
    lib = build_library(variables, degree, **library)
    key = grouped("traj", block_of("step", shape["n"], window))
    found = grams(rows, columns(lib), {v: F.col(f"{v}_t") for v in variables}, key)
    blocks = {i: found[k] for i, k in enumerate(sorted(found))}
    every, out = total(blocks), {}
    for k, v in enumerate(variables):
        fits = []
        for g, rest in bags_and_rest(blocks, count, len(blocks)):
            fits.append(regression.stlsq(g, k, threshold) if threshold is not None else regression.sparsest(g, rest or g, k))
        c = np.array(fits)
        share = (c != 0).mean(axis=0)
        kept = np.flatnonzero(share >= consensus)
        refit = regression.solve(every, k, kept)
        out[v] = {
            t: {"inclusion": float(share[i]), "median": float(np.median(c[c[:, i] != 0, i])) if share[i] else 0.0, "q05": float(np.quantile(c[:, i], 0.05)), "q95": float(np.quantile(c[:, i], 0.95)), "refit": float(refit[i])}
            for i, t in enumerate(every.terms)
            if share[i]
        }
    return out


def coefficient_intervals(blocks: Mapping, target: int, support: Sequence[int], count: int = 100) -> list[dict]:
    """Block bootstrap of the coefficients of a fixed support: 90 % interval, significant if it leaves out 0."""
    keyed = {i: blocks[k] for i, k in enumerate(sorted(blocks, key=str))}
    c = np.array([regression.solve(g, target, support)[list(support)] for g in bags(keyed, count, len(keyed))])
    best = regression.solve(total(keyed), target, support)
    terms = total(keyed).terms
    low, high = np.quantile(c, 0.05, axis=0), np.quantile(c, 0.95, axis=0)
    return [{"term": terms[i], "coef": float(best[i]), "ci90": (float(a), float(b)), "significant": bool(a * b > 0)} for i, a, b in zip(support, low, high, strict=True)]


def paired_z(df: DataFrame, difference: str, block: Sequence[str]) -> DataFrame:
    """blocks, z: mean over blocks of the mean difference, in standard errors."""
    each = df.groupBy(*block).agg(F.avg(difference).alias("d"))
    return each.agg(F.count("*").alias("blocks"), (F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))).alias("z"))


def compare_models(rows: DataFrame, models: Mapping[str, Mapping[str, str]], block: Column, limit: float = 2.0, correlation: float | None = None) -> dict:
    """Models against derivatives (columns `<v>_t` of features): error, BIC, z against the best over blocks; the model with fewest
    terms of those within `limit` standard errors of the best is preferred.

    BIC takes as samples the rows over the length of their correlation, so that it grows with the data; without a length, the number of blocks. Blocks stay on
    the executors, all of them: what reaches the driver is one row."""
    from ..functions.expressions import parse

    variables = list(next(iter(models.values())))
    names = [*dict.fromkeys([*variables, "t", *[c for c in rows.columns if not c.endswith("_t")]])]
    scale = rows.agg(*[F.avg(F.col(f"{v}_t") ** 2).alias(v) for v in variables]).first()
    error = {m: sum((((parse(rhs[v], names).column() - F.col(f"{v}_t")) ** 2 / (scale[v] + 1e-300) for v in variables)), F.lit(0.0)) for m, rhs in models.items()}
    at = {m: f"_m{i}" for i, m in enumerate(models)}
    each = rows.select(block.alias("_b"), *[e.alias(at[m]) for m, e in error.items()]).groupBy("_b").agg(F.count("*").alias("_n"), *[F.avg(c).alias(c) for c in at.values()]).persist()
    try:  # one aggregate for the means, one for the differences to the best: a row for all blocks each
        row = each.agg(F.count("*").alias("n"), F.sum("_n").alias("rows"), *[F.avg(c).alias(c) for c in at.values()]).first()
        n, samples = row["n"], row["n"] if correlation is None else max(row["rows"] / correlation, 10.0)
        mean = {m: float(row[c]) for m, c in at.items()}
        best = min(mean, key=mean.get)
        spread = each.agg(*[F.stddev_samp(F.col(c) - F.col(at[best])).alias(c) for c in at.values()]).first()
    finally:
        each.unpersist()
    out = {}
    for m, rhs in models.items():
        d = spread[at[m]]
        z = 0.0 if m == best or not d else float((mean[m] - mean[best]) / (d / np.sqrt(n)))
        k = sum(len(parse(e, names).terms) for e in rhs.values())
        out[m] = {"nrmse": float(np.sqrt(mean[m] / len(variables))), "n_terms": k, "z_vs_best": z, **regression.information(mean[m] * samples, samples, k)}
    equal = [m for m in models if out[m]["z_vs_best"] < limit]
    preferred = min(equal, key=lambda m: (out[m]["n_terms"], mean[m]))
    return {"models": out, "best": best, "preferred": preferred, "ranking": sorted(models, key=lambda m: (m != preferred, mean[m])), "indistinguishable": equal}


def term_stability(sets: Sequence[set]) -> float:
    """Mean Jaccard similarity of all pairs of term sets."""
    pairs = [(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    return float(np.mean([len(a & b) / max(1, len(a | b)) for a, b in pairs])) if pairs else 1.0


def local_search(g: Gram, target: int, support: Sequence[int], effective: float | None = None, most: int = 3) -> list[dict]:
    """Every single removal and addition of a term, refitted; the `most` best by change of BIC."""
    n = effective or g.n
    bic = lambda s: regression.information(g.rss(regression.solve(g, target, s), target), g.n, len(s), n)["bic"]
    base = bic(list(support))
    edits = [{"edit": "remove", "term": g.terms[i], "dbic": bic([j for j in support if j != i]) - base, "support": [j for j in support if j != i]} for i in support if len(support) > 1]
    edits += [{"edit": "add", "term": g.terms[i], "dbic": bic([*support, i]) - base, "support": sorted([*support, i])} for i in range(len(g.terms)) if i not in support and g.xx[i, i] > 0]
    edits.sort(key=lambda e: e["dbic"])
    for e in edits:
        e["coef"] = dict(zip([g.terms[j] for j in e["support"]], regression.solve(g, target, e["support"])[e["support"]].tolist(), strict=True))
    return edits[:most]


def repair(g: Gram, target: int, support: Sequence[int], effective: float | None = None, rounds: int = 6) -> list[int]:
    """Greedy: the best edit is taken while an addition lowers BIC by more than 10 or a removal lowers it at all."""
    own = list(support)
    for _ in range(rounds):
        best = local_search(g, target, own, effective, 1)
        if not best or best[0]["dbic"] >= (-10 if best[0]["edit"] == "add" else 0):
            break
        own = best[0]["support"]
    return own


def noise_floor(variables: Sequence[str], noise: Mapping[str, float], dt: float, window: int = 9, order: int = 3) -> dict[str, float]:
    """Deviation of a smoothed derivative that white noise of the given size alone would cause: the filter's own gain."""
    from ..functions.numerics import savgol_weights

    gain = float(np.sqrt(np.sum(np.square(savgol_weights(window, order, 1))))) / dt
    return {v: gain * noise[v] for v in variables}


def white_noise(seed: int, *keys: str) -> Column:
    """A standard normal by hash of whole-number keys: the same for a row whatever the partitioning (two uniforms of a quadratic congruential hash)."""
    primes, m = (7919, 104729, 1299709, 15485863), F.lit(2147483647)
    square = lambda x: F.pmod(x * x, m)  # noqa: E731  squares break up the even spacing that a linear hash of steps has
    step = lambda x: F.pmod(x * 48271 + 11, m)
    start = lambda s: F.pmod(sum((F.col(k).cast("long") * F.lit(p) for k, p in zip(keys, primes, strict=False)), F.lit(s * 611953)), m)
    u = lambda s: (step(square(step(square(start(s))))) + F.lit(0.5)) / F.lit(2147483647.0)
    return F.sqrt(-2.0 * F.log(u(seed + 1))) * F.cos(2.0 * np.pi * u(seed + 2))


def calibrated_floor(df: DataFrame, variables: Sequence[str], dt: float, window: int = 9, order: int = 3, method: str = "savgol", seed: int = 0) -> dict[str, dict[str, float]]:
    """For each variable: noise (from what a 7-point cubic filter leaves, calibrated by its centre weight), noise_rel (over the deviation), and floor:
    the error of derivatives, relative to their size, that noise of that size alone causes through the same filters, measured on seeded normals.

    A model whose derivative error is near the floor is as good as these data allow. All rows take part, in two passes of windows over chunks."""
    from ..functions.numerics import savgol_weights
    from .windows import smooth_and_differentiate

    centre = float(savgol_weights(7, 3)[3])
    left = smooth_and_differentiate(df.select("traj", "step", *variables), variables, dt, 7, 3, ends=False)
    row = left.agg(*[F.stddev_pop(F.col(v) - F.col(f"{v}_s")).alias(f"r_{v}") for v in variables], *[F.stddev_pop(v).alias(f"s_{v}") for v in variables]).first()
    noise = {v: float(row[f"r_{v}"] or 0.0) / np.sqrt(1 - centre) for v in variables}
    drawn = df.select("traj", "step", *[(white_noise(seed + 3 * k, "traj", "step") * F.lit(noise[v])).alias(v) for k, v in enumerate(variables)])
    rms = lambda d: d.agg(*[F.sqrt(F.avg(F.col(f"{v}_t") ** 2)).alias(v) for v in variables]).first()
    own, alone = (rms(smooth_and_differentiate(d.select("traj", "step", *variables), variables, dt, window, order, method, ends=method == "fd")) for d in (df, drawn))
    return {v: {"noise": float(noise[v]), "noise_rel": float(noise[v]) / (float(row[f"s_{v}"] or 0.0) + 1e-12), "floor": float(alone[v] or 0.0) / (float(own[v] or 0.0) + 1e-300)} for v in variables}


def select_thresholds(train: Gram, held: Gram, thresholds: Sequence[float] = regression.THRESHOLDS) -> dict[str, float]:
    """For each target, the threshold of its sweep's choice."""
    return {v: regression.sweep(train, held, k, thresholds)[0]["threshold"] for k, v in enumerate(train.targets)}
