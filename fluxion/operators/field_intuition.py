"""What fields on periodic grids suggest before any fit: growth and turning of Fourier modes, travelling waves, conserved means, parity.

Steps between frames are measured in chunks with a halo of one frame, so that a long trajectory is many tasks; quantiles over steps are sketches of bounded
size (exact up to ACCURACY steps, within 1 / ACCURACY of the rank beyond). What reaches the driver is a row for each mode of the grid.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fields
from .systems import System
from .windows import with_halo

#: Of quantiles over steps: their rank is right to one in so many.
ACCURACY = 10_000
#: Share of the strongest rate that a linear term must reach, and of the variance that the fit of rates must explain.
TELLING, EXPLAINED = 0.2, 0.5
#: Rates below this part of the strongest are rounding.
ROUNDING = 1e-6


def mode_steps(frames: DataFrame, field: str, dt: float, chunk: int = fields.CHUNK) -> DataFrame:
    """k, amp, growth, frequency: for each step of a trajectory and each Fourier mode of a field on one periodic axis, its amplitude before the step and
    the rates at which it grows and turns. The mean has no phase and the last mode of an even grid no sign of turning: both have frequency null. Steps
    before or after which a mode vanishes, and those over a missing frame, are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        u = np.stack([np.asarray(a, float) for a in pdf[field]])
        z = np.fft.rfft(u, axis=1)
        pairs = pdf["own"].to_numpy()[:-1] & (np.diff(pdf["step"].to_numpy()) == 1)
        before, after = z[:-1][pairs], z[1:][pairs]
        amp, then = np.abs(before), np.abs(after)
        seen = (amp > 0) & (then > 0)
        k = np.broadcast_to(np.arange(z.shape[1]), amp.shape)[seen]
        turn = np.angle(after[seen] * np.conj(before[seen])) / dt
        turn[(k == 0) | (2 * k == u.shape[1])] = np.nan
        return pd.DataFrame({"k": k, "amp": amp[seen], "growth": np.log(then[seen] / amp[seen]) / dt, "frequency": turn})

    rows = with_halo(frames.select("traj", "step", field).where(F.col(field).isNotNull()), chunk, 1)
    found = rows.groupBy("traj", "chunk").applyInPandas(run, "k int, amp double, growth double, frequency double")
    return found.withColumn("frequency", F.nanvl("frequency", F.lit(None).cast("double")))


def mode_rates(frames: DataFrame, field: str, length: float, dt: float, chunk: int = fields.CHUNK) -> pd.DataFrame:
    """k, wave_number, steps, power (mean square amplitude), growth and frequency (medians over the steps in which the mode is not below its 20 % quantile, where
    noise matters least), a row for each mode."""
    rows = mode_steps(frames, field, dt, chunk).persist()
    try:
        middle = lambda c, q: F.percentile_approx(c, q, ACCURACY)
        cut = rows.groupBy("k").agg(middle("amp", 0.2).alias("cut"), F.avg(F.col("amp") ** 2).alias("power"))
        kept = rows.join(F.broadcast(cut), "k").where("amp >= cut")  # a row for each mode of the grid
        own = kept.groupBy("k").agg(F.count("*").alias("steps"), F.first("power").alias("power"), middle("growth", 0.5).alias("growth"), middle("frequency", 0.5).alias("frequency")).toPandas()
    finally:
        rows.unpersist()
    own["wave_number"] = 2 * np.pi * own["k"] / length
    return own.sort_values("k", ignore_index=True)[["k", "wave_number", "steps", "power", "growth", "frequency"]]


def noise_of_modes(rates: pd.DataFrame, nodes: int) -> float:
    """White noise over the field's deviation in space, from the median power of the top quarter of its modes."""
    p, k = rates["power"].to_numpy(float), rates["k"].to_numpy()
    if not len(p):
        return 0.0
    floor = np.median(p[int(0.75 * len(p)) :]) / nodes
    variance = np.sum(np.where(2 * k == nodes, 1, 2) * np.where(k > 0, p, 0.0)) / nodes**2
    return float(np.sqrt(floor / variance)) if variance > 0 else 0.0


def dispersion(rates: pd.DataFrame) -> dict:
    """Growth of modes as const - xx k^2 + xxxx k^4 and frequency as x k - xxx k^3 by least squares over the modes well above the noise (30 times the median power
    of the top quarter): what linear terms of these coefficients would do. {} with fewer than four such modes."""
    if not len(rates):
        return {}
    floor = np.median(rates["power"].to_numpy()[int(0.75 * len(rates)) :])
    own = rates[(rates["power"] > 30 * floor) & (rates["k"] > 0) & rates["frequency"].notna()]
    if len(own) < 4:
        return {}
    k, g, w = (own[c].to_numpy(float) for c in ("wave_number", "growth", "frequency"))
    even, odd = np.column_stack([np.ones(len(k)), -(k**2), k**4]), np.column_stack([k, -(k**3)])
    fit = lambda m, y: np.linalg.lstsq(m / np.abs(m).max(axis=0), y, rcond=None)[0] / np.abs(m).max(axis=0)
    a, b = fit(even, g), fit(odd, w)
    explained = lambda m, c, y: float(1 - np.var(y - m @ c) / (np.var(y) + 1e-30))
    return {
        "const": float(a[0]), "xx": float(a[1]), "xxxx": float(a[2]), "growth_r2": explained(even, a, g), "x": float(b[0]), "xxx": float(b[1]), "frequency_r2": explained(odd, b, w),
        "k_max": float(k.max()), "modes": len(k), "growth_scale": float(np.abs(g).max()), "frequency_scale": float(np.abs(w).max()),
    }


def linear_terms(d: Mapping) -> dict[str, float]:
    """{order of derivative: coefficient} of the linear terms that account for a fifth or more of the strongest rate, where the fit explains the rates."""
    found, strongest = {}, max(d["growth_scale"], d["frequency_scale"]) if d else 0.0
    for share, scale, orders in (("growth_r2", "growth_scale", ("xx", "xxxx")), ("frequency_r2", "frequency_scale", ("x", "xxx"))):
        if d and d[share] > EXPLAINED and d[scale] > ROUNDING * strongest:
            found |= {o: d[o] for o in orders if abs(d[o]) * d["k_max"] ** len(o) > TELLING * d[scale]}
    return found


def moments(frames: DataFrame, field: str) -> DataFrame:
    """One row: mean_drift (deviation in time of the spatial mean, averaged over trajectories, over the field's deviation), skewness, and offset (mean over
    deviation); drift 0, the others null for a field that doesn't vary."""
    m = frames.select("traj", F.expr(f"aggregate({field}, 0D, (s, x) -> s + x) / size({field})").alias("m")).groupBy("traj").agg(F.stddev_pop("m").alias("d")).agg(F.avg("d").alias("d"))
    v = frames.select(F.explode(field).alias("v")).agg(F.stddev_pop("v").alias("s"), F.skewness("v").alias("skewness"), F.avg("v").alias("a"))
    return m.join(F.broadcast(v)).select(F.try_divide("d", F.col("s") + 1e-12).alias("mean_drift"), F.when(F.col("s") > 0, F.col("skewness")).alias("skewness"), F.try_divide("a", "s").alias("offset"))


def _modes(f: str, x: Mapping, _: Mapping) -> Iterator[tuple]:
    d, found = x["dispersion"], x["linear"]
    if found:
        sure = "medium" if max(d["growth_r2"], d["frequency_r2"]) > 0.6 else "low"
        named = ", ".join(f"{c:+.3g} {f}_{o}" for o, c in found.items())
        yield sure, f"rates of modes against wave number suggest linear terms: {named}; transfer between modes biases sizes more than signs", "weak_sindy", {"max_derivative": max(3, *(len(o) for o in found))}
    if "xx" in found and "xxxx" in found and found["xx"] < 0 and found["xxxx"] < 0:
        yield "medium", f"long waves of {f} grow and short ones decay: an instability of long waves, held by damping of fourth order", "weak_sindy", {"max_derivative": 4}


def _travels(f: str, x: Mapping, _: Mapping) -> Iterator[tuple]:
    c = (x["speed"] or {}).get("amplitude_correlation")
    if c is not None and abs(c) > 0.5:
        yield "medium", f"waves of {f} travel at a speed that depends on their size: advection by the field itself, {f}*{f}_x", "weak_sindy", {"degree": 2}


def _sources(f: str, x: Mapping, all_: Mapping) -> Iterator[tuple]:
    if x["conserved"]:
        yield "high" if (x["mean_drift"] or 0.0) < 0.005 else "medium", f"the mean of {f} is conserved: its equation is a divergence, without sources", "weak_sindy", {"exclude": powers(list(all_))}
    elif x["mean_drift"] is not None:
        yield "medium", f"the mean of {f} changes: sources such as {f}, {f}^2 or {f}^3", "weak_sindy", {"degree": 3}


def _parity(f: str, x: Mapping, _: Mapping) -> Iterator[tuple]:
    if x["skewness"] is not None and abs(x["skewness"]) < 0.15 and abs(x["offset"]) < 0.1:
        yield "low", f"{f} and -{f} are alike: terms are odd in {f} or advective, quadratic sources are unlikely", "detect_field_symmetries", {}


#: Rules that read the facts of one field.
RULES = (_modes, _travels, _sources, _parity)


def powers(names: list[str], degree: int = 3) -> list[str]:
    """1 and the products of fields up to a degree: sources."""
    out, last = ["1"], [()]
    for _ in range(degree):
        last = [(*p, f) for p in last for f in names if not p or f >= p[-1]]
        out += ["*".join(p) for p in last]
    return out


def intuit_fields(frames: DataFrame, system: System, dt: float, chunk: int = fields.CHUNK) -> dict:
    """{facts, hypotheses, config} of fields. Modes, speeds and the conservation of means are read on one periodic axis only (facts["note"] says so elsewhere); config:
    method, degree, max_derivative, exclude, to start a fit from. A field is taken to conserve its mean if that drifts by less than 2 % of the field's
    deviation and what noise does to a mean over the grid; sources are left out of the library only where all fields do."""
    nodes, one = int(np.prod([system.grid[d][0] for d in system.dims])), len(system.dims) == 1 and system.boundary == "periodic"
    each: dict[str, dict] = {}
    for f in system.variables:
        x = moments(frames, f).first().asDict() | {"dispersion": {}, "linear": {}, "speed": None, "noise_rel": 0.0, "modes": []}
        if one:
            length = system.grid[system.dims[0]][1]
            rates = mode_rates(frames, f, length, dt, chunk)
            d = dispersion(rates)
            x |= {"dispersion": d, "linear": linear_terms(d), "speed": fields.travelling_speed(frames, f, nodes, length, dt, chunk), "noise_rel": noise_of_modes(rates, nodes), "modes": rates.to_dict("records")}
        x["conserved"] = system.boundary == "periodic" and x["mean_drift"] is not None and bool(x["mean_drift"] < 0.02 + 2 * x["noise_rel"] / np.sqrt(nodes))
        each[f] = x
    found = [{"hypothesis": text, "confidence": sure, "try": {"tool": tool, "args": how}} for f, x in each.items() for rule in RULES for sure, text, tool, how in rule(f, x, each)]
    noise, closed = max(x["noise_rel"] for x in each.values()), all(x["conserved"] for x in each.values())
    facts = {"fields": each, "noise_rel": noise} | ({} if one else {"note": "modes and speeds need one periodic axis"})
    config = {"method": "strong" if one and noise < 0.002 else "weak", "degree": 2 if closed else 3, "max_derivative": 4, "exclude": powers(system.variables) if closed else []}
    return {"facts": facts, "hypotheses": sorted(found, key=lambda h: ("high", "medium", "low").index(h["confidence"])), "config": config}
