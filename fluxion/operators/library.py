"""Term libraries as column expressions, and splits of rows."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Expr, parse


def derivative_suffixes(dims: Sequence[str], order: int) -> list[str]:
    """x, xx, ..., with mixed partials once, letters sorted; by order."""
    return ["".join(c) for k in range(1, order + 1) for c in itertools.combinations_with_replacement(dims, k)]


def derivative_symbols(fields: Sequence[str], dims: Sequence[str] = ("x",), order: int = 4) -> list[str]:
    return [*fields, *[f"{f}_{s}" for f in fields for s in derivative_suffixes(dims, order)], *dims]


def monomials(names: Sequence[str], degree: int) -> list[str]:
    return ["*".join(c) for k in range(1, degree + 1) for c in itertools.combinations_with_replacement(names, k)]


def build_library(
    variables: Sequence[str], degree: int = 3, trig: bool = False, custom: Iterable[str] = (), exclude: Iterable[str] = (),
    dims: Sequence[str] = (), max_derivative: int = 4, library_vars: Sequence[str] | None = None, names: Sequence[str] | None = None,
) -> dict[str, Expr]:
    """Terms in order: monomials (with sin and cos of variables, if asked) for ODEs; for PDEs also each derivative times monomials of degree at
    most 2 (1 in two dimensions). Terms that are equal after expansion come once."""
    own = list(library_vars or variables)
    texts = ["1", *monomials(own, degree)]
    if dims:
        most = 2 if len(dims) == 1 else 1
        partials = [f"{f}_{s}" for f in own for s in derivative_suffixes(dims, max_derivative)]
        texts = [t for m in ["", *monomials(own, degree)] for t in ([m or "1"] + ([f"{m}*{d}" if m else d for d in partials] if m.count("*") + bool(m) <= most else []))]
        names = names or derivative_symbols(variables, dims, max_derivative)
    elif trig:
        texts += [f"{f}({v})" for v in own for f in ("sin", "cos")]
    names = list(names or [*variables, "t"])
    gone = {parse(t, names) for t in exclude}
    out: dict[str, Expr] = {}
    seen: set[Expr] = set()
    for text in [*texts, *custom]:
        e = parse(text, names)
        if e not in seen and e not in gone:
            seen.add(e)
            out[text] = e
    return out


def columns(library: dict[str, Expr], named: dict[str, Column] | None = None) -> dict[str, Column]:
    return {t: e.column(named) for t, e in library.items()}


def split_rows(df: DataFrame, key: str = "traj", step: str = "step", share: float = 0.75) -> tuple[DataFrame, Column]:
    """df and a column that is true on validation rows: the last trajectory, or the last quarter of the steps if there is only one."""
    ends = df.agg(F.min(key).alias("a"), F.max(key).alias("b"), F.max(step).alias("s"), F.min(step).alias("r")).first()
    if ends["a"] != ends["b"]:
        return df, F.col(key) == F.lit(ends["b"])
    return df, F.col(step) >= F.lit(ends["r"] + share * ((ends["s"] or 0) - (ends["r"] or 0) + 1))


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """The n rows of smallest hash of their keys: the same rows whatever the partitioning. For parity with row caps only."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)
