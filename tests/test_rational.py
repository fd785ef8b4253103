"""Rational normal form against numbers, and equivalence of quotients without them."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fluxion.functions import rational as R
from fluxion.functions.expressions import equivalent, parse

NAMES = ["a", "b", "c", "x", "y"]


@pytest.mark.parametrize(
    "a,b",
    [
        ("a/(b + c)", "1/(b/a + c/a)"),
        ("a/(b + c) + b/(b + c)", "(a + b)/(b + c)"),
        ("(x**2 - y**2)/(x + y)", "x - y"),
        ("1/x + 1/y", "(x + y)/(x*y)"),
        ("x/(1 + x)", "1 - 1/(1 + x)"),
        ("1/(1 + 1/(1 + 1/x))", "(x + 1)/(2*x + 1)"),
        ("a*x/(b + x) - a*x**2/(b*x + x**2)", "0"),
        ("sin(x/(x*y))/(b + c)", "1/(b/sin(1/y) + c/sin(1/y))"),
        ("sqrt(x + y)/(x + y)", "(x + y)**(-0.5)"),
        ("(x**3 + y**3)/(x + y)**2", "(x**2 - x*y + y**2)/(x + y)"),
        ("(sin(x)*exp(y) + a*sin(x))/(exp(y) + a)", "sin(x)"),
        ("1/(x*y + x) + 1/(y + 1)", "(1 + x)/(x*(y + 1))"),
    ],
)
def test_equal_quotients(a, b, monkeypatch):
    monkeypatch.setattr(np.random, "default_rng", None)  # no numbers are drawn
    assert equivalent(a, b, NAMES) == "equal"


def test_near_and_different_quotients(monkeypatch):
    monkeypatch.setattr(np.random, "default_rng", None)
    assert equivalent("a/(b + c)", "1.02*a/(b + 0.99*c)", NAMES) == "close"
    assert equivalent("a/(b + c)", "1.3*a/(b + c)", NAMES) == "different"


def test_other_terms_are_decided_by_numbers():
    assert equivalent("a/(b + c)", "a/(b + c + x)", NAMES) == "different"
    assert equivalent("x", "x + 1e-4*y", NAMES) == "undecided"


def test_too_large_has_no_normal_form():
    long = "+".join(f"x**{i}*y**{j}" for i in range(1, 11) for j in range(1, 11))
    with pytest.raises(R.TooLarge):
        R.fraction(parse(f"1/({long}) + 1/({long} + 1)")).bottom()
    assert equivalent(f"1/({long}) + 1/({long} + a)", f"1/({long} + a) + 1/({long})", NAMES) == "equal"


def test_division_is_exact():
    p, q = parse("x**2 + 2*x*y + y**2"), parse("x + y")
    assert R.divided(p, q) == q and R.divided(p + parse("1"), q) is None
    assert R.divided(parse("0"), q) == parse("0")


leaf = st.sampled_from(["x", "y", "a", "2", "3", "0.5"])
tree = st.recursive(leaf, lambda t: st.tuples(t, st.sampled_from("+-*/"), t).map(lambda p: f"({p[0]} {p[1]} {p[2]})"), max_leaves=7)


@settings(max_examples=150, deadline=None)
@given(tree)
def test_normal_form_has_the_same_values(text):
    values = {n: np.random.default_rng(3).uniform(0.3, 2.0, 64) + k / 7 for k, n in enumerate(NAMES)}
    e = parse(text)
    try:
        f = R.fraction(e)
    except (ZeroDivisionError, R.TooLarge):
        return
    got = np.broadcast_to(f.top.numpy()(values), 64) / np.broadcast_to(f.bottom().numpy()(values), 64)
    want = np.broadcast_to(e.numpy()(values), 64)
    ok = np.isfinite(want) & np.isfinite(got) & (np.abs(want) < 1e4)
    assert np.allclose(got[ok], want[ok], rtol=1e-5, atol=1e-5)


def test_pairs_in_columns(spark):
    from fluxion.operators.datasets import judged

    rows = [("a/(b + c)", "1/(b/a + c/a)"), (None, "a"), ("a +", "a"), ("", "0"), ("q", "a")]
    got = judged(spark.createDataFrame(rows, "a string, b string"), NAMES).select("verdict").collect()
    assert [r[0] for r in got] == ["equal", "unreadable", "unreadable", "equal", "unreadable"]
    assert judged(spark.createDataFrame([], "a string, b string"), NAMES).count() == 0


def test_equal_pairs_are_judged_once():
    import pandas as pd

    from fluxion.operators.datasets import each_once

    calls = []
    one = lambda a, b: calls.append((a, b)) or f"{a}{b}"
    batches = [(pd.Series(["x", None, "x"]), pd.Series(["y", "y", "y"])), (pd.Series([None, "y", "x"]), pd.Series(["y", "x", "y"]))]
    assert [list(s) for s in each_once(one, iter(batches))] == [["xy", "Noney", "xy"], ["Noney", "yx", "xy"]] and len(calls) == 3
    assert [list(s) for s in each_once(one, iter(batches), 1)] == [["xy", "Noney", "xy"], ["Noney", "yx", "xy"]]
