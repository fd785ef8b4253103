"""Expressions: one small algebra with three back ends (Spark columns, NumPy, SQL text).

Text is read through Python's `ast` with a white list; nothing is ever evaluated as Python. An expression is kept expanded, as a
sum of monomials: {monomial: coefficient}, a monomial being a sorted tuple of (atom, exponent). Atoms are symbols, function
calls and sums raised to powers that don't expand. So equality after expansion, term lists and coefficients need no more work.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: name -> (NumPy, Spark, SQL template, derivative of the function at `{}`)
FUNCTIONS: dict[str, tuple[Callable, Callable, str, str | None]] = {
    "sin": (np.sin, F.sin, "sin({})", "cos({})"),
    "cos": (np.cos, F.cos, "cos({})", "-sin({})"),
    "tan": (np.tan, F.tan, "tan({})", "1 + tan({})**2"),
    "cot": (lambda x: 1 / np.tan(x), F.cot, "cot({})", "-1 - cot({})**2"),
    "exp": (np.exp, F.exp, "exp({})", "exp({})"),
    "log": (np.log, F.ln, "ln({})", "1/({})"),
    "sqrt": (np.sqrt, F.sqrt, "sqrt({})", "1/(2*sqrt({}))"),
    "sinh": (np.sinh, F.sinh, "sinh({})", "cosh({})"),
    "cosh": (np.cosh, F.cosh, "cosh({})", "sinh({})"),
    "tanh": (np.tanh, F.tanh, "tanh({})", "1 - tanh({})**2"),
    "asin": (np.arcsin, F.asin, "asin({})", "1/sqrt(1 - ({})**2)"),
    "acos": (np.arccos, F.acos, "acos({})", "-1/sqrt(1 - ({})**2)"),
    "atan": (np.arctan, F.atan, "atan({})", "1/(1 + ({})**2)"),
    "abs": (np.abs, F.abs, "abs({})", "sign({})"),
    "sign": (np.sign, F.signum, "sign({})", None),
}
BINARY: dict[str, tuple[Callable, Callable, str]] = {
    "atan2": (np.arctan2, F.atan2, "atan2({}, {})"),
    "Max": (np.maximum, F.greatest, "greatest({}, {})"),
    "Min": (np.minimum, F.least, "least({}, {})"),
}
CONSTANTS = {"pi": math.pi, "E": math.e}


class ExpressionError(ValueError):
    """The text is no expression of the white list."""


@dataclass(frozen=True)
class Symbol:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    arguments: tuple[Expr, ...]


@dataclass(frozen=True)
class Group:
    """A sum that stays together under an exponent that is negative or no whole number."""

    inner: Expr


Atom = Symbol | Call | Group
Monomial = tuple[tuple[Atom, float], ...]


def _order(atom: Atom) -> tuple:
    return (0, atom.name) if isinstance(atom, Symbol) else (1, str(Expr({((atom, 1.0),): 1.0})))


class Expr:
    __slots__ = ("__dict__", "terms")

    def __init__(self, terms: Mapping[Monomial, float]):
        self.terms = {m: c for m, c in terms.items() if c != 0}

    # -- algebra

    def __add__(self, other: Expr) -> Expr:
        out = dict(self.terms)
        for m, c in other.terms.items():
            out[m] = out.get(m, 0.0) + c
        return Expr(out)

    def __neg__(self) -> Expr:
        return self.scaled(-1.0)

    def __sub__(self, other: Expr) -> Expr:
        return self + -other

    def scaled(self, by: float) -> Expr:
        return Expr({m: c * by for m, c in self.terms.items()})

    def __mul__(self, other: Expr) -> Expr:
        out: dict[Monomial, float] = {}
        for m, c in self.terms.items():
            for n, d in other.terms.items():
                key, factor = _times(m, n)
                out[key] = out.get(key, 0.0) + c * d * factor
        return Expr(out)

    def power(self, n: float) -> Expr:
        if n == 0:
            return number(1.0)
        if self.constant is not None:
            try:
                value = self.constant**n
            except (ZeroDivisionError, OverflowError):
                value = math.inf
            return number(value if isinstance(value, float) else math.nan)
        if n == int(n) and 0 < n <= 12:
            out = self
            for _ in range(int(n) - 1):
                out = out * self
            return out
        if len(self.terms) == 1:
            ((m, c),) = self.terms.items()
            if n == int(n) or (c > 0 and all(e == 1 and len(m) == 1 for _, e in m)):
                return Expr({tuple((a, e * n) for a, e in m): c**n})
        return Expr({((Group(self), float(n)),): 1.0})

    # -- facts

    @cached_property
    def constant(self) -> float | None:
        if not self.terms:
            return 0.0
        return self.terms[()] if len(self.terms) == 1 and () in self.terms else None

    @cached_property
    def symbols(self) -> frozenset[str]:
        out: set[str] = set()
        for m in self.terms:
            for a, _ in m:
                out |= {a.name} if isinstance(a, Symbol) else a.inner.symbols if isinstance(a, Group) else frozenset().union(*(x.symbols for x in a.arguments))
        return frozenset(out)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Expr) and self.terms == other.terms

    def __hash__(self) -> int:
        return hash(frozenset(self.terms.items()))

    def coefficients(self) -> dict[str, float]:
        """Text of each monomial -> coefficient."""
        return {_monomial_text(m): c for m, c in self.terms.items()}

    # -- calculus

    def diff(self, name: str) -> Expr:
        out = Expr({})
        for m, c in self.terms.items():
            for k, (a, e) in enumerate(m):
                inner = _atom_diff(a, name)
                if inner.terms:
                    rest = Expr({m[:k] + m[k + 1 :]: c * e})
                    out = out + rest * (Expr({((a, e - 1),): 1.0}) if e != 1 else number(1.0)) * inner
        return out

    def subs(self, values: Mapping[str, Expr | float]) -> Expr:
        if not self.symbols & values.keys():
            return self
        out = Expr({})
        for m, c in self.terms.items():
            part = number(c)
            for a, e in m:
                part = part * _atom_subs(a, values).power(e)
            out = out + part
        return out

    # -- back ends

    def column(self, columns: Mapping[str, Column] | None = None) -> Column:
        """A column of doubles; what isn't finite or defined is null."""
        named = columns or {}
        return _build(self, lambda s: named.get(s, F.col(s)), lambda f, a: (FUNCTIONS.get(f) or BINARY[f])[1](*a), lambda x: F.lit(float(x)), _column_power)

    def numpy(self) -> Callable[[Mapping[str, np.ndarray]], np.ndarray]:
        def run(values: Mapping[str, np.ndarray]) -> np.ndarray:
            with np.errstate(all="ignore"):
                return _build(self, lambda s: values[s], lambda f, a: (FUNCTIONS.get(f) or BINARY[f])[0](*a), float, lambda b, e: b**int(e) if e == int(e) else b**e)

        return run

    def sql(self) -> str:
        return _build(
            self, lambda s: _Sql(f'"{s}"'), lambda f, a: _Sql((FUNCTIONS.get(f) or BINARY[f])[2].format(*a)), lambda x: _Sql(f"CAST({float(x)!r} AS DOUBLE)"),
            lambda b, e: _Sql("*".join([f"({b})"] * int(e))) if e in (1, 2, 3, 4) else _Sql(f"pow({b}, {e!r})"),
        )

    def text(self, digits: int = 17) -> str:
        if not self.terms:
            return "0"
        out = ""
        for m, c in sorted(self.terms.items(), key=lambda t: (-sum(e for _, e in t[0]), _monomial_text(t[0]))):
            size = f"{abs(c):.{digits}g}"
            body = _monomial_text(m)
            part = size if not m else body if size == "1" else f"{size}*{body}"
            out += (" - " if c < 0 else " + ") + part if out else ("-" if c < 0 else "") + part
        return out

    __str__ = text

    def __repr__(self) -> str:
        return f"Expr({self.text(6)})"


class _Sql(str):
    """SQL text with the operators that _build uses."""

    def __add__(self, other):
        return _Sql(f"({str(self)} + {str(other)})")

    def __mul__(self, other):
        return _Sql(f"({str(self)} * {str(other)})")


def _build(e: Expr, symbol, call, literal, power):
    total = None
    for m, c in sorted(e.terms.items(), key=lambda t: _monomial_text(t[0])):
        part = literal(c)
        for a, n in m:
            if isinstance(a, Symbol):
                base = symbol(a.name)
            elif isinstance(a, Group):
                base = _build(a.inner, symbol, call, literal, power)
            else:
                base = call(a.name, [_build(x, symbol, call, literal, power) for x in a.arguments])
            part = part * (base if n == 1 else power(base, n))
        total = part if total is None else total + part
    return literal(0.0) if total is None else total


def _column_power(base: Column, n: float) -> Column:
    if n in (2, 3, 4):
        out = base
        for _ in range(int(n) - 1):
            out = out * base
        return out
    if n < 0:
        return F.try_divide(F.lit(1.0), _column_power(base, -n) if n != -1 else base)
    return F.when((base >= 0) | F.lit(n == int(n)), F.pow(base, F.lit(float(n))))


def _times(a: Monomial, b: Monomial) -> tuple[Monomial, float]:
    if not a or not b:
        return a or b, 1.0
    powers = dict(a)
    for atom, e in b:
        powers[atom] = powers.get(atom, 0.0) + e
    return tuple(sorted(((x, e) for x, e in powers.items() if e != 0), key=lambda p: _order(p[0]))), 1.0


def _atom_diff(a: Atom, name: str) -> Expr:
    if isinstance(a, Symbol):
        return number(1.0) if a.name == name else Expr({})
    if isinstance(a, Group):
        return a.inner.diff(name)
    if not any(name in x.symbols for x in a.arguments):
        return Expr({})
    if a.name == "atan2":
        y, x = a.arguments
        r = (x * x + y * y).power(-1)
        return (x * y.diff(name) - y * x.diff(name)) * r
    rule = FUNCTIONS[a.name][3] if a.name in FUNCTIONS else None
    if rule is None:
        raise ExpressionError(f"{a.name} has no derivative here")
    inner = a.arguments[0]
    return parse(rule.replace("{}", "_")).subs({"_": inner}) * inner.diff(name)


def _atom_subs(a: Atom, values: Mapping[str, Expr | float]) -> Expr:
    if isinstance(a, Symbol):
        v = values.get(a.name)
        return Expr({((a, 1.0),): 1.0}) if v is None else v if isinstance(v, Expr) else number(float(v))
    if isinstance(a, Group):
        return a.inner.subs(values)
    return call(a.name, [x.subs(values) for x in a.arguments])


def _monomial_text(m: Monomial) -> str:
    return "*".join(_power_text(a, e) for a, e in m) or "1"


def _power_text(a: Atom, e: float) -> str:
    base = a.name if isinstance(a, Symbol) else f"({a.inner.text()})" if isinstance(a, Group) else f"{a.name}({', '.join(x.text() for x in a.arguments)})"
    return base if e == 1 else f"{base}**{int(e)}" if e == int(e) and e > 0 else f"{base}**({int(e) if e == int(e) else e!r})"


def number(x: float) -> Expr:
    return Expr({(): float(x)} if x else {})


def symbol(name: str) -> Expr:
    return Expr({((Symbol(name), 1.0),): 1.0})


def call(name: str, arguments: list[Expr]) -> Expr:
    if all(x.constant is not None for x in arguments):
        with np.errstate(all="ignore"):
            return number(float((FUNCTIONS.get(name) or BINARY[name])[0](*[x.constant for x in arguments])))
    if name == "sqrt":
        return arguments[0].power(0.5)
    return Expr({((Call(name, tuple(arguments)), 1.0),): 1.0})


def parse(text: str, names: Iterable[str] | None = None) -> Expr:
    """Reads an expression. names: symbols allowed; they win over functions and constants of the same name."""
    own = None if names is None else frozenset(names)
    try:
        tree = ast.parse(str(text).replace("^", "**").strip() or "0", mode="eval").body
    except (SyntaxError, ValueError, RecursionError) as e:
        raise ExpressionError(f"can't read {text!r}: {e}") from None
    return _read(tree, own)


def _read(node: ast.AST, names: frozenset[str] | None) -> Expr:
    match node:
        case ast.Constant(value=int() | float() as v) if not isinstance(v, bool):
            return number(float(v))
        case ast.Name(id=name):
            if names is not None and name in names:
                return symbol(name)
            if name in CONSTANTS:
                return number(CONSTANTS[name])
            if names is not None:
                raise ExpressionError(f"unknown symbol {name!r}; allowed: {', '.join(sorted(names))}")
            return symbol(name)
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_read(x, names)
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return _read(x, names)
        case ast.BinOp(left=a, op=op, right=b):
            x, y = _read(a, names), _read(b, names)
            match op:
                case ast.Add():
                    return x + y
                case ast.Sub():
                    return x - y
                case ast.Mult():
                    return x * y
                case ast.Div():
                    return x * y.power(-1.0)
                case ast.Pow():
                    if y.constant is not None:
                        return x.power(y.constant)
                    return call("exp", [y * call("log", [x])])
            raise ExpressionError(f"operator {type(op).__name__} isn't allowed")
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
            own = {"ln": "log", "Abs": "abs", "arctan": "atan", "max": "Max", "min": "Min"}.get(name, name)
            if own in FUNCTIONS and len(args) == 1 or own in BINARY and len(args) == 2:
                return call(own, [_read(a, names) for a in args])
            raise ExpressionError(f"unknown function {name!r} of {len(args)} arguments")
    raise ExpressionError(f"{type(node).__name__} isn't allowed")


def linear_combination(coefficients: Iterable[float], terms: Iterable[str], digits: int = 5) -> str:
    """Text of a model from coefficients and term texts: zeros dropped, `0` if nothing is left."""
    parts = [(float(f"{c:.{digits}g}"), t) for c, t in zip(coefficients, terms, strict=True) if c]
    out = ""
    for c, t in parts:
        body = f"{abs(c):.{digits}g}" if t == "1" else f"{abs(c):.{digits}g}*{t}"
        out += (" - " if c < 0 else " + ") + body if out else ("-" if c < 0 else "") + body
    return out or "0"


def structure_metrics(found: Mapping[str, str], truth: Mapping[str, str], names: Iterable[str]) -> dict[str, float]:
    """Precision, recall and F1 of the terms of a model, and the mean relative error of coefficients of terms found."""
    names = list(names)
    a = {(v, t): c for v, e in found.items() for t, c in parse(e, names).coefficients().items()}
    b = {(v, t): c for v, e in truth.items() for t, c in parse(e, names).coefficients().items()}
    both = a.keys() & b.keys()
    p, r = len(both) / max(1, len(a)), len(both) / max(1, len(b))
    errors = [abs(a[k] - b[k]) / max(abs(b[k]), 1e-12) for k in both]
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if both else 0.0, "coef_rel_err": float(np.mean(errors)) if errors else math.nan}


def equivalent(a: str, b: str, names: Iterable[str], tolerance: float = 0.05, seed: int = 0) -> str:
    """`equal`, `close` (same terms, coefficients within tolerance), `different` or `undecided` (numerically alike, other form).

    Quotients are compared in rational normal form; numbers are drawn only where forms have other terms or are too large.
    """
    from .rational import TooLarge, near, same

    names = list(names)
    x, y = parse(a, names), parse(b, names)
    if x == y:
        return "equal"
    if x.terms.keys() == y.terms.keys() and not any(isinstance(atom, Group) for m in x.terms for atom, _ in m):
        return "close" if all(abs(c - y.terms[m]) <= tolerance * max(abs(y.terms[m]), 1e-12) for m, c in x.terms.items()) else "different"
    try:
        if same(x, y):
            return "equal"
        alike = near(x, y, tolerance)
        if alike is not None:
            return "close" if alike else "different"
    except (TooLarge, ZeroDivisionError, OverflowError):
        pass
    rng = np.random.default_rng(seed)
    values = {n: rng.uniform(0.3, 2.0, 256) for n in names}
    p, q = np.broadcast_to(x.numpy()(values), 256), np.broadcast_to(y.numpy()(values), 256)
    ok = np.isfinite(p) & np.isfinite(q)
    if not ok.any():
        return "undecided"
    error = np.abs(p - q)[ok].max() / (np.abs(q[ok]).max() + 1e-12)
    return "equal" if error < 1e-9 else "undecided" if error < tolerance else "different"


def split_parameters(models: Mapping[str, Expr], parameters: Iterable[str]) -> tuple[list[str], list[str]]:
    """Parameters in which all expressions are linear, and the rest; of two that multiply each other the later is demoted."""
    linear, other = [], []
    for p in parameters:
        curved = any(m.diff(p).diff(p).terms for m in models.values())
        mixed = any(m.diff(p).diff(q).terms for m in models.values() for q in linear)
        (other if curved or mixed else linear).append(p)
    return linear, other


def split_linear_part(e: Expr, field: str) -> tuple[dict[str, float], Expr]:
    """Constant coefficients of a field's own derivatives (and of the field), and the remainder."""
    own, rest = {}, {}
    for m, c in e.terms.items():
        name = m[0][0].name if len(m) == 1 and m[0][1] == 1 and isinstance(m[0][0], Symbol) else None
        if name is not None and (name == field or name.startswith(f"{field}_")):
            own[name] = c
        else:
            rest[m] = c
    return own, Expr(rest)
