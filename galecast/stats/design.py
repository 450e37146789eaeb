"""Model formulas and the model matrix as Column expressions (M1).

A formula such as ``y ~ a + f + a:f + I(a^2) + offset(log(n)) - 1`` names the
response and its terms: ``+`` adds a term, ``:`` multiplies variables, ``a * b``
is ``a + b + a:b``, ``I(...)`` is arithmetic (an SQL expression, with ``^`` as the
power), ``offset(...)`` enters with coefficient 1, and ``- 1`` or ``+ 0`` drops the
intercept.  Terms of fewer variables come first.

Text and boolean columns are factors.  A factor is coded against its
alphabetically first level where the term without it is in the model too, and
with all its levels elsewhere (without an intercept, the first factor that
stands alone), which is the coding the reference's models have (midwest is the
reference region); columns are named ``variable + level`` (``regionnortheast``)
and joined by ``:`` in products.

Columns with a numeric part are centred (where there is an intercept to take
the shift up) and scaled inside the expressions, which keeps the weighted Gram
matrix well conditioned; the coefficients are mapped back to the original units
afterwards.  Rows with a null in any variable are dropped before fitting, as the
reference's fitting function does.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from operator import mul

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels that a factor may have: each is a column of the model.
MAX_LEVELS = 1000


@dataclass(frozen=True)
class Formula:
    """``terms`` are the variables of each term, main effects first; a variable is a column or an ``I(...)`` text."""

    response: str
    terms: tuple[tuple[str, ...], ...]
    intercept: bool = True
    offsets: tuple[str, ...] = ()

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for t in self.terms for v in t))

    def inputs(self) -> list[Column]:
        """The response and every variable and offset, each as a column of its own name."""
        return [expression(v).alias(v) for v in dict.fromkeys([self.response, *self.variables, *self.offsets])]


def expression(variable: str) -> Column:
    """A column, or the SQL expression inside ``I(...)`` / ``offset(...)``."""
    inside = re.fullmatch(r"(?:I|offset)\((.*)\)", variable, re.S)
    if not inside:
        return F.col(f"`{variable}`")
    power = re.compile(r"(\w+(?:\([^()]*\))?|\([^()]*\))\s*\^\s*(\w+|\([^()]*\))")
    text = inside[1]
    while power.search(text):
        text = power.sub(r"power(\1, \2)", text)
    return F.expr(text)


def _split(text: str, marks: str) -> list[tuple[str, str]]:
    """``(mark before, piece)`` of a text cut at ``marks`` outside parentheses and backquotes."""
    out, depth, quoted, piece, before = [], 0, False, "", "+"
    for ch in text:
        if ch == "`":
            quoted = not quoted
        elif not quoted:
            depth += (ch == "(") - (ch == ")")
            if depth < 0:
                raise ValueError(f"unbalanced parentheses in {text!r}")
            if depth == 0 and ch in marks:
                if piece.strip() or out:
                    out.append((before, piece.strip()))
                before, piece = ch, ""
                continue
        piece += ch
    if depth or quoted:
        raise ValueError(f"unbalanced parentheses or quotes in {text!r}")
    return [*out, (before, piece.strip())]


def _variable(text: str) -> str:
    if re.fullmatch(r"`[^`]+`", text):
        return text[1:-1]
    if re.fullmatch(r"[A-Za-z_.][\w.]*", text):
        return text
    if re.fullmatch(r"I\(.+\)", text, re.S):
        return text
    if re.fullmatch(r"[A-Za-z_]\w*\(.+\)", text, re.S):  # a function of columns, such as log(x)
        return f"I({text})"
    raise ValueError(f"not a variable: {text!r}")


def parse_formula(text: str) -> Formula:
    """The formula that ``text`` states."""
    left, tilde, right = text.partition("~")
    if not tilde or not left.strip():
        raise ValueError(f"a formula needs a response and ~: {text!r}")
    terms: dict[frozenset[str], tuple[str, ...]] = {}
    intercept, offsets = True, []
    for sign, piece in _split(right, "+-"):
        if piece in ("0", "1"):
            intercept = (piece == "1") == (sign == "+")
            continue
        if re.fullmatch(r"offset\(.+\)", piece, re.S):
            if sign == "-":
                raise ValueError(f"an offset can't be taken out: {piece!r}")
            offsets.append(piece)
            continue
        crossed = [tuple(dict.fromkeys(_variable(v) for _, v in _split(side, ":"))) for _, side in _split(piece, "*")]
        for kept in product((True, False), repeat=len(crossed)):
            found = tuple(dict.fromkeys(v for side, k in zip(crossed, kept, strict=True) if k for v in side))
            if found and sign == "+":
                terms.setdefault(frozenset(found), found)
            elif found:
                terms.pop(frozenset(found), None)
    order = sorted(terms.values(), key=len)
    return Formula(_variable(left.strip()), tuple(order), intercept, tuple(offsets))


def as_formula(formula: Formula | str) -> Formula:
    return parse_formula(formula) if isinstance(formula, str) else formula


def plain_formula(response: str, terms: Sequence[str]) -> Formula:
    """A response and main effects, by column names."""
    return Formula(response, tuple((t,) for t in terms))


@dataclass
class Design:
    formula: Formula
    levels: dict[str, list[str]]
    names: list[str] = field(default_factory=list)          # coefficient names, intercept first
    parts: list[tuple[tuple[str, str | None], ...]] = field(default_factory=list)  # (variable, level or None) of each
    centre: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)

    @property
    def p(self) -> int:
        return len(self.names)

    @property
    def response(self) -> str:
        return self.formula.response

    def raw_columns(self) -> list[Column]:
        """The columns of the model in original units."""
        def one(variable: str, level: str | None) -> Column:
            value = F.col(f"`{variable}`")
            if level is None:
                return value.cast("double")
            return F.when(value.cast("string") == level, F.lit(1.0)).otherwise(F.lit(0.0))
        return [reduce(mul, (one(*x) for x in part)) if part else F.lit(1.0) for part in self.parts]

    def columns(self) -> list[Column]:
        """Scaled regressors ``x_0 .. x_{p-1}``."""
        return [c if (m, s) == (0.0, 1.0) else (c - F.lit(m)) / F.lit(s)
                for c, m, s in zip(self.raw_columns(), self.centre, self.scale, strict=True)]

    def offset(self) -> Column:
        return reduce(lambda a, b: a + b, (F.col(f"`{o}`").cast("double") for o in self.formula.offsets), F.lit(0.0))

    def to_original(self) -> np.ndarray:
        """Matrix T with beta_original = T @ beta_scaled."""
        T_ = np.diag(1.0 / np.array(self.scale))
        if self.formula.intercept:
            T_[0, 1:] = -np.array(self.centre[1:]) / np.array(self.scale[1:])
        return T_


def complete_rows(df: DataFrame, formula: Formula, keep: Sequence[str] = ()) -> DataFrame:
    """The formula's inputs (and the columns ``keep``) of the rows that have all of them."""
    inputs = formula.inputs()
    named = [formula.response, *formula.variables, *formula.offsets]
    return df.select(*inputs, *[c for c in keep if c not in named]).dropna(how="any", subset=[f"`{v}`" for v in named])


def factors_of(df: DataFrame, formula: Formula) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [v for v in formula.variables if isinstance(kinds[v], (T.StringType, T.BooleanType))]


def _coded_in_full(formula: Formula, factors: Sequence[str]) -> set[tuple[tuple[str, ...], str]]:
    """``(term, factor)`` where all levels of the factor are coded."""
    have = {frozenset(t) for t in formula.terms} | {frozenset()}
    full = {(t, v) for t in formula.terms for v in t if v in factors and frozenset(t) - {v} not in have}
    if not formula.intercept:
        full |= {(t, t[0]) for t in [t for t in formula.terms if len(t) == 1 and t[0] in factors][:1]}
    return full


def build_design(df: DataFrame, formula: Formula, factors: Sequence[str] | None = None,
                 levels: Mapping[str, list[str]] | None = None) -> Design:
    """Resolve levels and scaling constants with one small aggregate.

    ``df`` must hold the formula's inputs (``complete_rows``).  Levels not given are read
    with a distinct query (bounded by the factor's cardinality).
    """
    levels = dict(levels or {})
    factors = factors_of(df, formula) if factors is None else [f for f in factors if f in formula.variables]
    for f in factors:
        if f not in levels:
            found = df.select(F.col(f"`{f}`").cast("string").alias("level")).distinct().limit(MAX_LEVELS + 1).collect()
            if len(found) > MAX_LEVELS:
                raise ValueError(f"factor {f} has more than {MAX_LEVELS} levels")
            levels[f] = sorted(r["level"] for r in found)
    d = Design(formula, {f: levels[f] for f in factors})
    if formula.intercept:
        d.names.append("(Intercept)")
        d.parts.append(())
    full = _coded_in_full(formula, factors)
    for term in formula.terms:
        choices = [[(v, level) for level in d.levels[v][0 if (term, v) in full else 1:]] if v in d.levels else [(v, None)]
                   for v in term]
        # The first variable's levels run fastest.
        for picked in product(*reversed(choices)):
            part = tuple(reversed(picked))
            d.parts.append(part)
            d.names.append(":".join(v + (level or "") for v, level in part))
    d.centre, d.scale = [0.0] * d.p, [1.0] * d.p
    aggs = []
    numeric = [k for k, part in enumerate(d.parts) if any(level is None for _, level in part)]
    raw = d.raw_columns()
    for k in numeric:
        aggs += [F.avg(raw[k]).alias(f"m{k}"), F.stddev_pop(raw[k]).alias(f"s{k}"), F.avg(raw[k] * raw[k]).alias(f"q{k}")]
    if aggs:
        row = df.agg(*aggs).first()
        for k in numeric:
            if formula.intercept:
                d.centre[k] = float(row[f"m{k}"] or 0.0)
                d.scale[k] = float(row[f"s{k}"] or 1.0)
            else:
                d.scale[k] = float(row[f"q{k}"] or 1.0) ** 0.5
    return d
