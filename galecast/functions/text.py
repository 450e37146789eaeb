"""Label helpers that reproduce the reference's text rules as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c)


def r_round(c, digits: int = 0) -> Column:
    """``round(x, digits)``: half to even, like the reference's rounding."""
    return F.bround(_col(c), digits)


def num_text(c) -> Column:
    """Number as the reference prints it: ``53.0`` becomes ``53``."""
    return F.regexp_replace(_col(c).cast("string"), r"\.0$", "")


def str_c(*parts) -> Column:
    """Null-propagating concatenation (any null part gives null).

    Plain strings are literals; Columns are used as they are.
    """
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def paste(*parts, sep: str = " ") -> Column:
    """Concatenation that writes the text ``NA`` for a missing part."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("NA"))
            for p in parts]
    return F.concat_ws(sep, *cols)


_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_NON_ALNUM = re.compile(r"[^0-9a-zA-Z]+")


def snake_name(name: str) -> str:
    """Column name to snake_case, the way the reference cleans names.

    ``%`` and ``#`` become words, camelCase is split, every other run of
    symbols becomes one ``_``, and a name that starts with a digit gets ``x``.
    """
    s = name.replace("'", "").replace('"', "")
    s = s.replace("%", "_percent_").replace("#", "_number_")
    s = _CAMEL.sub(r"\1_\2", s)
    s = _NON_ALNUM.sub("_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_names(columns: list[str]) -> list[str]:
    """Snake-case a list of names; repeated names get ``_2``, ``_3``..."""
    seen: dict[str, int] = {}
    out = []
    for c in columns:
        base = snake_name(c)
        k = seen.get(base, 0) + 1
        seen[base] = k
        out.append(base if k == 1 else f"{base}_{k}")
    return out
