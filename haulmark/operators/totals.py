"""Exact totals, means and deviations of numbers of any magnitude.

A number is scaled by the power of two of its exponent class, 24 exponents wide, and cut into
three integers of at most 27 bits. Integers of a class are added as 64-bit sums, so nothing is
rounded, a retried task or another partitioning cannot change a digit, and neither a large nor a
small number is lost beside others. The class is part of the grouping key: a group has as
many rows of sums as it has classes, mostly one or two, so the sums are as sparse as the data.
They can be added up again over coarser keys without losing a digit.

What is left of a group is added from the largest class down in pairs of doubles. A total of
several numbers that differs from one with 4, 8 or 12 decimals by no more than its last bits
is that number: ten times 0.1 is 1. NaN and infinities count as missing. Below 1e-290 numbers
count with fewer digits; a deviation of 1e-10 of the mean is right to about 12 digits, and has
less the smaller it is. A group has room for 6e10 rows of one class, 2e10 where
its deviation is wanted; more is an overflow error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions.nulls import finite

_WIDTH, _LIMB = 24, 27
_LOWEST, _HIGHEST = -41, 42
_SUMS = ["_a", "_b", "_c"]
_SQUARES = [f"_q{k}" for k in range(6)]

# The steps below are SQL text, as each call that builds a column takes its time.

_CLASS = f"""CASE WHEN _x = 0 THEN 0 WHEN _x IS NOT NULL
    THEN greatest(least(CAST(floor(log2(abs(_x)) / {_WIDTH}) AS INT), {_HIGHEST}), {_LOWEST}) END"""
#: The common classes need no power.
_SCALED = f"""_x * CASE _class WHEN 0 THEN 1D WHEN -1 THEN {2**_WIDTH}D WHEN 1 THEN {2.0**-_WIDTH!r}D
    ELSE pow(2D, -{_WIDTH} * _class) END"""
_REST = f"(_y - CAST(_y AS BIGINT)) * {2**_LIMB}D"
_LIMBS = {
    "_a": "CAST(_y AS BIGINT)",
    "_b": f"CAST({_REST} AS BIGINT)",
    "_c": f"CAST(({_REST} - CAST({_REST} AS BIGINT)) * {2**_LIMB}D AS BIGINT)",
}


def exact_parts(
    df: DataFrame,
    by: Sequence[str],
    value: str | Column,
    spread: bool = False,
    counts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Integer sums of ``value`` for each ``by`` and exponent class.

    With ``spread`` the squares are summed too, which deviations need. ``counts`` are numbers of
    rows that meet a condition, taken in the same pass.
    """
    counts = counts or {}
    kept = [*map(_quoted, by), *map(_quoted, counts)]
    rows = df.select(*by, finite(value).alias("_x"), *[c.alias(name) for name, c in counts.items()])
    # later columns name earlier ones
    steps = {"_class": _CLASS, "_y": _SCALED, **_LIMBS}
    limbs = rows.selectExpr(*kept, "_x", *[f"{text} AS {name}" for name, text in steps.items()])
    sums = {name: f"sum({name})" for name in _SUMS}
    if spread:
        sums |= {name: f"sum({digit})" for name, digit in zip(_SQUARES, _square(), strict=True)}
    sums |= {"_rows": "count(1)", "_known": "count(_x)"} | {name: f"count_if({_quoted(name)})" for name in counts}
    return limbs.groupBy(*by, "_class").agg(*[_named(name, text) for name, text in sums.items()])


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _named(name: str, text: str) -> Column:
    return F.expr(f"{text} AS {_quoted(name)}")


def _square() -> list[str]:
    """Digits of 27 bits, the lowest first, of the square of a number's three integers."""
    terms = ["_c * _c", "2 * _b * _c", "_b * _b + 2 * _a * _c", "2 * _a * _b", "_a * _a"]
    low = [f"(({t}) & {(1 << _LIMB) - 1})" for t in terms]
    high = [f"shiftright({t}, {_LIMB})" for t in terms]
    return [low[0], *[f"{high[k]} + {low[k + 1]}" for k in range(4)], high[4]]


def add_parts(parts: DataFrame, by: Sequence[str], counts: Sequence[str] = ()) -> DataFrame:
    """The sums of ``exact_parts`` added up over coarser keys."""
    return parts.groupBy(*by, "_class").agg(*[c.alias(name) for name, c in part_sums(parts, counts).items()])


def part_sums(parts: DataFrame, counts: Sequence[str] = ()) -> dict[str, Column]:
    """Aggregates that add up what ``exact_parts`` made."""
    names = [n for n in [*_SUMS, *_SQUARES, "_rows", "_known"] if n in parts.columns]
    return {n: F.expr(f"sum({_quoted(n)})") for n in [*names, *counts]}


def exact_totals(parts: DataFrame, by: Sequence[str], counts: Sequence[str] = (), **outputs: Column) -> DataFrame:
    """One row for each ``by`` with the ``outputs``, such as ``total()`` or ``sd(2)``.

    ``counts`` are added up and can be used by name in the outputs.
    """
    spread = _SQUARES[0] in parts.columns
    sums = ", ".join([*_SUMS, *_SQUARES] if spread else _SUMS)
    found = {
        "_bins": f"sort_array(collect_list(CASE WHEN _a IS NOT NULL THEN struct(_class, {sums}) END), false)",
        "_top": "max(CASE WHEN _a IS NOT NULL THEN _class END)",
        "_rows": "sum(_rows)",
        "_known": "sum(_known)",
    }
    found |= {name: f"sum({_quoted(name)})" for name in counts}
    groups = parts.groupBy(*by).agg(*[_named(name, text) for name, text in found.items()])
    steps = _TOTAL | (_DEVIATION if spread else {})
    groups = groups.selectExpr("*", *[f"{text} AS {name}" for name, text in steps.items()])
    return groups.select(*by, *[c.alias(name) for name, c in outputs.items()])


def _added(sums: Sequence[str], power: int, places: Sequence[int]) -> str:
    """The sums of all classes in units of the top class, as a pair of doubles."""
    unit = f"pow(2D, {_WIDTH * power} * (b._class - _top))"
    high = [f"shiftright(b.{s}, 32) * ({unit} * {2.0 ** (p + 32)!r}D)" for s, p in zip(sums, places, strict=True)]
    low = [f"(b.{s} & {(1 << 32) - 1}) * ({unit} * {2.0**p!r}D)" for s, p in zip(sums, places, strict=True)]
    step = f"named_struct('h', acc.h + v, 'l', acc.l + {_error('acc.h', 'v')})"
    every = f"""aggregate(flatten(transform(_bins, b -> array({", ".join(high + low)}))),
        named_struct('h', 0D, 'l', 0D), (acc, v) -> {step})"""
    # mostly there is one class, with sums that are doubles themselves
    sorted_by_place = sorted(zip(sums, places, strict=True), key=lambda x: -x[1])
    terms = [f"(_bins[0].{s} * {2.0**p!r}D)" for s, p in sorted_by_place]
    total, errors = terms[0], []
    for term in terms[1:]:
        errors.append(_error(total, term))
        total = f"({total} + {term})"
    one = f"named_struct('h', {total}, 'l', {' + '.join(errors)})"
    return f"CASE WHEN size(_bins) = 1 AND _known < {1 << 25} THEN {one} ELSE {every} END"


def _error(x: str, y: str) -> str:
    """What the double nearest to ``x + y`` lacks."""
    total = f"({x} + {y})"
    return f"(({x} - ({total} - ({total} - {x}))) + ({y} - ({total} - {x})))"


def _decimal(c: str) -> str:
    """The number with 4, 8 or 12 decimals that ``c`` is but for its last bits, or ``c``."""
    fits = "".join(
        f" WHEN abs({c}) < {2.0**49 / 10**d!r}D AND abs(rint({c} * {10**d}D) / {10**d}D - {c}) <= abs({c}) * {2.0**-52!r}D"
        f" THEN rint({c} * {10**d}D) / {10**d}D"
        for d in (4, 8, 12)
    )
    return f"CASE{fits} ELSE {c} END"


def _high(x: str) -> str:
    """The upper half of a double's digits."""
    return f"({x} * 134217729D - ({x} * 134217729D - {x}))"


def _lost(x: str, x1: str, y: str, y1: str) -> str:
    """What the double nearest to ``x * y`` lacks, from the upper halves of both."""
    x2, y2 = f"({x} - {x1})", f"({y} - {y1})"
    return f"((({x1} * {y1} - {x} * {y}) + {x1} * {y2} + {x2} * {y1}) + {x2} * {y2})"


# Each step names those before it.
_TOTAL = {
    "_s": _added(_SUMS, 1, [0, -_LIMB, -2 * _LIMB]),
    "_scale": f"pow(2D, {_WIDTH} * _top)",
    "_sum": "(_s.h + _s.l) * _scale",
    "_total": f"CASE WHEN _known > 1 THEN {_decimal('_sum')} ELSE _sum END",
}
# Rows times squares less the square of the sum, all in units of the top class. What doubles
# cannot tell from no spread at all is none.
_DEVIATION = {
    "_q": _added(_SQUARES, 2, [_LIMB * (k - 4) for k in range(6)]),
    "_n": "CAST(_known AS DOUBLE)",
    "_sx": "_s.h + _s.l",
    "_qx": "_q.h + _q.l",
    "_sy": "_s.l - (_sx - _s.h)",
    "_qy": "_q.l - (_qx - _q.h)",
    **{f"{c}1": _high(c) for c in ("_sx", "_qx", "_n")},
    "_left": f"""(_n * _qx - _sx * _sx) + (({_lost("_n", "_n1", "_qx", "_qx1")} + _n * _qy)
        - ({_lost("_sx", "_sx1", "_sx", "_sx1")} + 2D * _sx * _sy))""",
    "_sd": f"""_scale * sqrt(CASE WHEN _left <= _n * _qx * {2.0**-98!r}D THEN 0D ELSE _left END
        / nullif(_n * (_n - 1), 0D))""",
}


def round_to_even(c: Column, digits: int) -> Column:
    """Rounded half to even, what is a tie but for the last bits of a double taken as one."""
    unit = F.lit(10.0**digits)
    half = F.floor(c * unit) + F.lit(0.5)
    tie = F.abs(c * unit - half) <= F.abs(c * unit) * F.lit(2.0**-49)
    rounded = F.rint(F.when(tie, half).otherwise(c * unit)) / unit
    return F.when(F.abs(c * unit) < 2.0**49, rounded).otherwise(c)


def _strictly(c: Column, strictly: bool) -> Column:
    return F.when(F.col("_rows") == F.col("_known"), c) if strictly else c


def total(strictly: bool = False) -> Column:
    """The sum; with ``strictly`` NULL as soon as one row is missing."""
    return _strictly(F.col("_total"), strictly)


def mean(digits: int | None = None, strictly: bool = False) -> Column:
    plain = F.col("_total") / F.nullif(F.col("_known"), F.lit(0))
    return _strictly(plain if digits is None else round_to_even(plain, digits), strictly)


def sd(digits: int | None = None, strictly: bool = False) -> Column:
    """Sample standard deviation, which parts with ``spread`` have; one row gives NULL."""
    return _strictly(F.col("_sd") if digits is None else round_to_even(F.col("_sd"), digits), strictly)


def rows() -> Column:
    """Rows of the group, those with a missing value included."""
    return F.col("_rows")


def exact_sums(df: DataFrame, by: Sequence[str], values: Mapping[str, Column], strictly: bool = False) -> DataFrame:
    """Several ``values`` added up in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), finite(c).alias("_value")) for name, c in values.items()]))
    rows = df.select(*by, each.alias("_each")).select(*by, "_each.*")
    sums = exact_total(rows, [*by, "_name"], "_value", "_value", strictly)
    return sums.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in values])


def exact_total(df: DataFrame, by: Sequence[str], value: str | Column, name: str, strictly: bool = False) -> DataFrame:
    """``value`` added up for each ``by``."""
    return exact_totals(exact_parts(df, by, value), by, **{name: total(strictly)})
