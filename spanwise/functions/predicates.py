"""Predicates. A null operand never matches: it makes a predicate null, which a filter drops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def lt(a, b) -> Column:
    return _col(a) < _col(b)


def gt(a, b) -> Column:
    return lt(b, a)


def lte(a, b) -> Column:
    return _col(a) <= _col(b)


def gte(a, b) -> Column:
    return lte(b, a)


def eq(a, b) -> Column:
    return _col(a) == _col(b)


def between(a, lo, hi) -> Column:
    """Both ends belong to the range."""
    return _col(a).between(_col(lo), _col(hi))


def in_set(a, values) -> Column:
    """Whether a is one of the values; each value counts once, and no value fits the empty set."""
    chosen = list(dict.fromkeys(values))
    return _col(a).isin(chosen) if chosen else F.lit(False)


def all_of(*predicates: Column) -> Column:
    return reduce(Column.__and__, predicates, F.lit(True)) if predicates else F.lit(True)


def any_of(*predicates: Column) -> Column:
    return reduce(Column.__or__, predicates) if predicates else F.lit(False)


def negated(predicate: Column) -> Column:
    return ~predicate


def band(a, b, delta: int) -> Column:
    """abs(a - b) <= delta, written as a range so that it can be pushed down when b is a literal."""
    return _col(a).between(_col(b) - delta, _col(b) + delta)
