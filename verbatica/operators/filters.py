"""Filter algebra: nested dictionaries of conditions as one predicate for Catalyst to push down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


class UnsupportedFilterError(ValueError):
    """A filter that names an unknown operator or has the wrong form."""


_COMPARE = {
    "$eq": lambda c, v: c.isNull() if v is None else c == v,
    "$ne": lambda c, v: c.isNotNull() if v is None else c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)) if v else F.lit(False),
    "$nin": lambda c, v: ~c.isin(list(v)) if v else F.lit(True),
    "$contains": lambda c, v: c.contains(v),
}


def field_filter(name: str, condition: object) -> Column:
    """A value, or a dictionary with exactly one operator. $contains is literal: % and _ have no meaning."""
    if not isinstance(condition, dict):
        return _COMPARE["$eq"](F.col(name), condition)
    if len(condition) != 1:
        raise UnsupportedFilterError(f"{name}: one operator is needed, not {len(condition)}")
    (op, value), = condition.items()
    if op not in _COMPARE:
        raise UnsupportedFilterError(f"unknown operator {op}")
    return _COMPARE[op](F.col(name), value)


def where(condition: dict | None) -> Column:
    """Keys are joined by AND; $and and $or hold lists of conditions; nothing at all is true."""
    terms = []
    for key, value in (condition or {}).items():
        if key in ("$and", "$or"):
            if not isinstance(value, (list, tuple)) or not value:
                raise UnsupportedFilterError(f"{key} needs a list of conditions")
            terms.append(reduce(lambda a, b: (a & b) if key == "$and" else (a | b), map(where, value)))
        elif key.startswith("$"):
            raise UnsupportedFilterError(f"unknown operator {key}")
        else:
            terms.append(field_filter(key, value))
    return reduce(lambda a, b: a & b, terms, F.lit(True)) if terms else F.lit(True)


def where_text(condition: dict | None, column: str = "text") -> Column:
    """$contains and $not_contains on the text."""
    terms = []
    for op, value in (condition or {}).items():
        if op not in ("$contains", "$not_contains"):
            raise UnsupportedFilterError(f"unknown operator {op}")
        held = F.col(column).contains(value)
        terms.append(held if op == "$contains" else ~held)
    return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)


def scope(wing: str | None = None, room: str | None = None) -> Column:
    return where({k: v for k, v in (("wing", wing), ("room", room)) if v})
