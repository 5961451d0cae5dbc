"""Filters on metadata, from nested dictionaries to one Column.

``{"source": "a.pdf", "page": {"$gte": 3}}`` means both; ``$and``, ``$or`` and
``$not`` nest; ``$eq $ne $gt $gte $lt $lte $in $nin $exists`` compare. A key that a
row lacks (or has as null) is equal to nothing, less and greater than nothing, and
unequal to everything. Negations are moved inwards, so that comparisons stand
alone and Spark can push them to a scan; the same form tells from a file's least
and greatest values whether any of its rows may pass.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_INVERSE = {"$eq": "$ne", "$ne": "$eq", "$gt": "not $gt", "$gte": "not $gte", "$lt": "not $lt", "$lte": "not $lte", "$in": "$nin", "$nin": "$in", "$exists": "not $exists"}
_ORDER = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}
_OPPOSITE = {"$gt": "$lte", "$gte": "$lt", "$lt": "$gte", "$lte": "$gt"}


def normal(query: dict | None, negated: bool = False) -> tuple:
    """("and" | "or", parts) or (key, operator, value), without negations of groups; unknown operators raise ``ValueError``."""
    if not query:
        return ("or" if negated else "and", [])
    parts = []
    for key, value in query.items():
        if key in ("$and", "$or"):
            if not isinstance(value, (list, tuple)) or not value:
                raise ValueError(f"{key} takes a list of filters")
            parts.append(("or" if (key == "$or") != negated else "and", [normal(v, negated) for v in value]))
        elif key == "$not":
            parts.append(normal(value, not negated))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        else:
            tests = value if isinstance(value, dict) else {"$eq": value}
            for op, x in tests.items():
                if op not in _INVERSE:
                    raise ValueError(f"unknown operator {op}")
                if op in ("$in", "$nin") and not isinstance(x, (list, tuple)):
                    raise ValueError(f"{op} takes a list")
                parts.append((key, _INVERSE[op] if negated else op, x))
    return parts[0] if len(parts) == 1 else ("or" if negated else "and", parts)


def _is_group(node: tuple) -> bool:
    return len(node) == 2


def keys(query: dict | None) -> set[str]:
    """The keys that a filter asks for."""

    def of(node):
        return set().union(*map(of, node[1])) if _is_group(node) else {node[0]}

    return of(normal(query))


def compiled(query: dict | None, column: Callable[[str, Any], Column]) -> Column:
    """The condition; ``column(key, value)`` gives the column of a key that is to be compared with a value."""

    def of(node: tuple) -> Column:
        if _is_group(node):
            join = operator.and_ if node[0] == "and" else operator.or_
            return functools.reduce(join, map(of, node[1])) if node[1] else F.lit(node[0] == "and")
        key, op, value = node
        if op.endswith("$exists"):
            own = column(key, None)
            return own.isNotNull() if bool(value) != op.startswith("not") else own.isNull()
        own = column(key, value[0] if isinstance(value, (list, tuple)) and value else value)
        if op in ("$eq", "$ne"):
            if value is None:
                return own.isNull() if op == "$eq" else own.isNotNull()
            return own == value if op == "$eq" else (own != value) | own.isNull()
        if op in ("$in", "$nin"):
            some = own.isin(list(value)) if value else F.lit(False)
            return some if op == "$in" else ~some | own.isNull() if value else F.lit(True)
        if op in _ORDER:
            return _ORDER[op](own, value)
        return _ORDER[_OPPOSITE[op[4:]]](own, value) | own.isNull()

    return of(normal(query))


def may_match(query: dict | None, stats: dict[str, tuple]) -> bool:
    """Whether rows whose keys lie within ``stats`` (key -> least, greatest, number of nulls, rows) may pass; keys without any may be anything."""

    def of(node: tuple) -> bool:
        if _is_group(node):
            return all(map(of, node[1])) if node[0] == "and" else any(map(of, node[1]))
        key, op, value = node
        if key not in stats:
            return True
        low, high, nulls, rows = stats[key]
        if op.endswith("$exists"):
            return nulls < rows if bool(value) != op.startswith("not") else nulls > 0
        if op == "$eq" and value is None:
            return nulls > 0
        if op.startswith("not ") or op in ("$ne", "$nin"):
            if nulls:
                return True
            if op.startswith("not "):
                return of((key, _OPPOSITE[op[4:]], value))
            return not (low == high and (value is not None and low == value if op == "$ne" else low in value))
        if low is None:
            return False
        try:
            if op == "$eq":
                return low <= value <= high
            if op == "$in":
                return any(low <= v <= high for v in value if v is not None)
            return _ORDER[op](high if op in ("$gt", "$gte") else low, value)
        except TypeError:  # values of another kind are for the scan to compare
            return True

    return of(normal(query))
