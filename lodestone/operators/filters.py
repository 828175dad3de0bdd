"""The portable filter algebra: an immutable tree that becomes a Column.

Every predicate is true or false, never null, so negation is plain: a null is unequal to any value, in
no list, and contains nothing. Strings compare without regard to case.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import OptionError, UnknownFieldError

Resolve = Callable[[str], Column]


class Filter:
    """Of all predicates; `&`, `|` and `~` combine them."""

    def __and__(self, other: Filter) -> Filter:
        return all_of(self, other)

    def __or__(self, other: Filter) -> Filter:
        return any_of(self, other)

    def __invert__(self) -> Filter:
        return Not(self)


@dataclass(frozen=True)
class Comparison(Filter):
    """op: eq, ne, gt, ge, lt, le."""

    op: str
    field: str
    value: Any


@dataclass(frozen=True)
class Membership(Filter):
    field: str
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class NullTest(Filter):
    field: str
    negated: bool = False


@dataclass(frozen=True)
class TextTest(Filter):
    """op: contains, startswith, endswith."""

    op: str
    field: str
    value: str


@dataclass(frozen=True)
class Junction(Filter):
    parts: tuple[Filter, ...]
    disjunction: bool = False


@dataclass(frozen=True)
class Not(Filter):
    part: Filter


@dataclass(frozen=True)
class Native(Filter):
    """A trusted SQL fragment; for what the algebra lacks."""

    sql: str


def equal(field: str, value: Any) -> Filter:
    return Comparison("eq", field, value)


def not_equal(field: str, value: Any) -> Filter:
    return Comparison("ne", field, value)


def _ordered(op: str, field: str, value: Any) -> Filter:
    if value is None:
        raise OptionError("an ordering needs a value")
    return Comparison(op, field, value)


def greater(field: str, value: Any) -> Filter:
    return _ordered("gt", field, value)


def greater_or_equal(field: str, value: Any) -> Filter:
    return _ordered("ge", field, value)


def less(field: str, value: Any) -> Filter:
    return _ordered("lt", field, value)


def less_or_equal(field: str, value: Any) -> Filter:
    return _ordered("le", field, value)


def is_in(field: str, values: Iterable) -> Filter:
    return Membership(field, tuple(values))


def not_in(field: str, values: Iterable) -> Filter:
    return Membership(field, tuple(values), True)


def is_null(field: str) -> Filter:
    return NullTest(field)


def is_not_null(field: str) -> Filter:
    return NullTest(field, True)


def _text(op: str, field: str, value: str) -> Filter:
    if not isinstance(value, str):
        raise OptionError("a text test needs a string")
    return TextTest(op, field, value)


def contains(field: str, value: str) -> Filter:
    return _text("contains", field, value)


def starts_with(field: str, value: str) -> Filter:
    return _text("startswith", field, value)


def ends_with(field: str, value: str) -> Filter:
    return _text("endswith", field, value)


def _junction(parts: tuple[Filter, ...], disjunction: bool) -> Filter:
    if not parts:
        raise OptionError("a conjunction or disjunction needs an operand")
    return parts[0] if len(parts) == 1 else Junction(parts, disjunction)


def all_of(*parts: Filter) -> Filter:
    return _junction(parts, False)


def any_of(*parts: Filter) -> Filter:
    return _junction(parts, True)


def negate(part: Filter) -> Filter:
    return Not(part)


def native(sql: str) -> Filter:
    return Native(sql)


def combine(*parts: Filter | None) -> Filter | None:
    """The conjunction of those parts that are there."""
    there = [p for p in parts if p is not None]
    return all_of(*there) if there else None


def resolver(columns: Mapping[str, str]) -> Resolve:
    """From logical to physical names; a name that isn't mapped is an error at once."""

    def resolve(field: str) -> Column:
        if field not in columns:
            raise UnknownFieldError(f"the field {field!r} isn't mapped; there are {sorted(columns)}")
        return F.col(columns[field])

    return resolve


def _same(c: Column, value: Any) -> Column:
    if value is None:
        return c.isNull()
    if isinstance(value, str):
        return F.coalesce(F.lower(c) == F.lower(F.lit(value)), F.lit(False))
    return F.coalesce(c == F.lit(value), F.lit(False))


_ORDER = {"gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}


def compile_filter(f: Filter | None, resolve: Resolve) -> Column:
    """The Column of a filter; true for none. Values are literals, never SQL text."""
    match f:
        case None:
            return F.lit(True)
        case Comparison("eq", field, value):
            return _same(resolve(field), value)
        case Comparison("ne", field, value):
            return ~_same(resolve(field), value)
        case Comparison(op, field, value):
            c, v = resolve(field), F.lit(value)
            if isinstance(value, str):
                c, v = F.upper(c), F.upper(v)
            return F.coalesce(_ORDER[op](c, v), F.lit(False))
        case Membership(field, values, negated):
            c = resolve(field)
            there = [v for v in values if v is not None]
            if there and all(isinstance(v, str) for v in there):
                found = F.coalesce(F.lower(c).isin([v.lower() for v in there]), F.lit(False))
            elif there:
                found = F.coalesce(c.isin(there), F.lit(False))
            else:
                found = F.lit(False)
            if len(there) < len(values):
                found = found | c.isNull()
            return ~found if negated else found
        case NullTest(field, negated):
            return resolve(field).isNotNull() if negated else resolve(field).isNull()
        case TextTest(op, field, value):
            test = {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[op]
            return F.coalesce(test(F.lower(resolve(field)), F.lower(F.lit(value))), F.lit(False))
        case Junction(parts, disjunction):
            cols = [compile_filter(p, resolve) for p in parts]
            return reduce((lambda a, b: a | b) if disjunction else (lambda a, b: a & b), cols)
        case Not(part):
            return ~compile_filter(part, resolve)
        case Native(sql):
            return F.coalesce(F.expr(sql), F.lit(False))
    raise OptionError(f"not a filter: {f!r}")


def condition(f: Filter | None, resolve: Resolve) -> Column:
    """compile_filter() for a `where`, where null is as good as false: bare comparisons, which reach the scan.

    Negations are carried down to the comparisons; a negated one is true for null, and says so.
    """
    return _condition(f, resolve, False)


def _condition(f: Filter | None, resolve: Resolve, negated: bool) -> Column:
    match f:
        case Not(part):
            return _condition(part, resolve, not negated)
        case Junction(parts, disjunction):
            cols = [_condition(p, resolve, negated) for p in parts]
            return reduce((lambda a, b: a | b) if disjunction != negated else (lambda a, b: a & b), cols)
        case Comparison(("eq" | "ne") as op, field, value) if value is not None:
            c, v = resolve(field), F.lit(value)
            if isinstance(value, str):
                same = F.lower(c) == F.lower(v)
            else:
                same = c == v
            return same if (op == "eq") != negated else c.isNull() | ~same
        case Comparison(op, field, value) if op in _ORDER:
            c, v = resolve(field), F.lit(value)
            a, b = (F.upper(c), F.upper(v)) if isinstance(value, str) else (c, v)
            return c.isNull() | ~_ORDER[op](a, b) if negated else _ORDER[op](a, b)
        case Membership(field, values, without) if all(v is not None for v in values) and values:
            c = resolve(field)
            found = F.lower(c).isin([v.lower() for v in values]) if all(isinstance(v, str) for v in values) else c.isin(list(values))
            return found if without == negated else c.isNull() | ~found
    out = compile_filter(f, resolve)
    return ~out if negated else out


def _equal_values(a: Any, b: Any) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, str) and isinstance(b, str):
        return a.lower() == b.lower()
    return a == b


def _comparable(a: Any, b: Any) -> tuple[Any, Any]:
    if isinstance(a, str) and isinstance(b, str):
        return a.upper(), b.upper()
    if isinstance(a, decimal.Decimal) and isinstance(b, float):
        return float(a), b
    if isinstance(a, datetime.datetime) and type(b) is datetime.date:
        return a, datetime.datetime(b.year, b.month, b.day)
    return a, b


def matches(f: Filter | None, values: Mapping[str, Any]) -> bool:
    """The same predicate on one row of plain values, for driver-side use and for tests."""

    def of(field: str) -> Any:
        if field not in values:
            raise UnknownFieldError(f"no field {field!r}")
        return values[field]

    match f:
        case None:
            return True
        case Comparison("eq", field, value):
            return _equal_values(of(field), value)
        case Comparison("ne", field, value):
            return not _equal_values(of(field), value)
        case Comparison(op, field, value):
            a = of(field)
            return a is not None and bool(_ORDER[op](*_comparable(a, value)))
        case Membership(field, wanted, negated):
            a = of(field)
            return any(_equal_values(a, v) for v in wanted) != negated
        case NullTest(field, negated):
            return (of(field) is None) != negated
        case TextTest(op, field, value):
            a = of(field)
            if not isinstance(a, str):
                return False
            a, v = a.lower(), value.lower()
            return v in a if op == "contains" else a.startswith(v) if op == "startswith" else a.endswith(v)
        case Junction(parts, disjunction):
            return (any if disjunction else all)(matches(p, values) for p in parts)
        case Not(part):
            return not matches(part, values)
    raise OptionError(f"can't be evaluated outside of Spark: {f!r}")


def is_simple(f: Filter | None) -> bool:
    """Whether a filter is a conjunction of at most one plain comparison a column: what an approximate index can take along."""
    if f is None:
        return True
    parts = f.parts if isinstance(f, Junction) and not f.disjunction else (f,)
    fields = [p.field for p in parts if isinstance(p, Comparison) and p.op != "ne" and p.value is not None]
    return len(fields) == len(parts) == len(set(fields))
