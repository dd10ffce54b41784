"""Options of a query: predicates with three-valued logic, projections and hints.

Each predicate leaf tests one column.  A null is UNKNOWN to every leaf, even to one that is
constantly true or false; a NaN matches no bounded comparison, NE included, and is FALSE
rather than UNKNOWN, so that a negation keeps it.  Lowered to Spark columns, the comparison
stays apart from the NaN guard and so still reaches the file scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FieldNotFoundError, TypeMismatchError, UnsupportedError
from ..schema import kind_of, literal_kind

#: Comparison masks: any union of less (1), equal (2) and greater (4).
LT, EQ, GT = 1, 2, 4
LE, NE, GE = LT | EQ, LT | GT, EQ | GT


class Option:
    """Anything that a query takes."""


class Predicate(Option):
    def lower(self, schema: T.StructType) -> Column:
        raise NotImplementedError

    def fields(self) -> Iterator[str]:
        raise NotImplementedError


def _field(schema: T.StructType, op: str, name: str, kind: str | None) -> T.StructField:
    if name not in schema.fieldNames():
        raise FieldNotFoundError(op, name)
    f = schema[name]
    have = kind_of(f.dataType)
    if have is None:
        raise TypeMismatchError(op, name, kind or "a scalar", f.dataType.simpleString())
    if kind is not None and kind != have:
        raise TypeMismatchError(op, name, kind, have)
    return f


def _constant(column: Column, value: bool) -> Column:
    """``value`` for a row that isn't null, else UNKNOWN."""
    return F.when(column.isNotNull(), F.lit(value))


@dataclass(frozen=True)
class Where(Predicate):
    """``test``: a function from Column to Column, or with ``opaque`` a Python function of a value.

    An opaque test is never called for a null; it can't be pushed into a scan.
    """

    field: str
    test: Callable
    kind: str | None = None
    opaque: bool = False

    def lower(self, schema: T.StructType) -> Column:
        _field(schema, "where", self.field, self.kind)
        c = F.col(f"`{self.field}`")
        if self.opaque:
            test = self.test

            @F.udf("boolean", useArrow=True)
            def called(v):  # noqa: ANN001, ANN202
                return None if v is None else bool(test(v))

            return F.when(c.isNotNull(), called(c))
        return F.when(c.isNotNull(), F.coalesce(self.test(c), F.lit(False)))

    def fields(self) -> Iterator[str]:
        yield self.field


@dataclass(frozen=True)
class WhereCmp(Predicate):
    field: str
    op: int
    value: object

    def lower(self, schema: T.StructType) -> Column:
        kind = literal_kind(self.value)
        if kind in (None, "bool"):
            raise UnsupportedError("where_cmp", self.field, "an ordered literal", type(self.value).__name__)
        f = _field(schema, "where_cmp", self.field, kind)
        c, v = F.col(f"`{self.field}`"), F.lit(self.value.item() if hasattr(self.value, "item") else self.value).cast(f.dataType)
        floating = kind.startswith("float")
        if floating and math.isnan(float(self.value)) or not self.op & 7:
            return _constant(c, False)
        tests = {LT: c < v, EQ: c == v, GT: c > v, LE: c <= v, GE: c >= v, NE: c != v, 7: _constant(c, True)}
        out = tests[self.op & 7]
        return out & ~F.isnan(c) if floating else out

    def fields(self) -> Iterator[str]:
        yield self.field


@dataclass(frozen=True)
class WhereRange(Predicate):
    """Inclusive at both ends; empty if ``lo`` > ``hi``."""

    field: str
    lo: object
    hi: object

    def lower(self, schema: T.StructType) -> Column:
        kind = literal_kind(self.lo)
        if kind in (None, "bool") or literal_kind(self.hi) != kind:
            raise UnsupportedError("where_range", self.field, "two ordered literals of one kind", f"{type(self.lo).__name__}, {type(self.hi).__name__}")
        f = _field(schema, "where_range", self.field, kind)
        c = F.col(f"`{self.field}`")
        floating = kind.startswith("float")
        if floating and (math.isnan(float(self.lo)) or math.isnan(float(self.hi))):
            return _constant(c, False)
        lo, hi = (F.lit(x.item() if hasattr(x, "item") else x).cast(f.dataType) for x in (self.lo, self.hi))
        out = (c >= lo) & (c <= hi)
        return out & ~F.isnan(c) if floating else out

    def fields(self) -> Iterator[str]:
        yield self.field


@dataclass(frozen=True)
class And(Predicate):
    terms: tuple[Predicate, ...]

    def lower(self, schema: T.StructType) -> Column:
        out = F.lit(True)
        for i, t in enumerate(self.terms):
            out = t.lower(schema) if not i else out & t.lower(schema)
        return out

    def fields(self) -> Iterator[str]:
        for t in self.terms:
            yield from t.fields()


@dataclass(frozen=True)
class Or(Predicate):
    terms: tuple[Predicate, ...]

    def lower(self, schema: T.StructType) -> Column:
        out = F.lit(False)
        for i, t in enumerate(self.terms):
            out = t.lower(schema) if not i else out | t.lower(schema)
        return out

    def fields(self) -> Iterator[str]:
        for t in self.terms:
            yield from t.fields()


@dataclass(frozen=True)
class Not(Predicate):
    term: Predicate

    def lower(self, schema: T.StructType) -> Column:
        return ~self.term.lower(schema)

    def fields(self) -> Iterator[str]:
        yield from self.term.fields()


@dataclass(frozen=True)
class Select(Option):
    names: tuple[str, ...]


@dataclass(frozen=True)
class Hint(Option):
    """A memory hint without a meaning for Spark."""

    name: str


def _terms(op: str, options: tuple[Option, ...]) -> tuple[Predicate, ...]:
    for o in options:
        if not isinstance(o, Predicate):
            raise UnsupportedError(op, None, "predicates", type(o).__name__)
    return options  # type: ignore[return-value]


def where(field: str, test: Callable[[Column], Column], kind: str | None = None) -> Where:
    return Where(field, test, kind)


def where_python(field: str, test: Callable[[object], bool], kind: str | None = None) -> Where:
    return Where(field, test, kind, opaque=True)


def where_cmp(field: str, op: int, value: object) -> WhereCmp:
    return WhereCmp(field, op, value)


def where_range(field: str, lo: object, hi: object) -> WhereRange:
    return WhereRange(field, lo, hi)


def and_(*options: Option) -> And:
    """All rows if empty."""
    return And(_terms("and", options))


def or_(*options: Option) -> Or:
    """No rows if empty."""
    return Or(_terms("or", options))


def not_(option: Option) -> Not:
    return Not(*_terms("not", (option,)))


def select(*names: str) -> Select:
    return Select(names)


def with_no_copy() -> Hint:
    return Hint("no_copy")


def with_arena() -> Hint:
    return Hint("arena")
