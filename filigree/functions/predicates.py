"""Property predicates with two-valued logic.

A leaf on an absent property is false, and its negation true. So that comparisons reach the Parquet scan, a predicate is
compiled by polarity: a leaf under no negation stays a bare comparison, since null and false both drop the row;
negations move to the leaves, and a negated leaf becomes ``is null or not leaf``. On a Set property (an array) a leaf
holds if any value matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (*INTEGERS, T.FloatType, T.DoubleType)


@dataclass(frozen=True)
class P:
    """A predicate over the values of one key; build it with the class methods, combine it with & | ~."""

    op: str
    parts: tuple[P, ...] = ()
    leaf: Callable[[Column], Column] | None = None
    types: tuple = ()
    absent: bool = False

    @classmethod
    def _leaf(cls, types: tuple, leaf: Callable[[Column], Column], absent: bool = False) -> P:
        return cls("leaf", (), leaf, types, absent)

    @classmethod
    def eq(cls, value) -> P:
        """Equality by type: integers meet only integers, doubles only doubles, strings and booleans their own."""
        return cls._leaf(_types_of(value), lambda c: c == F.lit(value))

    @classmethod
    def neq(cls, value) -> P:
        return ~cls.eq(value)

    @classmethod
    def gt(cls, value) -> P:
        return cls._leaf(_range_types(value), lambda c: c > F.lit(value))

    @classmethod
    def gte(cls, value) -> P:
        return cls._leaf(_range_types(value), lambda c: c >= F.lit(value))

    @classmethod
    def lt(cls, value) -> P:
        return cls._leaf(_range_types(value), lambda c: c < F.lit(value))

    @classmethod
    def lte(cls, value) -> P:
        return cls._leaf(_range_types(value), lambda c: c <= F.lit(value))

    @classmethod
    def between(cls, low, high) -> P:
        """Half-open: low <= value < high."""
        return cls._leaf(_range_types(low), lambda c: (c >= F.lit(low)) & (c < F.lit(high)))

    @classmethod
    def within(cls, values: Iterable) -> P:
        some = list(values)
        return cls._leaf(_types_of(some[0]) if some else (T.StringType,), lambda c: c.isin(some))

    @classmethod
    def without(cls, values: Iterable) -> P:
        return ~cls.within(values)

    @classmethod
    def starts_with(cls, text: str) -> P:
        return cls._leaf((T.StringType,), lambda c: c.startswith(text))

    @classmethod
    def ends_with(cls, text: str) -> P:
        return cls._leaf((T.StringType,), lambda c: c.endswith(text))

    @classmethod
    def contains(cls, text: str) -> P:
        return cls._leaf((T.StringType,), lambda c: c.contains(text))

    @classmethod
    def regex(cls, pattern: str) -> P:
        """Unanchored search, in Java's dialect."""
        return cls._leaf((T.StringType,), lambda c: c.rlike(pattern))

    @classmethod
    def present(cls) -> P:
        return cls("present")

    @classmethod
    def missing(cls) -> P:
        return ~cls.present()

    def __and__(self, other: P) -> P:
        return P("and", (self, other))

    def __or__(self, other: P) -> P:
        return P("or", (self, other))

    def __invert__(self) -> P:
        return P("not", (self,))

    def compile(self, column: Column, kind: T.DataType, positive: bool = True) -> Column:
        """The condition on a column of the given type; null counts as false at the top."""
        if self.op == "not":
            return self.parts[0].compile(column, kind, not positive)
        if self.op in ("and", "or"):
            both = and_ if (self.op == "and") == positive else or_
            return reduce(both, (p.compile(column, kind, positive) for p in self.parts))
        if self.op == "present":
            return column.isNotNull() if positive else column.isNull()
        element = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if not isinstance(element, self.types):
            return F.lit(not positive)
        test = F.exists(column, lambda x: F.coalesce(self.leaf(x), F.lit(False))) if isinstance(kind, T.ArrayType) else self.leaf(column)
        return test if positive else (column.isNull() | ~test)

    def value(self, column: Column, kind: T.DataType) -> Column:
        """The predicate as a boolean value, never null; it does not reach the scan."""
        return F.coalesce(self.compile(column, kind), F.lit(False))


def _types_of(value) -> tuple:
    if isinstance(value, bool):
        return (T.BooleanType,)
    if isinstance(value, int):
        return INTEGERS
    if isinstance(value, float):
        return (T.DoubleType, T.FloatType)
    if isinstance(value, str):
        return (T.StringType,)
    if isinstance(value, (bytes, bytearray)):
        return (T.BinaryType,)
    return (T.TimestampType, T.TimestampNTZType, T.DateType)


def _range_types(value) -> tuple:
    """Integer bounds meet integers; double bounds meet integers too; there is no order of strings."""
    if isinstance(value, str):
        raise TypeError("strings have no order predicate")
    return NUMBERS if isinstance(value, float) else _types_of(value)


def condition(df: DataFrame, key: str, predicate: P) -> Column:
    """The predicate on a property column of df; a key that no column holds is absent everywhere."""
    if key not in df.columns:
        return predicate.compile(F.lit(None), T.NullType())
    return predicate.compile(F.col(key), df.schema[key].dataType)
