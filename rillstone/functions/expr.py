"""Arithmetic, null handling, casts and arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def floor_div(a: Column, b) -> Column:
    """a // b rounded towards minus infinity; null where b is 0."""
    b = _c(b)
    q = F.try_divide(a - F.try_mod(F.try_mod(a, b) + b, b), b)
    return F.floor(q).cast("bigint")


def floor_mod(a: Column, b) -> Column:
    """a % b with the sign of b; null where b is 0."""
    b = _c(b)
    return F.try_mod(F.try_mod(a, b) + b, b)


def true_div(a: Column, b) -> Column:
    """a / b as double; null where b is 0."""
    return F.try_divide(a.cast("double"), _c(b))


def power(a: Column, b, integer: bool = False) -> Column:
    """a ** b; of two integers an integer."""
    p = F.pow(a, _c(b))
    return F.round(p).cast("bigint") if integer else p


def round_even(a: Column, decimals: int = 0) -> Column:
    """Rounding to decimals, halves to the even neighbour."""
    return F.bround(a, decimals)


def fill_na(a: Column, value) -> Column:
    """value where a is null or NaN."""
    return F.when(a.isNull() | F.isnan(a.cast("double")), _c(value)).otherwise(a)


def if_else(cond: Column, yes, no) -> Column:
    """yes where cond is true, no where it is false or null; the other branch is not evaluated."""
    return F.when(cond, _c(yes)).otherwise(_c(no))


def require(value, *deps: Column) -> Column:
    """value if no dep is null, null otherwise."""
    ok = F.lit(True)
    for d in deps:
        ok = ok & d.isNotNull()
    return F.when(ok, _c(value))


def unwrap(a: Column, message: str = "value is null") -> Column:
    """a, or an error where it is null."""
    return F.when(a.isNotNull(), a).otherwise(F.raise_error(F.lit(message)))


def fill_error(tried: Column, value) -> Column:
    """value where a try_ expression gave null."""
    return F.coalesce(tried, _c(value))


def to_string(a: Column, kind: str = "") -> Column:
    """Text of a value: None for null, True and False for booleans."""
    s = F.when(a.cast("boolean"), "True").otherwise("False") if kind == "boolean" else a.cast("string")
    return F.when(a.isNull(), "None").otherwise(s)


def bit_and(a: Column, b) -> Column:
    return a.bitwiseAND(_c(b))


def bit_or(a: Column, b) -> Column:
    return a.bitwiseOR(_c(b))


def bit_xor(a: Column, b) -> Column:
    return a.bitwiseXOR(_c(b))


def xor(a: Column, b: Column) -> Column:
    """Exclusive or of booleans."""
    return a != b


def make_tuple(*cols: Column) -> Column:
    """A struct _0, _1, ...; structs compare field by field."""
    return F.struct(*[c.alias(f"_{i}") for i, c in enumerate(cols)])


def get_item(a: Column, index: int, default=None) -> Column:
    """Element of an array from 0, negative from its end; default where there is none."""
    e = F.try_element_at(a, F.lit(index + 1 if index >= 0 else index))
    return e if default is None else F.coalesce(e, _c(default))


def row_key(*cols: Column, instance: Column | None = None) -> Column:
    """A row id: equal values give equal ids; nulls are values. 128 bits as hex, the type and place of each value being part of it."""
    parts = [*cols, *([instance] if instance is not None else [])]
    told = F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(parts)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(told, 256), 1, 32)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if one of them is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def matmul(a: Column, b: Column) -> Column:
    """Product of two matrices given as arrays of rows."""
    n = F.size(b[0])
    cols = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.transform(b, lambda r: r[j]))
    return F.transform(a, lambda row: F.transform(cols, lambda col: dot(row, col)))


def matvec(a: Column, v: Column) -> Column:
    """A matrix given as an array of rows, times a vector."""
    return F.transform(a, lambda row: dot(row, v))


def cast_types(df, **kinds: str):
    """Columns cast by name."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})


def columns(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]
