"""Equi-joins in which null keys match, with and without row identity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import row_key

#: A side is broadcast by hint only if the optimizer knows it to be smaller than this.
BROADCAST_BYTES = 64 << 20


def known_size(df: DataFrame) -> int:
    """The optimizer's estimate in bytes; very large where it has none."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if known_size(df) <= most else df


def null_safe(left: str, right: str, on: Mapping[str, str]) -> Column:
    """Equality of key columns under two aliases, null equal to null."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{l}").eqNullSafe(F.col(f"{right}.{r}")) for l, r in on.items()])


def join(left: DataFrame, right: DataFrame, on: Mapping[str, str] | Sequence[str] = (), how: str = "inner", id_from: str | None = None) -> DataFrame:
    """Join of aliases ``l`` and ``r``; select columns as ``l.x`` and ``r.y``. Null keys match. Without keys, every pair.

    With ids on both sides the result has ``_id``: made from both, or kept from
    the side that id_from names.
    """
    keys = dict(on) if isinstance(on, Mapping) else {c: c for c in on}
    l, r = left.alias("l"), right.alias("r")
    if not keys:
        return l.crossJoin(r)
    out = l.join(r, null_safe("l", "r", keys), how)
    if "id" in left.columns and "id" in right.columns:
        out = out.withColumn("_id", F.col(f"{id_from[0]}.id") if id_from else row_key(F.col("l.id"), F.col("r.id")))
    return out


def join_inner(left, right, on=(), **kw) -> DataFrame:
    return join(left, right, on, "inner", **kw)


def join_left(left, right, on=(), **kw) -> DataFrame:
    return join(left, right, on, "left", **kw)


def join_right(left, right, on=(), **kw) -> DataFrame:
    return join(left, right, on, "right", **kw)


def join_outer(left, right, on=(), **kw) -> DataFrame:
    return join(left, right, on, "full", **kw)


def semi(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.alias("l").join(right.alias("r"), null_safe("l", "r", {c: c for c in on}), "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.alias("l").join(right.alias("r"), null_safe("l", "r", {c: c for c in on}), "left_anti")


def salted(left: DataFrame, right: DataFrame, on: Sequence[str], parts: int, how: str = "inner") -> DataFrame:
    """Equi-join for a left side with very frequent keys: each key is spread over ``parts``, the right side repeated for them.

    For inner, left, semi and anti joins; adaptive skew handling does the same
    at run time where it applies.
    """
    l = left.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(parts)))
    r = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    return l.join(r, [*on, "_part"], how).drop("_part")


def gradual_broadcast(df: DataFrame, bounds: DataFrame, lower: str, value: str, upper: str) -> DataFrame:
    """Every row with ``apx_value``: a value between lower and upper of the one-row table, spread by the row's hash.

    The value comes from the row's place among all hashes, so that when it moves only few rows see another one.
    """
    one = bounds.select(F.col(lower).cast("double").alias("_lo"), F.col(value).cast("double").alias("_v"), F.col(upper).cast("double").alias("_hi")).limit(1)
    place = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(1 << 20)) / float(1 << 20)
    up = place < F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return df.crossJoin(F.broadcast(one)).withColumn("apx_value", F.when(up, F.col("_hi")).otherwise(F.col("_lo"))).drop("_lo", "_v", "_hi")
