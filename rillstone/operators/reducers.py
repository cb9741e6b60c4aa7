"""Aggregates by name. Unlike SQL's they see nulls, and ties have an order."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count() -> Column:
    """Rows, whatever is null in them."""
    return F.count(F.lit(1))


def count_distinct(*cols: Column | str) -> Column:
    """Distinct tuples, nulls being values."""
    return F.count_distinct(F.struct(*[_c(c) for c in cols]))


def count_distinct_approximate(*cols: Column | str, precision: int = 12) -> Column:
    """HyperLogLog of 2**precision registers."""
    if not 4 <= precision <= 18:
        raise ValueError("precision is from 4 to 18")
    return F.approx_count_distinct(F.struct(*[_c(c) for c in cols]), 1.04 / 2 ** (precision / 2))


def sum_(c: Column | str) -> Column:
    return F.sum(_c(c))


def array_sum(df: DataFrame, group: Sequence[str], col: str) -> DataFrame:
    """Element-wise sum of arrays per group, as column ``sum``."""
    e = df.select(*group, F.posexplode(col).alias("_i", "_v")).groupBy(*group, "_i").agg(F.sum("_v").alias("_s"))
    return e.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"]).alias("sum"))


def avg(c: Column | str) -> Column:
    return F.avg(_c(c))


def min_(c: Column | str) -> Column:
    """Least value; null is the least of all."""
    return F.min(F.struct(_c(c).isNotNull().alias("k"), _c(c).alias("v")))["v"]


def max_(c: Column | str) -> Column:
    return F.max(_c(c))


def argmin(c: Column | str, key: Column | str) -> Column:
    """key of the least value, the least key of ties."""
    return F.min_by(_c(key), F.struct(_c(c).alias("v"), _c(key).alias("k")))


def argmax(c: Column | str, key: Column | str) -> Column:
    """key of the greatest value of a number, the least key of ties."""
    return F.min_by(_c(key), F.struct((-_c(c)).alias("v"), _c(key).alias("k")))


def any_(c: Column | str, key: Column | str) -> Column:
    """Some value, of the same row for every column of the same key."""
    return F.min_by(_c(c), F.struct(F.xxhash64(_c(key)).alias("h"), _c(key).alias("k")))


def unique(c: Column | str) -> Column:
    """The only value of a group; an error if there are more."""
    lo, hi = F.min(F.struct(_c(c).alias("v")))["v"], F.max(F.struct(_c(c).alias("v")))["v"]
    return F.when(lo.eqNullSafe(hi), lo).otherwise(F.raise_error(F.lit("more than one distinct value")))


def unique_or_null(c: Column | str) -> Column:
    lo, hi = F.min(F.struct(_c(c).alias("v")))["v"], F.max(F.struct(_c(c).alias("v")))["v"]
    return F.when(lo.eqNullSafe(hi), lo)


def sorted_tuple(c: Column | str, skip_nones: bool = False) -> Column:
    """All values of a group in ascending order, nulls first."""
    if skip_nones:
        return F.array_sort(F.collect_list(_c(c)))
    return F.transform(F.array_sort(F.collect_list(F.struct(_c(c).isNotNull().alias("k"), _c(c).alias("v")))), lambda x: x["v"])


def tuple_(c: Column | str, order: Sequence[Column | str], skip_nones: bool = False) -> Column:
    """All values of a group in the order of other columns."""
    keys = [_c(o).alias(f"k{i}") for i, o in enumerate(order)]
    rows = F.array_sort(F.collect_list(F.struct(*keys, _c(c).alias("v"))))
    if skip_nones:
        rows = F.filter(rows, lambda x: x["v"].isNotNull())
    return F.transform(rows, lambda x: x["v"])


ndarray = tuple_


def earliest(c: Column | str, arrival: Column | str, key: Column | str) -> Column:
    """Value of the row that arrived first."""
    return F.min_by(_c(c), F.struct(_c(arrival).alias("t"), _c(key).alias("k")))


def latest(c: Column | str, arrival: Column | str, key: Column | str) -> Column:
    """Value of the row that arrived last."""
    return F.max_by(_c(c), F.struct(_c(arrival).alias("t"), _c(key).alias("k")))


class Accumulator:
    """A custom aggregate: state from a row, merged with others, turned into the result.

    from_row, update and compute_result are to be given; neutral is the result of an empty group.
    """

    def from_row(self, row: tuple):
        raise NotImplementedError

    def update(self, state, other):
        raise NotImplementedError

    def compute_result(self, state):
        return state

    def neutral(self):
        return None


def accumulate(df: DataFrame, group: Sequence[str], cols: Sequence[str], acc: Accumulator, kind: str, name: str, order: Sequence[str] = (), salt: int = 16) -> DataFrame:
    """A custom aggregate per group.

    States merge in any order, so each group is first folded in ``salt`` parts
    and only the parts' states meet (as pickles); an ordered one needs all its
    rows in one place and is folded there.
    """
    def fold(rows):
        state = None
        for r in rows:
            x = acc.from_row(tuple(r))
            state = x if state is None else acc.update(state, x)
        return state

    g, own = [F.col(c) for c in group], [F.col(c) for c in cols]
    if order:

        @F.pandas_udf(kind)
        def ordered(*columns: pd.Series) -> object:
            state = fold(_in_order(columns, len(own)))
            return acc.neutral() if state is None else acc.compute_result(state)

        return df.groupBy(*g).agg(ordered(*own, *[F.col(o) for o in order]).alias(name))

    @F.pandas_udf("binary")
    def part(*columns: pd.Series) -> bytes:
        return pickle.dumps(fold(zip(*columns, strict=True)))

    @F.pandas_udf(kind)
    def whole(states: pd.Series) -> object:
        state = None
        for b in states:
            x = pickle.loads(b)
            state = x if state is None else acc.update(state, x)
        return acc.neutral() if state is None else acc.compute_result(state)

    parts = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salt))).groupBy(*g, "_salt").agg(part(*own).alias("_state"))
    return parts.groupBy(*g).agg(whole("_state").alias(name))


def _in_order(columns: Sequence[pd.Series], own: int) -> list[tuple]:
    """Rows of the first own columns, by the other columns."""
    rows = pd.concat(list(columns), axis=1, ignore_index=True)
    rows = rows.sort_values(list(range(own, rows.shape[1])), kind="stable") if rows.shape[1] > own else rows
    return list(rows.iloc[:, :own].itertuples(index=False, name=None))


def stateful_single(df: DataFrame, group: Sequence[str], cols: Sequence[str], step: Callable, kind: str, name: str, order: Sequence[str]) -> DataFrame:
    """step(state, row) over the rows of a group in order, from None."""

    @F.pandas_udf(kind)
    def fold(*columns: pd.Series) -> object:
        state = None
        for r in _in_order(columns, len(cols)):
            state = step(state, r)
        return state

    return df.groupBy(*group).agg(fold(*[F.col(c) for c in [*cols, *order]]).alias(name))


def stateful_many(df: DataFrame, group: Sequence[str], cols: Sequence[str], step: Callable, kind: str, name: str, time: str, diff: str | None = None) -> DataFrame:
    """step(state, [(row, count), ...]) over the batches of a group by time, from None."""

    @F.pandas_udf(kind)
    def fold(*columns: pd.Series) -> object:
        state, own = None, len(cols)
        rows = pd.concat(list(columns), axis=1, ignore_index=True)
        for _, batch in rows.sort_values(own, kind="stable").groupby(own):
            counts = batch[own + 1] if diff else [1] * len(batch)
            values = batch.iloc[:, :own].itertuples(index=False, name=None)
            state = step(state, [(r, int(c)) for r, c in zip(values, counts, strict=True)])
        return state

    return df.groupBy(*group).agg(fold(*[F.col(c) for c in [*cols, time, *([diff] if diff else [])]]).alias(name))
