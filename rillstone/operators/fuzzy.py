"""Rows of two tables matched by the rare features they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokenize(s: Column) -> Column:
    """Words, split at white space."""
    return F.filter(F.split(F.lower(s), r"\s+"), lambda x: x != "")


def letters(s: Column) -> Column:
    """Letters and digits."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]"), F.lit(0))


def weight(count: Column, how: str) -> Column:
    """How much a feature tells, by how often it occurs on both sides."""
    if how == "weight":
        return F.pow(F.lit(2.0), -F.ceil(F.log2(count.cast("double"))))
    if how == "logweight":
        return F.lit(1.0) / F.ceil(F.log2(count.cast("double") + 1))
    return count.cast("double")


def _edges(df: DataFrame, i: str, t: str, features: Callable[[Column], Column]) -> DataFrame:
    return df.select(F.col(i).alias("n"), F.explode(features(F.col(t))).alias("f")).groupBy("n", "f").agg(F.count(F.lit(1)).cast("double").alias("w"))


def _joined(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """a and b joined by sorting. Their rows are features, far more than the files they come from let the optimizer expect, so neither may pass through the driver as a broadcast."""
    return a.join(b.hint("merge"), on, how)


def _scored(a: DataFrame, b: DataFrame, occurring: DataFrame, normalization: str, heavy: int, within: bool = False) -> DataFrame:
    """l, r, s: pairs that share a light feature, with the weight of all features they share. within: a and b are one table, no row meets itself."""
    cnt = occurring.groupBy("f").agg(F.count(F.lit(1)).alias("cnt")).select("f", "cnt", weight(F.col("cnt"), normalization).alias("fw"))
    la = _joined(a, cnt, "f").select(F.col("n").alias("l"), "f", "w", "cnt", "fw")
    rb = _joined(b, cnt, "f").select(F.col("n").alias("r"), "f", F.col("w").alias("v"), "cnt")
    light = _joined(la.where(F.col("cnt") < heavy), rb.where(F.col("cnt") < heavy).select("r", "f", "v"), "f")
    if within:
        light = light.where("l <> r")
    pairs = light.groupBy("l", "r").agg(F.sum(F.col("w") * F.col("v") * F.col("fw")).alias("s"))
    # frequent features: looked up by pair and feature, never multiplied out; left joins, so that pairs without any stay and are built once
    more = _joined(pairs, la.where(F.col("cnt") >= heavy).drop("cnt"), "l", "left")
    more = _joined(more, rb.where(F.col("cnt") >= heavy).select("r", "f", "v"), ["r", "f"], "left")
    h = F.coalesce(F.sum(F.col("w") * F.col("v") * F.col("fw")), F.lit(0.0))
    return more.groupBy("l", "r").agg(F.round(F.max("s") + h, 9).alias("s"))


def fuzzy_match(left: DataFrame, right: DataFrame, left_id: str, left_text: str, right_id: str, right_text: str, features: Callable[[Column], Column] = tokenize, normalization: str = "logweight", heavy: int = 100, by_hand: DataFrame | None = None) -> DataFrame:
    """``left_id``, ``right_id``, ``weight``: pairs of rows that are each other's best match.

    Pairs come from features that occur at most ``heavy`` times (so no feature
    makes more than heavy squared of them); more frequent ones only add to the
    weight of pairs that are there. Then the best per left row, and of those the
    best per right row, ties by ids. Pairs of by_hand (left_id, right_id,
    weight) are taken as they are, their rows out of the rest.
    """

    a, b = _edges(left, left_id, left_text, features), _edges(right, right_id, right_text, features)
    if by_hand is not None:
        a = a.join(by_hand.select(F.col("left_id").alias("n")), "n", "left_anti")
        b = b.join(by_hand.select(F.col("right_id").alias("n")), "n", "left_anti")
    scored = _scored(a, b, a.select("f").unionAll(b.select("f")), normalization, heavy)
    best_l = scored.groupBy("l").agg(F.max(F.struct("s", (-F.col("r")).alias("o"), "r")).alias("x")) if dict(scored.dtypes)["r"] in ("bigint", "int") else scored.groupBy("l").agg(F.max(F.struct("s", F.col("r").alias("o"), "r")).alias("x"))
    got = best_l.select("l", F.col("x.r").alias("r"), F.col("x.s").alias("s"))
    best_r = got.groupBy("r").agg(F.max(F.struct("s", (-F.col("l")).alias("o"), "l")).alias("x")) if dict(got.dtypes)["l"] in ("bigint", "int") else got.groupBy("r").agg(F.max(F.struct("s", F.col("l").alias("o"), "l")).alias("x"))
    out = best_r.select(F.col("x.l").alias("left_id"), F.col("r").alias("right_id"), F.col("x.s").alias("weight"))
    return out if by_hand is None else out.unionByName(by_hand.select("left_id", "right_id", F.col("weight").cast("double").alias("weight")))


def fuzzy_self_match(df: DataFrame, row_id: str, text: str, features: Callable[[Column], Column] = tokenize, normalization: str = "logweight", heavy: int = 100) -> DataFrame:
    """Pairs within one table, scored as in fuzzy_match; each pair once, the smaller id on the left.

    The best partner of a row is sought among all others, and of the rows with
    the same partner the best one holds; ties by the ids of the pair.
    """
    e = _edges(df, row_id, text, features)
    m = _scored(e, e, e.select("f"), normalization, heavy, within=True)
    small, great = F.least("l", "r"), F.greatest("l", "r")
    ids = (-small, -great) if dict(m.dtypes)["l"] in ("bigint", "int") else (small, great)
    m = m.select("l", "r", F.struct("s", ids[0].alias("o"), ids[1].alias("p")).alias("x"))
    m = m.groupBy("l").agg(F.max_by("r", "x").alias("r"), F.max("x").alias("x"))
    m = m.groupBy("r").agg(F.max_by("l", "x").alias("l"), F.max("x").alias("x"))
    return m.where("l < r").select(F.col("l").alias("left_id"), F.col("r").alias("right_id"), F.col("x.s").alias("weight"))
