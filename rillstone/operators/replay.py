"""A stream of inserts, updates and deletes applied to a table, newest batch first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def apply_changes(
    feed: DataFrame,
    key: Sequence[str],
    values: Sequence[str],
    time: str,
    diff: str,
    base: DataFrame | None = None,
    batches: int = 4,
) -> DataFrame:
    """The table as it stands after the last change, by newest-first resolution.

    The feed is cut into ``batches`` spans of ``time`` by approximate quantiles. They are processed
    backwards: within a batch each key is reduced to its newest change (partial
    aggregation before the shuffle, so a key that changes very often costs one
    row a task), keys that a newer batch has resolved are removed by an
    anti-join, and what is left is recorded as the key's image or tombstone.
    Each batch's record is written to the shared folder, so the plan stays flat
    and a lost executor repeats one batch at most. At last the rows of ``base``
    whose keys no change has touched are appended.

    Result: key and value columns, one row per present key. A key is present
    if its changes at its greatest time include an insertion.

    Defined cases: repeated delivery and any order of delivery change nothing;
    at one time deletions come before insertions, and of several insertions at
    one time the greatest image holds; null keys are keys like others, null
    values values like others; changes with a null time are older than all
    others; rows with a null diff or diff 0 are no changes; an empty feed gives
    the base (or an empty table); other columns are dropped.
    """
    ks, vs = list(key), list(values)
    f = feed.select(
        F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(ks)]).alias("_k"),
        F.col(time).cast("bigint").alias("_t"),
        (F.col(diff) > 0).alias("_in"),
        F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(vs)]).alias("_v"),
        F.col(diff).alias("_d"),
    ).where("_d is not null and _d <> 0").drop("_d")
    # spans of about as many changes each, however the times lie
    at = f.agg(F.percentile_approx("_t", [i / batches for i in range(1, batches)], 1_000), F.min("_t")).first() if batches > 1 else (None, None)
    cuts = sorted(set(at[0] or []) - {at[1]})
    # newest span first; the oldest also takes null times
    edges = [None, *cuts, None]
    resolved: DataFrame | None = None
    for i in reversed(range(len(edges) - 1)):
        a, b = edges[i], edges[i + 1]
        span = f
        if a is not None:
            span = span.where(F.col("_t") >= a)
        if b is not None:
            span = span.where((F.col("_t") < b) | F.col("_t").isNull() if i == 0 else F.col("_t") < b)
        newest = span.groupBy("_k").agg(F.max(F.struct("_t", "_in", F.when(F.col("_in"), F.col("_v")).alias("_v"))).alias("_c"))
        fresh = newest.select("_k", F.col("_c._in").alias("_in"), F.col("_c._v").alias("_v"))
        if resolved is not None:
            fresh = fresh.join(resolved.select("_k"), "_k", "left_anti")
        fresh = written(fresh)
        resolved = fresh if resolved is None else resolved.unionByName(fresh)
    assert resolved is not None
    out = resolved.where("_in").select(*[F.col("_k").getField(f"f{i}").alias(c) for i, c in enumerate(ks)], *[F.col("_v").getField(f"v{i}").alias(c) for i, c in enumerate(vs)])
    if base is not None:
        b = base.select(F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(ks)]).alias("_k"), *[F.col(c) for c in ks + vs])
        kept = b.join(resolved.select(F.col("_k")), "_k", "left_anti").select(*ks, *vs)
        out = out.unionByName(kept)
    return out
